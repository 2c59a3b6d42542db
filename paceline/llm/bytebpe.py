"""Byte-level BPE by ranked merges, encoding and decoding in higher-order functions."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.words import indices

#: Most frequent words whose ids are looked up; all others are folded where they stand.
HEAD_WORDS = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Lookup:
    """Pairs of strings, cut into small maps by the hash of the first so that a look-up reads a few entries."""

    KIND = pa.list_(pa.map_(pa.string(), pa.string()))

    def __init__(self, entries: Iterable[tuple[str, str]], size: int):
        self.maps: list[list[tuple[str, str]]] = [[] for _ in range(max(1, size // 2))]
        for key, value in entries:
            h = xxhash.xxh64_intdigest(key.encode(), 42)
            self.maps[(h - 2**64 if h >= 2**63 else h) % len(self.maps)].append((key, value))

    def literal(self) -> Column:
        """The maps as a literal, for short ones: a plan's text holds all of it."""
        maps = [F.create_map(*(F.lit(x) for entry in m for x in entry)) if m else F.create_map().cast("map<string,string>") for m in self.maps]
        return F.array(*maps)

    def get(self, maps: Column, key: Column) -> Column:
        """The value beside a key in these maps, as a column has them."""
        return F.try_element_at(F.get(maps, F.pmod(F.xxhash64(key), F.lit(len(self.maps))).cast("int")), key)


def with_tables(
    docs: DataFrame, of: str, name: str, use: Callable[[Column, Column], Column], **tables: tuple[list, pa.DataType]
) -> DataFrame:
    """The rows with ``use(tables, value)`` as a column: a struct of constant values, and the column ``of``.

    The values are the one row of a scalar subquery, so neither a plan's text nor its
    expressions hold them as literals would. The optimizer puts the subquery where it is used,
    as it is used once, so that rows don't carry it; the copy of ``of`` keeps it from going
    to where that column is worked out instead.
    """
    kind = pa.struct([(k, v[1]) for k, v in tables.items()])
    row = pa.table({"tables": pa.array([{k: v[0] for k, v in tables.items()}], kind)})
    own, value, taken = "_tables", "_value", {c.lower() for c in docs.columns}
    while own in taken or value in taken:
        own, value = own + "_", value + "_"
    held = docs.select("*", F.col(of).alias(value), docs.sparkSession.createDataFrame(row).scalar().alias(own))
    used = _named(F.col(own), lambda tables: _named(F.col(value), lambda x: use(tables, x)))
    return held.withColumn(name, used).drop(own, value)


#: So many of the lowest ranks, at most, are merged by replacing their pairs in a whole word.
EARLY = 32

#: Stands after each token character, so that two bytes for either make a 32-bit id.
GAP = "\0"

#: Stands for no token; greater than all of them.
NONE = "\ue000"

#: Stands for the id 0 while characters are translated, which would drop its own character.
ZERO = "\ue001"

#: The 256 bytes as characters.
ALL_BYTES = bytes(range(256)).decode("latin-1")


def sign(rank: int) -> str:
    """The character that stands for a token id: the one with this code."""
    if rank >= 0xD800:
        raise ValueError("ids from 55296 on have no character of two bytes")
    return chr(rank)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _next(state: Column, value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, which is a state as well, with the value worked out once and the state not copied."""
    return F.aggregate(F.array(value), state, lambda _, x: use(x))


def _state(parts: Column, makes: Column) -> Column:
    return F.struct(parts.alias("parts"), makes.alias("makes"), F.array_min(F.split(makes, "")).alias("low"))


def early_merges(made: dict[int, list[tuple[int, int]]], limit: int) -> list[tuple[int, int, int]]:
    """The first merges in the order of their ranks that may be done everywhere in a word before any other.

    ``made`` has for each rank the pairs that make it. The lowest rank is always merged first,
    from left to right, and so is the next one afterwards, as long as no pair with the new token
    makes a rank as low, and the pairs that make it don't overlap unless they are the same one.
    """
    least: dict[int, int] = {}
    for rank, pairs in made.items():
        for token in {t for pair in pairs for t in pair}:
            least[token] = min(rank, least.get(token, rank))
    early = []
    for rank in sorted(made)[:limit]:
        pairs = made[rank]
        if least.get(rank, rank + 1) <= rank or any(p[1] == q[0] for p in pairs for q in pairs if p != q):
            break
        early += [(*pair, rank) for pair in pairs]
    return early


def java_pattern(pattern: str) -> str:
    """The pattern with white space as Unicode has it, which Java's short form hasn't."""
    pattern = pattern.replace("'s|'t|'re|'ve|'m|'ll|'d|", "'(?:s|t|re|ve|m|ll|d)|")  # the same, tried at once
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


class Codec:
    """Column expressions for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = java_pattern(pattern)
        pieces = [""] * (max(ranks.values(), default=0) + 1)
        pairs, made = {}, {}
        for token, rank in ranks.items():
            pieces[rank] = token.hex().upper()
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[sign(left) + sign(right)] = sign(rank)
                    made.setdefault(rank, []).append((left, right))
        #: What two tokens make together; tokens are characters, in the order of their ranks.
        self.pairs = Lookup(pairs.items(), len(pairs))
        #: The tokens of single bytes, which a byte-level vocabulary has all.
        self.bytes = "".join(sign(ranks[bytes([b])]) for b in range(256)).replace(sign(0), ZERO)
        self.early = [(sign(left) + sign(right), sign(rank)) for left, right, rank in early_merges(made, EARLY)]
        #: What each id stands for, in hexadecimal digits.
        self.pieces = pieces

    def words(self, text: Column) -> Column:
        """The matches of the pattern, in order; together they are the text."""
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def fold(self, word: Column, pairs: Column | None = None) -> Column:
        """Token characters of one word, a gap after each: from its bytes on, the pair with the lowest rank is merged, the left one first.

        The lowest ranks are merged by replacing (see ``early_merges``); then the state is two strings, the tokens between two walls and for each token but the last
        what it makes with the next one, and the least of the latter. A merge looks up the two
        pairs around the new token only; a word that makes nothing more costs one comparison a step.
        ``pairs`` are the maps of ``self.pairs``, a literal if none.
        """
        if pairs is None:
            return _named(self.pairs.literal(), lambda maps: self.fold(word, maps))
        code = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        singles = F.replace(F.translate(code, ALL_BYTES, self.bytes), F.lit(ZERO), F.lit(sign(0)))
        for pair, token in self.early:
            singles = F.replace(singles, F.lit(pair), F.lit(token))

        def merge(parts: Column) -> Column:
            count = F.char_length(parts) - 3
            inner = F.transform(indices(F.lit(2), count), lambda i: F.substring(parts, i, F.lit(2)))
            makes = F.concat(F.lit(NONE), self._made(pairs, inner), F.lit(NONE))
            start = _named(makes, lambda makes: _state(parts, makes))
            return F.aggregate(indices(F.lit(1), count), start, lambda s, _: self._step(pairs, s, s["parts"], s["makes"], s["low"]))["parts"]

        folded = _named(F.concat(F.lit(NONE), singles, F.lit(NONE)), merge)
        inside = F.split(F.translate(folded, NONE, ""), "")
        return F.concat(F.array_join(inside, GAP), F.lit(GAP))

    def _made(self, pairs: Column, found: Column) -> Column:
        """What each pair of an array makes, in a row."""
        return F.array_join(F.transform(found, lambda pair: F.coalesce(self.pairs.get(pairs, pair), F.lit(NONE))), "")

    def _step(self, pairs: Column, state: Column, parts: Column, makes: Column, low: Column) -> Column:
        def merged(at: Column) -> Column:
            """``low`` in place of the pair at ``at``, which is at least 2: a wall makes nothing."""
            return _next(state, F.overlay(parts, low, at, 2), lambda after: around(after, at))

        def around(after: Column, at: Column) -> Column:
            found = F.array(F.substring(after, at - 1, F.lit(2)), F.substring(after, at, F.lit(2)))
            return _next(state, F.overlay(makes, self._made(pairs, found), at - 1, 3), lambda makes: _state(after, makes))

        return F.when(low == NONE, state).otherwise(_next(state, F.instr(makes, low), merged))

    def encode(self, words: Column, pairs: Column, head: Lookup, maps: Column) -> Column:
        """Ids of a list of words, looked up or else folded, as little-endian unsigned 32-bit integers."""
        tokens = F.transform(words, lambda word: F.coalesce(head.get(maps, word), self.fold(word, pairs)))
        return F.encode(F.array_join(tokens, ""), "UTF-16LE")

    def decode(self, ids: Column, pieces: Column) -> Column:
        """The bytes that such ids stand for: their pieces in a row."""
        # With the mark of little-endian order before them, ids are characters of four bytes.
        tokens = F.decode(F.concat(F.unhex(F.lit("FFFE0000")), ids), "UTF-32")
        found = F.transform(F.split(tokens, ""), lambda c: F.get(pieces, F.ascii(c)))
        return F.unhex(F.when(F.octet_length(ids) == 0, "").otherwise(F.array_join(found, "")))


def head_words(docs: DataFrame, codec: Codec, text_col: str = "text", limit: int = HEAD_WORDS) -> dict[str, str]:
    """The most frequent words of all texts with their tokens; ``limit`` bounds what the driver holds.

    Texts are counted between blanks, which is cheaper than by the pattern; each distinct
    part is then cut by the pattern, as if a blank stood before it.
    """
    parts = docs.select(F.explode(F.split(F.col(text_col), " ")).alias("part")).groupBy("part").count()
    words = parts.select(F.explode(codec.words(F.concat(F.lit(" "), "part"))).alias("word"), "count")
    top = words.groupBy("word").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "word").limit(limit)
    pairs = (codec.pairs.maps, Lookup.KIND)
    found = with_tables(top.select("word"), "word", "tokens", lambda t, word: codec.fold(word, t["pairs"]), pairs=pairs).toArrow()
    return dict(zip(found["word"].to_pylist(), found["tokens"].to_pylist()))


def encode(
    docs: DataFrame, codec: Codec, text_col: str = "text", ids_col: str = "ids", head: int = HEAD_WORDS
) -> DataFrame:
    """The rows with their ids as a binary column (see ``Codec.encode``); a null text is empty.

    Frequent words are folded once and looked up; every other word is folded in its
    document. Which words are frequent changes the time only. No words are shuffled but the
    counts by word, combined before. Works on one row at a time.
    """
    known = head_words(docs, codec, text_col, head)
    head_maps = Lookup(known.items(), len(known))

    def ids(tables: Column, text: Column) -> Column:
        return codec.encode(codec.words(F.coalesce(text, F.lit(""))), tables["pairs"], head_maps, tables["head"])

    return with_tables(
        docs, text_col, ids_col, ids,
        pairs=(codec.pairs.maps, Lookup.KIND), head=(head_maps.maps, Lookup.KIND),
    )


def decode(rows: DataFrame, codec: Codec, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """The rows with the bytes that their ids stand for as a binary column; null ids give null."""
    pieces = (codec.pieces, pa.list_(pa.string()))
    return with_tables(rows, ids_col, bytes_col, lambda t, ids: codec.decode(ids, t["pieces"]), pieces=pieces)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The result of the query."""
    codec = Codec(read_ranks(path), pattern)
    rows = encode(docs.select("doc_id", "text"), codec).select("doc_id", "ids")
    return decode(rows, codec).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
