"""Near copies of texts: wide SimHash links inside tiles of shared minima, verified by exact Jaccard.

At a similarity of 0.8 two 64-bit fingerprints differ in about 10 bits, and tiles by
population counts alone rule out next to nothing that far apart. So a row first goes to the
tiles named by hashes of its minima over the shingles (rows that similar share a tile almost
surely); inside a tile fingerprints of 512 bits are compared by exclusive-or and bit counts,
blocks whose population counts differ beyond the radius are skipped, and what is found is
compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.graph import components
from paceline.llm.simhash import hashed_shingles, simhash
from paceline.operators.joins import join_lookup
from paceline.sources.scratch import pin

SHINGLE, SIMILARITY = 5, 0.8
#: Tiles of a row, and the minima that name one: two rows of similarity 0.8 share a tile with probability 0.998.
TILES, MINIMA = 16, 5
#: Words of 64 bits in a fingerprint.
WORDS = 8
#: At a similarity of 0.8 the bits differ by 78 on average with a deviation of 8; this is three deviations more.
RADIUS = 102
#: Partners of a row in a tile that are compared exactly at once, the nearest first; as long as there
#: are more in other groups, so many times as many follow.
PARTNERS, MORE = 4, 16
#: Rows of a tile beyond which it is cut into chunks that meet pairwise.
CHUNK = 4096
#: Bytes of the sets in a tile beyond which it is cut likewise before they are compared.
SET_BYTES = 1 << 24
#: Cells of a matrix of differing bits.
CELLS = 1 << 21
#: Rows that a task gathers before it hands them on.
HELD = 1 << 18
#: Differing bits of rows that need no comparison.
APART = 64 * WORDS + 1
_RANDOM = np.random.default_rng(20).integers(0, 2**64, (2, TILES * MINIMA), dtype=np.uint64)
_SALTS = np.random.default_rng(21).integers(0, 2**64, WORDS, dtype=np.uint64)
_ROWS = "id long, fp binary, same binary, keys array<long>"


def tile_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each tile of a set of shingle hashes."""
    least = np.full(TILES * MINIMA, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        mixed = (hashes[i : i + 2048, None] ^ _RANDOM[0]) * (_RANDOM[1] | np.uint64(1))
        np.minimum(least, mixed.min(axis=0), out=least)
    key = np.arange(TILES, dtype=np.uint64)
    for minimum in least.reshape(TILES, MINIMA).T:
        key = (key ^ minimum) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of ``WORDS`` words over a set of shingle hashes, each word from another mixing of them."""
    words = []
    for salt in _SALTS:
        mixed = (hashes ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        words.append(simhash(mixed ^ (mixed >> np.uint64(29))))
    return np.array(words, "<i8").tobytes()


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each row: fingerprint, digest of its set of shingles, and its tiles; no tiles without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, same, keys = [], [], []
            for text in batch.column(1):
                distinct = np.unique(hashed_shingles(text.as_py(), SHINGLE))
                fps.append(wide_fingerprint(distinct))
                same.append(xxhash.xxh128_digest(distinct.tobytes()))
                keys.append(tile_keys(distinct) if len(distinct) else [])
            columns = [pa.array(fps, pa.binary()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "fp", "same", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _ROWS)


def _blocks(fps: np.ndarray, node: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
    """Places of some rows, places of those that may lie within the radius, and the bits in which they differ.

    Bits of two rows of one group count as more than there are. Rows are ordered by population
    counts, and blocks beyond the radius are skipped.
    """
    fp = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS)
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.lexsort((node, ones))
    fp, group, ones = fp[order], group[order], ones[order]
    step = max(1, CELLS // len(fp))
    for i in range(0, len(fp), step):
        rows = slice(i, min(i + step, len(fp)))
        lo = np.searchsorted(ones, ones[i] - RADIUS, "left")
        hi = np.searchsorted(ones, ones[rows.stop - 1] + RADIUS, "right")
        apart = np.zeros((rows.stop - i, hi - lo), np.uint16)
        for word in fp.T:
            apart += np.bitwise_count(word[rows, None] ^ word[None, lo:hi])
        apart[group[None, lo:hi] == group[rows, None]] = APART
        yield order[rows], order[lo:hi], apart


def _nearest(node: np.ndarray, fp: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Of each row the nearest one of a smaller node (of equally near ones the last) and, the
    other way round, the nearest one of a larger node: node, partner, bits."""
    for left, right, apart in _blocks(fp, node, node):
        left, right = node[left], node[right]
        larger, rows = right > left[:, None], np.arange(len(left))
        for cells, turned in ((np.where(larger, APART, apart), False), (np.where(larger, apart, APART), True)):
            at = cells.shape[1] - 1 - cells[:, ::-1].argmin(axis=1)
            bits = cells[rows, at]
            near = bits <= RADIUS
            ends = [left[near], right[at[near]]]
            yield [*(ends[::-1] if turned else ends), bits[near]]


def _undecided(node: np.ndarray, fp: np.ndarray, same: np.ndarray, of: np.ndarray, tile: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The rows that have one of another group within the radius."""
    for left, _, apart in _blocks(fp, node, of):
        found = left[(apart <= RADIUS).any(axis=1)]
        yield [x[found] for x in (tile, node, fp, same, of)]


def _forest(node: np.ndarray, fp: np.ndarray, of: np.ndarray, shingles: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Links that join the groups as all rows of the similarity within the radius do, less than there are rows.

    Each two rows within the radius are compared by their sets once, unless links found
    before have joined their groups.
    """
    sizes = np.array([len(x) // 8 for x in shingles])
    _, code, count = np.unique(np.frombuffer(b"".join(shingles), np.uint64), return_inverse=True, return_counts=True)
    common = count[code] > 1
    ends = np.concatenate([[0], np.cumsum(common)])[np.cumsum(sizes)]
    code, starts = code[common], np.concatenate([[0], ends[:-1]])
    own = np.zeros(len(count), bool)

    def similar(row: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have the similarity with the row."""
        own[code[starts[row] : ends[row]]] = True
        to = np.cumsum(ends[others] - starts[others])
        first = np.concatenate([[0], to[:-1]])
        places = np.arange(to[-1]) + np.repeat(starts[others] - first, to - first)
        met = np.concatenate([[0], np.cumsum(own[code[places]])])
        own[code[starts[row] : ends[row]]] = False
        both = met[to] - met[first]
        return both / (sizes[row] + sizes[others] - both) >= SIMILARITY

    _, label = np.unique(of, return_inverse=True)
    for left, right, apart in _blocks(fp, node, of):
        links = []
        for row, bits in zip(left, apart):
            at = np.flatnonzero((bits <= RADIUS) & (right > row))
            rest, most = right[at[np.argsort(bits[at], kind="stable")]], PARTNERS
            rest = rest[np.minimum(sizes[rest], sizes[row]) / np.maximum(sizes[rest], sizes[row]) >= SIMILARITY]
            while len(rest := rest[label[rest] != label[row]]):
                tried, rest, most = rest[:most], rest[most:], most * MORE
                for other in tried[similar(row, tried)]:
                    if label[other] != label[row]:
                        links.append((node[row], node[other]))
                        label[label == label[other]] = label[row]
        yield list(np.array(links, np.int64).reshape(-1, 2).T)


def _in_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of the tiles listed in ``tile, chunks``; where there are several chunks, these meet in pairs, each pair in a tile of its own."""
    rows, columns = join_lookup(rows, chunks, {"tile": "tile"}, "inner"), [c for c in rows.columns if c != "tile"]
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("tile", "node"), F.col("chunks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk"))
    to = F.when(F.col("chunks") > 1, others).otherwise(F.array(F.lit(0)))
    pair = F.xxhash64("tile", F.least("chunk", "to"), F.greatest("chunk", "to"))
    tile = F.when(F.col("chunks") > 1, pair).otherwise(F.col("tile")).alias("tile")
    return rows.select("*", F.explode(to).alias("to")).select(tile, *columns)


def _tiles(classes: DataFrame) -> DataFrame:
    """``tile, node, fp, same``: each node in every tile that it shares, chunks of a full tile in pairs."""
    rows = classes.select(F.explode("keys").alias("tile"), "node", "fp", "same")
    shared = rows.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1")
    return _in_chunks(rows, pin(shared.select("tile", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))))


def _by_tile(rows: DataFrame, columns: list[str], found: Callable[..., Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """What ``found`` yields, column by column, for these columns of the rows of each tile that has several."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    kinds = [{"long": pa.int64(), "binary": pa.binary()}[kind] for kind in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, out, held = None, [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                part = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
                rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            if rest is None or not len(rest[0]):
                continue
            tile = rest[0]
            cuts = np.flatnonzero(np.diff(tile)) + 1
            last = len(tile) if batch is None else (cuts[-1] if len(cuts) else 0)
            bounds = np.array([0, *cuts[cuts < last], last])
            several = np.flatnonzero(np.diff(bounds) > 1)
            for lo, hi in zip(bounds[several], bounds[several + 1]):
                for table in found(*(x[lo:hi] for x in rest[1:])):
                    out.append(table)
                    held += len(table[0])
                    if held >= HELD or len(out) >= HELD // 64:
                        yield as_batch(out)
                        out, held = [], 0
            rest = [x[last:] for x in rest]
        if out:
            yield as_batch(out)

    def as_batch(tables: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*tables), kinds)], names)

    dealt = rows.select(F.col("tile").alias("in_tile"), *columns).repartition("in_tile").sortWithinPartitions("in_tile")
    return dealt.mapInArrow(run, schema)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, same, bytes, shingles``: the distinct shingle hashes, ascending, of the rows whose id is listed, their digest and size; each set of an id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashed_shingles(t.as_py(), SHINGLE)).tobytes() for t in batch.column(1)]
            same = [xxhash.xxh128_digest(x) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(sets, pa.binary())], ["id", "same", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    sets = rows.mapInArrow(run, "id long, same binary, shingles binary").groupBy("id", "same").agg(F.first("shingles").alias("shingles"))
    return sets.select("id", "same", F.octet_length("shingles").alias("bytes"), "shingles")


def _linked(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links between groups, found in each tile of ``tile, node, fp, same, of``; their number is below that of the rows."""
    open_rows = pin(_by_tile(tiles, ["node", "fp", "same", "of", "tile"], _undecided, "tile long, node long, fp binary, same binary, of long"))
    sets = sets.withColumnRenamed("id", "node")
    full = open_rows.join(sets.select("node", "same", "bytes"), ["node", "same"]).groupBy("tile").agg(F.sum("bytes").alias("bytes"))
    chunks = pin(full.select("tile", F.ceil(F.col("bytes") / SET_BYTES).cast("int").alias("chunks")))
    rows = _in_chunks(open_rows, chunks).join(sets.drop("bytes"), ["node", "same"])
    return _by_tile(rows, ["node", "fp", "of", "shingles"], _forest, "a long, b long")


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    """Similarity of two sets of distinct values."""
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    both = np.intersect1d(left, right, assume_unique=True).size
    return both / (len(left) + len(right) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (2, 3)]
            similar = pa.array([jaccard(x, y) >= SIMILARITY for x, y in zip(*sides)], pa.bool_())
            yield batch.select(["a", "b"]).filter(similar)

    first = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, component`` of the rows with an id: the smallest id among the texts reached by near copies.

    Texts with one set of lower-cased (A-Z) five-word shingles are one node; a text of fewer
    words is one shingle, and texts without a word (null is one) are alike. Two nodes are
    linked where the Jaccard similarity of both sets is at least ``SIMILARITY``. First the
    nearest smaller node over all tiles is verified, which joins most of a group. Then the
    nodes that have others of another group within ``RADIUS`` go to their tiles again,
    with their sets, where all such pairs are compared and only the links that join groups
    are returned, so what is returned grows with the rows of the tiles and not with their
    pairs. No link below the similarity is made; one is missed where no tile is shared or
    where the bits differ by more than ``RADIUS``. Rows that repeat an id share its group;
    an empty table gives an empty result; other columns are not read.
    """
    rows = pin(_sketches(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    classes = pin(rows.groupBy("same").agg(F.min("id").alias("node"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    tiles = pin(_tiles(classes))
    near = _by_tile(tiles, ["node", "fp"], _nearest, "b long, a long, bits long")
    pairs = pin(near.groupBy("b", "a").agg(F.min("bits").alias("bits")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = pin(_sets(docs, ends, id_col, text_col))
    nearest = pairs.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a"))
    links = pin(_verified(nearest, sets))
    group = pin(components(links, "a", "b").select("node", F.col("component").alias("of")))
    grouped = tiles.join(ends.select(F.col("id").alias("node")), "node", "left_semi").join(group, "node", "left")
    links = links.unionByName(pin(_linked(grouped.withColumn("of", F.coalesce("of", "node")), sets)))
    found = components(links.unionByName(_repeated(rows, classes)), "a", "b")
    of_class = classes.join(found, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    return rows.select("id", "same").join(of_class, "same").select("id", "component")


def _repeated(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the nodes of the texts that one repeated id has."""
    several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    nodes = rows.join(several, "id", "left_semi").select("id", "same").distinct().join(classes.select("same", "node"), "same")
    return nodes.groupBy("id").agg(F.min("node").alias("a")).join(nodes.select("id", F.col("node").alias("b")), "id").select("a", "b")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its group (see ``near_copies``), with their own columns; rows without an id stay."""
    gone = near_copies(docs, id_col, text_col).where("id != component").select("id").distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["id"], "left_anti")
