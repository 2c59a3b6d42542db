"""Personal data: fixed kinds by pattern, and terms that disclose them by co-occurrence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.words import indices
from paceline.operators.joins import free_names
from paceline.sources.scratch import pin

# The patterns of the contract. Runs are possessive and begin where a run begins (or the last
# match ended): the same matches, but no run is tried again from each of its characters.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPANS = "array<struct<start:int,end:int,value:string>>"
#: Code points of a section of a text; a context is shorter.
SECTION = 4096
#: Characters before and after a protected span that count as its context.
CONTEXT = 80
#: Different contexts in which a term must stand beside an entity, and the share of the
#: entity's information content that the term must give away.
SUPPORT, DISCLOSURE = 3, 0.9
TERM = "term"
#: Terms are words without the marks around them: letters and digits are what bounds a term.
_INNER = r"\p{L}\p{M}\p{N}"
_SPACE = r"\x20\x09-\x0D"
#: What separates terms: a run of other characters with white space in it, or at an end of the
#: text. A run is tried from its first character only.
_BETWEEN = rf"(?<![^{_INNER}])(?:(?<=^)[^{_INNER}]++|(?=[^{_INNER}{_SPACE}]*+(?:[{_SPACE}]|\z))[^{_INNER}]++)"


def terms_of(text: Column) -> Column:
    """The terms of a text in lower case, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Of each number what those before it come to by ``join`` (a sum or maximum, from zero), and of all at the end.

    In two levels, as a list that grows is copied with every step: inside parts of about the
    square root of the length, then over the parts.
    """
    zero = F.array(F.lit(0))

    def grown(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), x))))

    def cut(values: Column) -> Column:
        def by(size: Column) -> Column:
            parts = indices(F.lit(0), F.ceil(F.size(values) / size).cast("int"))
            return F.transform(parts, lambda k: grown(F.slice(values, k * size + 1, size)))

        return _named(F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(8)), by)

    def placed(parts: Column) -> Column:
        def joined(starts: Column) -> Column:
            own = F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda p, s: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: join(s, x)))
            return F.concat(F.flatten(own), F.array(F.element_at(starts, -1)))

        return _named(grown(F.transform(parts, lambda p: F.element_at(p, -1))), joined)

    return _named(_named(values, cut), placed)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _sections(text: Column) -> Column:
    """A text in sections of ``SECTION`` code points, so that a place in it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SECTION}}}"), F.lit(0))


def _cut(sections: Column, start: Column, end: Column) -> Column:
    """The text from one place to another."""
    first = F.floor(start / SECTION).cast("int")
    held = F.array_join(F.slice(sections, first + 1, F.floor(end / SECTION).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(held, start - first * SECTION + 1, end - start)).otherwise("")


def _replaced(text: Column, spans: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """The text with ``mark(span, at)`` for each of the sorted spans, which may overlap; the text is done up to ``at``."""

    def with_sections(sections: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            piece = lambda s, i: F.concat(_cut(sections, F.get(ends, i), s["start"]), mark(s, F.get(ends, i)))
            last = _cut(sections, F.element_at(ends, -1), F.length(text))
            return F.concat(F.array_join(F.transform(spans, piece), ""), last)

        return _named(_before(F.transform(spans, lambda s: s["end"]), F.greatest), with_ends)

    return _named(_sections(text), with_sections)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with a line end for each character of the spans, which may overlap."""
    gone = lambda s, at: F.repeat(F.lit("\n"), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))
    return _named(F.array_sort(spans), lambda ordered: _replaced(text, ordered, gone))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d: d.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["value"])


def find(text: Column, pattern: str | Column) -> Column:
    """Start, end (code points) and value of the matches, leftmost first, none overlapping."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), lambda gap: F.length(gap))

    def placed(both: Column) -> Column:
        def spans(ends: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = F.get(ends, i) + x["gap"]
                return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("value"))

            return F.transform(both, span)

        return _named(_before(F.transform(both, lambda x: x["gap"] + F.length(x["hit"])), lambda a, b: a + b), spans)

    both = F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.when(F.size(hits) > 0, _named(both, placed)).otherwise(F.array().cast(_SPANS))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, email, ip, card, phone`` (lists of spans) and ``beside``: the terms near each span."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({k: find(F.col("text"), p) for k, p in PATTERNS.items()})
    rows = rows.withColumns({k: F.filter(k, _checked(k)) for k in PATTERNS})
    # No base span is part of a context, the others as little as the one it surrounds.
    every = F.concat(*PATTERNS)
    rows = rows.withColumn("around", F.when(F.size(every) > 0, _sections(_blanked(F.col("text"), every))))

    def near(kind: str) -> Column:
        def one(span: Column) -> Column:
            begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
            sides = F.concat(
                _cut(F.col("around"), begin, span["start"]), F.lit("\n"), _cut(F.col("around"), span["end"], span["end"] + CONTEXT)
            )
            terms = F.filter(terms_of(sides), lambda w: F.length(w) > 2)
            return F.struct(F.concat(F.lit(f"{kind}:"), span["value"]).alias("entity"), F.array_distinct(terms).alias("terms"))

        return F.transform(kind, one)

    return rows.withColumn("beside", F.concat(*[near(k) for k in PATTERNS])).drop("text", "around")


def disclosing_terms(base: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``entity, term`` where the term gives the entity away.

    Of an entity e that 2^-IC of all rows hold, a term t that stands beside it discloses
    PMI(e; t) = IC(e) + log2 P(e | t), where P(e | t) is the share of the rows with t that have
    it beside e. All counts are of rows, and a row counts once however often it holds the pair.
    The pair counts from a share of IC(e) on, and from a number of documents with different
    contexts on: of a document one context counts, so neither copies of a text nor an
    address said three times in one prove anything. Term frequencies are of all rows and
    whole texts; everything is counted per key before it is shuffled.
    """
    total = docs.count()
    same = base.where(F.size("beside") > 0).groupBy("doc_id", "key").agg(F.first("beside").alias("beside"), F.count(F.lit(1)).alias("m"))
    seen = same.select("doc_id", "key", "m", F.inline("beside"))
    held = seen.select("entity", "doc_id", "key", "m").distinct().groupBy("entity").agg(F.sum("m").alias("rows"))
    pairs = seen.select("entity", "doc_id", "key", "m", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term", "doc_id", "key").agg(F.min("context").alias("context"), F.first("m").alias("m"))
    # Documents with one context are one: their rows are summed before contexts are counted.
    pairs = pairs.groupBy("entity", "term", "context").agg(F.sum("m").alias("m"))
    beside = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("m").alias("both"))
    beside = pin(beside.where(F.col("contexts") >= SUPPORT))
    every = docs.select(F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("all"))
    known = beside.join(every, "term").join(held, "entity")
    information = -F.log2(F.col("rows") / F.lit(float(max(total, 1))))
    pmi = information + F.log2(F.col("both") / F.col("all"))
    return known.where((information > 0) & (pmi >= DISCLOSURE * information)).select("entity", "term")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key`` and the spans of each kind: the base kinds and ``term``.

    Disclosing terms are marked in documents that hold the entity they disclose, in any
    case, between characters that are no letters and no digits, where they don't touch a base span. A null text is empty; null ids,
    repeated ids and rows are rows like any other (terms go by id and text); an empty table
    stays empty. Long runs of digits or letters take time in proportion.
    """
    base = pin(base_spans(docs, id_col, text_col))
    terms = disclosing_terms(base, docs, text_col)
    holders = base.select("doc_id", "key", F.explode("beside.entity").alias("entity")).join(terms, "entity")
    holders = pin(holders.groupBy("doc_id", "key").agg(F.collect_set("term").alias("terms")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    texts = texts.join(holders, same(texts, holders)).select(texts["doc_id"], texts["key"], "text", "terms")
    edge = lambda side: f"(?{side}[{_INNER}])"
    whole = lambda t: F.concat(F.lit(f"(?iu){edge('<!')}\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E{edge('!')}"))
    texts = texts.select("doc_id", "key", F.explode("terms").alias("t"), "text")
    texts = texts.select("doc_id", "key", F.inline(find(F.col("text"), whole(F.col("t")))))
    marked = texts.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "end", "value"))).alias(TERM))
    out = base.join(marked, same(base, marked), "left").drop(marked["doc_id"], marked["key"], "beside")
    free = lambda s: ~F.exists(F.concat(*PATTERNS), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return out.withColumn(TERM, F.coalesce(F.filter(TERM, free), F.array().cast(_SPANS)))


def _mark(kind: str) -> Callable[[Column], Column]:
    mark = F.lit("" if kind == TERM else f"<{kind}>").alias("mark")
    return lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end"), mark)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every span generalised to its kind, as in ``<email>``; terms are removed."""
    marks = F.array_sort(F.concat(*[F.transform(k, _mark(k)) for k in [*PATTERNS, TERM]]))
    found = spans(docs, id_col, text_col)
    id_, key, hit, k = free_names(docs.columns, ["id", "key", "spans", "k"])
    found = found.select(F.col("doc_id").alias(id_), F.col("key").alias(key), marks.alias(hit))
    found = found.where(F.size(hit) > 0).dropDuplicates([id_, key]).hint("merge")
    rows = docs.withColumn(k, F.xxhash64(text_col))
    rows = rows.join(found, rows[id_col].eqNullSafe(found[id_]) & (rows[k] == found[key]), "left")
    mark = lambda s, at: F.when(s["start"] >= at, s["mark"]).otherwise("")  # noqa: E731  else it overlaps what is marked
    done = _replaced(F.col(text_col), F.col(hit), mark)
    out = rows.withColumn(text_col, F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(done))
    return out.drop(k, id_, key, hit)


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query."""
    rows = spans(docs)
    named = lambda kind: lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])
    listed = lambda kinds: F.array_join(F.concat(*[F.transform(k, named(k)) for k in kinds]), ",")
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(listed(PATTERNS), 256).alias("base_sha256"),
        listed([*PATTERNS, TERM]).alias("spans"),
        F.size(TERM).cast("long").alias("n_term"),
    )
