"""Line dedup by content-defined chunks of lines, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.words import SPACES, indices
from paceline.operators.joins import free_names, join_lookup
from paceline.sources.scratch import pin

#: Columns of the work; a caller's columns of these names are set aside meanwhile.
WORKING = ("_id", "_key", "_text", "_gone", "_kept")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with ``_id``, ``_key`` (equal for equal texts) beside their own columns."""
    return docs.withColumns({"_id": F.col(id_col).cast("long"), "_key": F.xxhash64(F.col(text_col))})


def chunks(docs: DataFrame) -> DataFrame:
    """``_id, _key, start, size, before, after, hash`` of the chunk around every boundary.

    Lines with a word are taken two by two, with the lines without one between them. A
    rolling hash over the hashes of their lines chooses the boundaries: two lines in a row
    have one if their hash isn't greater than that of the two lines before or after (about
    two in three). So of three lines with a word that stand in two places, at least two are
    chosen in both, whatever is put in or taken out around them. ``before`` and ``after``
    are the distances to the next lines with a word, 0 if there are none.
    """
    rows = docs.select("_id", "_key", F.split("_text", "\n").alias("lines")).where("size(lines) > 1")
    full = F.transform("lines", lambda x, i: F.when(F.length(F.btrim(x, F.lit(SPACES))) > 0, i))
    rows = rows.select("_id", "_key", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.filter(full, lambda i: i.isNotNull()).alias("at"))
    pair = lambda k: F.xxhash64(F.slice("h", F.get("at", k) + 1, F.get("at", k + 1) - F.get("at", k) + 1))
    rows = rows.where("size(at) > 1").withColumn("r", F.transform(indices(F.lit(0), F.size("at") - 1), pair))
    least = lambda x, k: (F.size("r") == 1) | F.coalesce(x <= F.get("r", k - 1), F.lit(False)) | F.coalesce(x <= F.get("r", k + 1), F.lit(False))
    gap = lambda k: F.coalesce(F.get("at", k + 1) - F.get("at", k), F.lit(0))
    chosen = F.transform(
        "r",
        lambda x, k: F.when(
            least(x, k),
            F.struct(F.get("at", k).alias("start"), (gap(k) + 1).alias("size"), gap(k - 1).alias("before"), gap(k + 1).alias("after"), x.alias("hash")),
        ),
    )
    return rows.select("_id", "_key", F.inline(F.filter(chosen, lambda c: c.isNotNull())))


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with runs of lines taken out that stand earlier in the corpus, and two counts.

    The first place of a chunk is the one with the smallest (id, text hash, line); null ids
    come last. Hashes only name candidates: the bytes of a chunk are compared with those of
    the first one before it goes, and a chunk with another text under the same hash stays.
    At the ends of a run of chunks the next line with a word goes too if its bytes, with
    the lines between, equal those beside the first place, so a run goes whole. Every
    row comes back with its own columns, ``_lines`` and ``_removed`` (line counts); a null
    text stays null, a text that is a single line is never touched, equal rows are treated
    alike; columns of any other name are kept. Only hashes are counted and joined (few of them by broadcast, hot ones apart),
    and a chunk that a third of the rows hold is combined before the shuffle.
    """
    own = [c for c in docs.columns if c.lower() in WORKING]
    renamed = dict(zip(own, free_names([*docs.columns, *WORKING], own)))
    id_col, text_col = renamed.get(id_col, id_col), renamed.get(text_col, text_col)
    docs = _keyed(docs.withColumnsRenamed(renamed), id_col, text_col).withColumn("_text", F.col(text_col))
    # The lists per text are joined by sorting at every size; their size follows the input.
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "start")
    found = pin(chunks(docs))
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    again = join_lookup(found, pin(first.select("hash", "first")), {"hash": "hash"}, "inner")
    span = F.struct("start", "size", "before", "after", "hash", (place == F.col("first")).alias("is_first"))
    lists = again.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(span)).alias("spans")).hint("merge")
    spans = docs.select("_id", "_key", "_text").join(lists, _same_row(docs, lists)).select(docs["_id"], docs["_key"], "_text", "spans")
    lines = spans.select("_id", "_key", F.split("_text", "\n").alias("lines"), "spans")
    text = lambda start, size: F.array_join(F.slice("lines", start + 1, size), "\n")

    def piece(s: Column, j: Column) -> Column:
        end, near, far = s["start"] + s["size"], F.get("spans", j - 1), F.get("spans", j + 1)
        # A line beside it that another chunk takes along needs no comparison here.
        left = near.isNull() | near["is_first"] | (near["start"] + near["size"] <= s["start"])
        right = far.isNull() | far["is_first"] | (far["start"] >= end)
        return F.struct(
            s["start"].alias("start"),
            end.alias("end"),
            s["before"].alias("before"),
            s["after"].alias("after"),
            s["hash"].alias("hash"),
            s["is_first"].alias("is_first"),
            text(s["start"], s["size"]).alias("bytes"),
            F.when((s["before"] > 0) & (s["is_first"] | left), text(s["start"] - s["before"], s["before"])).alias("left"),
            F.when((s["after"] > 0) & (s["is_first"] | right), text(end, s["after"])).alias("right"),
        )

    pieces = lines.select("_id", "_key", F.inline(F.transform("spans", piece)))
    originals = pieces.where("is_first").groupBy("hash").agg(F.min(F.struct("bytes", "left", "right")).alias("original"))
    same = lambda side, lines: F.when(F.col(side) == F.col(f"original.{side}"), F.col(lines)).otherwise(0)
    gone = pieces.where("not is_first").join(originals, "hash").where("bytes = original.bytes")
    gone = gone.select("_id", "_key", (F.col("start") - same("left", "before")).alias("start"), (F.col("end") + same("right", "after")).alias("end"))
    gone = gone.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_gone")).hint("merge")
    out = docs.join(gone, _same_row(docs, gone), "left").drop(gone["_id"], gone["_key"])
    out = out.withColumn("_lines", F.split("_text", "\n"))
    # Sorted spans overlap or not, but both their starts and their ends ascend.
    begin = lambda j: F.when(j == 0, 0).otherwise(F.get("_gone", j - 1)["end"])
    stop = lambda j: F.coalesce(F.get("_gone", j)["start"], F.size("_lines"))
    kept = F.flatten(F.transform(indices(F.lit(0), F.size("_gone") + 1), lambda j: F.slice("_lines", begin(j) + 1, F.greatest(stop(j) - begin(j), F.lit(0)))))
    out = out.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    out = out.withColumns(
        {
            text_col: F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")),
            "_removed": F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long"),
            "_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"),
        }
    )
    return out.drop(*WORKING).withColumnsRenamed({v: k for k, v in renamed.items()})


def _same_row(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_key"] == b["_key"])


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query: lines, lines removed and the hash of what is kept."""
    rows = drop_repeated_chunks(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
