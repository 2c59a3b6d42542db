"""Substring dedup by winnowing of word k-mers.

This stands in for the compaction of a De Bruijn graph: there are no edge table, degrees or
joins along paths, and anchors take the place of nodes. Of each window of ``window`` words the k-mer with the smallest
hash is its anchor, so equal windows have the same anchor at the same place. The windows of
one anchor that follow each other in a document are a *path*; its text reaches from its
first window to its last. Where an anchor has the same path everywhere, the path does not
branch and is one row, whatever number of windows and documents it has. Only where the paths
of an anchor differ are their windows looked at one by one, and each path once, not each
place where it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.sources.scratch import pin

WINDOW, KMER = 50, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Windows whose anchors are found at once.
BLOCK = 1 << 15


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _kmer_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A hash of every k words in a row, mixed so that its order is arbitrary."""
    digest = xxhash.xxh64_intdigest
    each = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _ODD + each[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each path: first window, number of windows, hash of the anchor."""
    hashes = _kmer_hashes(words, k)
    span, n = window - k + 1, len(words) - window + 1
    place = np.empty(n, np.int64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        view = np.lib.stride_tricks.sliding_window_view(hashes[lo : hi + span - 1], span)
        place[lo:hi] = np.argmin(view, axis=1) + np.arange(lo, hi)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, np.diff(first, append=n), hashes[place[first]]


def _digest(words: list[bytes]) -> bytes:
    """128 bits over the bytes of words; blanks can't be part of a word."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def paths(docs: DataFrame, window: int, k: int) -> DataFrame:
    """``id, key, first, n, anchor, path`` of all paths of the whole texts."""
    kinds = "id long, key long, first int, n int, anchor long, path binary"
    names = ["id", "key", "first", "n", "anchor", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = _words(text.as_py())
                if len(words) < window:
                    continue
                first, n, anchor = anchors(words, window, k)
                text_of = [_digest(words[a : a + b + window - 1]) for a, b in zip(first.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(doc_id, len(first)),
                        pa.repeat(key, len(first)),
                        pa.array(first, pa.int32()),
                        pa.array(n, pa.int32()),
                        pa.array(anchor.view(np.int64)),
                        pa.array(text_of, pa.binary()),
                    ],
                    names,
                )

    return docs.where("_id is not null").select("_id", "_key", "_text").mapInArrow(run, kinds)


def _branch_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``path, offset, owner, digest`` of each window of the wanted paths, from where they stand first."""
    lists = wanted.groupBy("owner", "key").agg(F.collect_list(F.struct("first", "n", "path")).alias("wanted"))
    source = docs.where("_id is not null").join(lists, (docs["_id"] == lists["owner"]) & (docs["_key"] == lists["key"]))
    source = source.select("owner", "_text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, text, spans in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = _words(text.as_py())
                for span in spans.as_py():
                    n, at = span["n"], span["first"]
                    digests = [_digest(words[at + i : at + i + window]) for i in range(n)]
                    columns = [pa.array([span["path"]] * n, pa.binary()), pa.array(range(n), pa.int32())]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.repeat(owner, n), pa.array(digests, pa.binary())], ["path", "offset", "owner", "digest"]
                    )

    return source.mapInArrow(run, "path binary, offset int, owner long, digest binary")


def covered_spans(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """``id, key, spans``: word ranges ``(start, stop)`` of a text that repeat a smaller id.

    ``docs`` has ``_id, _key, _text``. Identity is that of 128-bit digests of the bytes at
    the source coordinates, never of the hash that chose the anchors.
    """
    every = pin(paths(docs, window, k))
    place = F.struct("id", "key", "first", "n")
    each = every.groupBy("anchor", "path").agg(F.min(place).alias("at"), F.max("id").alias("last"))
    each = each.select("anchor", "path", "at.*", "last").withColumnRenamed("id", "owner")
    shape = each.groupBy("anchor").agg(F.count("*").alias("paths"), F.min("owner").alias("low"), F.max("last").alias("high"))
    # Paths of anchors that more than one document has; the others repeat nothing.
    shared = shape.where("low < high").select("anchor", "paths")
    shared = pin(each.join(shared, "anchor"))
    windows = pin(_branch_windows(docs, shared.where("paths > 1").select("owner", "key", "first", "n", "path"), window))
    owners = windows.groupBy("digest").agg(F.min("owner").alias("least"), F.count("*").alias("m")).where("m > 1")
    better = windows.join(owners, "digest").where("least < owner").groupBy("path").agg(
        F.sort_array(F.collect_set(F.struct("offset", "least"))).alias("windows")
    )
    table = shared.select("path", "owner", "last").join(better, "path", "left")
    table = table.where("last > owner or windows is not null").select("path", "owner", "windows")
    found = every.join(table, "path").where("id > owner or windows is not null")
    inner = F.filter("windows", lambda w: w["least"] < F.col("id"))
    # A path that stands in a smaller document goes as a whole; else its windows decide.
    spans = F.when(
        F.col("id") > F.col("owner"),
        F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("n") + (window - 1)).alias("stop"))),
    ).otherwise(
        F.transform(
            inner,
            lambda w: F.struct(
                (F.col("first") + w["offset"]).alias("start"), (F.col("first") + w["offset"] + window).alias("stop")
            ),
        )
    )
    return found.select("id", "key", F.inline(spans)).groupBy("id", "key").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")
    )


def drop_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = KMER
) -> DataFrame:
    """``id, n_words, n_removed, kept`` (the kept words, joined by a blank) of every row.

    Windows are judged on the input. Equal ids never repeat each other; a null id is kept
    whole and is no source; a null text has no words; equal rows get equal results; an
    empty table gives an empty one. A passage in a third of all documents is one path (and
    some branching ones at its ends), combined before the shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    spans = covered_spans(rows, window, k)
    rows = rows.join(spans, (rows["_id"] == spans["id"]) & (rows["_key"] == spans["key"]), "left")
    rows = rows.select("_id", "_text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = _words(text.as_py())
                counts.append(len(words))
                parts, at, gone = [], 0, 0
                for start, stop in zip(*_bounds(spans)):
                    if start > at:
                        parts += words[at:start]
                    if stop > at:
                        gone += stop - max(at, start)
                        at = stop
                removed.append(gone)
                kept.append(b" ".join(parts + words[at:]).decode() if gone else b" ".join(words).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept string")


def _bounds(spans: pa.ListScalar) -> tuple[list[int], list[int]]:
    if not spans.is_valid:
        return [], []
    return spans.values.field("start").to_pylist(), spans.values.field("stop").to_pylist()


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query."""
    return drop_repeated_words(docs).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = r"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), starts as (
    select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as s from words
), windows as (
    select doc_id, s, min(doc_id) over (partition by array_to_string(w[s:s + 49], ' ')) as least from starts
), gone as (
    select distinct doc_id, unnest(range(s, s + 50)) as i from windows where least < doc_id
), lists as (
    select doc_id, list(i) as gone from gone group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
    sha256(array_to_string(
        case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from words left join lists using (doc_id)
"""
