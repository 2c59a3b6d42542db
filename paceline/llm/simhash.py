"""SimHash fingerprints and their tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.graph import components
from paceline.sources.scratch import pin

#: Bits of a fingerprint that make one population count of its tile.
PART_BITS = 16
#: Distinct fingerprints for which the fullest tile still has a few thousand rows (0.15 % of all).
ROWS_PER_CHUNK = 4_000_000
#: Fingerprints compared with a tile at once.
BLOCK = 1024


def hashed_shingles(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) word shingles, repeats included; of fewer words the whole sequence, none without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, seed) for p in parts], dtype="<u8")


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles; zero for a text without words."""
    return simhash(hashed_shingles(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp`` (signed 64-bit) of each row. A null text has no words, so its fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _tile(fp: str):
    """Population counts of the four parts of a fingerprint, five bits each with room below."""
    part = lambda i: F.bit_count(F.shiftrightunsigned(fp, PART_BITS * i).bitwiseAND(0xFFFF)) + 4
    return sum((part(i).cast("long") * 32**i for i in range(1, 4)), part(0).cast("long"))


def _neighbours(radius: int) -> list[int]:
    """Offsets from a tile to itself and to half of the tiles whose counts differ by at most the radius."""
    steps = (d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius)
    return sorted(off for d in steps if (off := sum(x * 32**i for i, x in enumerate(d))) >= 0)


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[0]], label[pairs[1]])
        before = label.copy()
        np.minimum.at(label, pairs[0], low)
        np.minimum.at(label, pairs[1], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links(fp: np.ndarray, base: np.ndarray, radius: int) -> np.ndarray:
    """Star edges (two index rows) that connect whatever lies within the radius in one tile."""
    inside, found = fp[base], np.empty((2, 0), np.int64)
    at = np.flatnonzero(base)
    for i in range(0, len(fp), BLOCK):
        near = np.bitwise_count(fp[i : i + BLOCK, None] ^ inside[None, :]) <= radius
        left, right = np.nonzero(near)
        more = np.stack([left + i, at[right]])
        more = more[:, more[0] != more[1]]
        if more.shape[1]:
            found = np.concatenate([found, more], axis=1)
            if found.shape[1] > len(fp):  # keep a forest, not the pairs
                label = _forest(found, len(fp))
                found = np.stack([np.arange(len(fp)), label])[:, label != np.arange(len(fp))]
    return found


def near_edges(classes: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b``: edges that connect all fingerprints within ``radius`` bits.

    ``classes`` has distinct ``fp`` and their ``node``. Two fingerprints within the radius
    have population counts within it, also when the counts are taken of four parts and the
    differences added; so each tile (one combination of counts) meets only the tiles around
    it, each pair of tiles once. Full tiles are cut into chunks by the number of rows, and
    chunks meet each other. Tiles return star edges, never their pairs.
    """
    chunks = 1 + classes.count() // ROWS_PER_CHUNK
    offsets = F.array(*[F.lit(x).cast("long") for x in _neighbours(radius)])
    rows = (
        classes.select("fp", "node", _tile("fp").alias("own"), F.pmod(F.xxhash64("fp"), F.lit(chunks)).alias("chunk"))
        .select("fp", "node", "own", "chunk", F.explode(offsets).alias("step"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("to"))
        .where("step != 0 or to >= chunk")
        .select(
            ((F.col("own") + F.col("step")) * chunks + F.col("to")).alias("tile"),
            ((F.col("step") == 0) & (F.col("to") == F.col("chunk"))).alias("base"),
            "fp",
            "node",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            if rest is None or not len(rest[0]):
                continue
            tile = rest[0]
            cuts = np.flatnonzero(np.diff(tile)) + 1
            last = len(tile) if batch is None else (cuts[-1] if len(cuts) else 0)
            bounds = [0, *cuts[cuts < last].tolist(), last] if last else [0]
            for lo, hi in zip(bounds, bounds[1:]):
                if hi - lo < 2 or not rest[1][lo:hi].any():
                    continue
                edges = _links(rest[2][lo:hi].view(np.uint64), rest[1][lo:hi], radius)
                if edges.shape[1]:
                    node = rest[3][lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array(node[edges[0]]), pa.array(node[edges[1]])], ["a", "b"])
            rest = [x[last:] for x in rest]

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``id, fp, component``: one row per input row with the smallest id it is linked to.

    Rows with one fingerprint are one node, so copies meet no more than once. A null id is
    returned with a null component and links nothing; repeated rows and repeated ids share
    their component; an empty table gives an empty result; other columns are not read.
    """
    rows = pin(fingerprints(docs, id_col, text_col, shingle))
    classes = pin(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    found = components(near_edges(classes, radius), "a", "b")
    of_class = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = rows.join(of_class, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows whose id is the smallest of its group, with their own columns; rows without an id stay."""
    keep = near_classes(docs, id_col, text_col, shingle, radius).where("id != component").select("id").distinct()
    return docs.join(keep, docs[id_col].cast("long") == keep["id"], "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query: doc_id, fingerprint in hex, component."""
    rows = near_classes(docs.select("doc_id", "text"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
