"""Files of token ids with Elias-Fano encoded document boundaries.

A file is a folder of shards in ascending id order. A shard is a sequence of blocks, each
a binary value of its own that can be read alone; Spark's Parquet writer holds them, so
they are committed once, on any store, whatever executors are lost. A block has

* a header: magic, width of an id in bytes, documents, documents without an id, first id;
* an Elias-Fano sequence of the document ends, and one of the document ids;
* the ids of its documents in a row, little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.wordbpe import encoder

MAGIC = b"TOKEF001"
#: Ids after which a block is closed (a longer document is a block of its own).
BLOCK_IDS = 250_000
#: Every so many values the select structure has the place of the value's bit.
SELECT_STEP = 128

_HEAD = struct.Struct("<8sBQQq")
_SEQUENCE = struct.Struct("<QBQQ")


def pack_sequence(values: np.ndarray) -> bytes:
    """Elias-Fano form of non-decreasing values from zero up.

    The lower bits of each value lie side by side; the upper bits are a bit set in which
    value i sets bit ``upper + i``. About 2 + log2(largest / count) bits a value.
    """
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lower = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    upper[places] = 1
    parts = [np.packbits(lower.astype(np.uint8).ravel(), bitorder="little"), np.packbits(upper, bitorder="little")]
    select = places[::SELECT_STEP].astype("<u4" if n == 0 or places[-1] < 2**32 else "<u8")
    head = _SEQUENCE.pack(n, low, len(parts[1]), select.itemsize)
    return b"".join([head, select.tobytes(), *(p.tobytes() for p in parts)])


class Sequence:
    """Reads an Elias-Fano sequence that begins at a place of a buffer."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.low, upper, width = _SEQUENCE.unpack_from(data, at)
        at += _SEQUENCE.size
        count = -(-self.n // SELECT_STEP)
        self.select_places = np.frombuffer(data, f"<u{width}", count, at)
        at += count * width
        size = -(-self.n * self.low // 8)
        self.lower = np.frombuffer(data, np.uint8, size, at)
        self.upper = np.frombuffer(data, np.uint8, upper, at + size)
        self.end = at + size + upper

    def _lower(self, first: int, count: int) -> np.ndarray:
        bits = np.arange(first * self.low, (first + count) * self.low)
        bits = (self.lower[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
        return (bits.reshape(count, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(
            axis=1, dtype=np.uint64
        )

    def __getitem__(self, i: int) -> int:
        """Value i: its bit is found from the nearest kept place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.select_places[i // SELECT_STEP])
        left, byte = i % SELECT_STEP, place >> 3
        ones = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 1], bitorder="little"))
        ones = ones[ones >= place & 7]
        while left >= len(ones):
            left -= len(ones)
            byte += 1
            ones = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 1], bitorder="little"))
        upper = byte * 8 + int(ones[left]) - i
        return (upper << self.low) | int(self._lower(i, 1)[0])

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))
        upper = (places - np.arange(self.n)).astype(np.uint64)
        return (upper << np.uint64(self.low)) | self._lower(0, self.n)


def pack_block(doc_ids: list[int | None], documents: list[np.ndarray], width: int) -> bytes:
    """One block; ``doc_ids`` ascend, those that are null come first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(d) for d in documents])
    ids = np.concatenate(documents).astype(f"<u{width}") if documents else np.zeros(0, f"<u{width}")
    head = _HEAD.pack(MAGIC, width, len(documents), len(documents) - len(known), first)
    gaps = known.view(np.uint64) - np.uint64(first % 2**64)
    return b"".join([head, pack_sequence(ends), pack_sequence(gaps), ids.tobytes()])


class Block:
    """Reads a block; documents are found through the boundaries alone."""

    def __init__(self, data: bytes):
        magic, width, self.n, nulls, first = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        self.ends = Sequence(data, _HEAD.size)
        gaps = Sequence(data, self.ends.end)
        known = (gaps.all() + np.uint64(first % 2**64)).view(np.int64)
        self.doc_ids = [None] * nulls + known.tolist()
        self.ids = np.frombuffer(data, f"<u{width}", -1, gaps.end)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]].astype("<u4")

    def bounds(self) -> list[int]:
        return [0, *self.ends.all().astype(np.int64).tolist()]


def write_token_file(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    width: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts and write them in ascending id order; ``end_id`` closes each document.

    One range shuffle of the texts; a shard is one range, written as it is encoded, a block
    in memory at a time. Null texts are empty documents, null ids come first, rows with one
    id follow each other (equal rows in any order). ``width`` is the bytes of an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "first_id", "n_docs", "n_ids", "payload"]
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        rows = ((i.as_py(), t.as_py()) for b in batches for i, t in zip(b.column(0), b.column(1)))
        doc_ids, documents, size = [], [], 0

        def close() -> pa.RecordBatch:
            values = [shard, block, first, len(doc_ids), size, pack_block(doc_ids, documents, width)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for doc_id, ids in encoder(tokenizer).stream(rows):
            if size and size + len(ids) + 1 > BLOCK_IDS:
                yield close()
                block, first = block + 1, first + size
                doc_ids, documents, size = [], [], 0
            if max(int(ids.max(initial=0)), end_id) >= 256**width:
                raise ValueError(f"ids need more than {width} bytes")
            doc_ids.append(doc_id)
            documents.append(np.append(ids, np.uint32(end_id)))
            size += len(ids) + 1
        if doc_ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    blocks = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "shard int, block int, first_id long, n_docs long, n_ids long, payload binary"
    )
    blocks.write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before. Only one total per shard is broadcast,
    of which there are as many as range partitions were written.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    before, starts = 0, []
    for shard, n in sorted(totals):
        starts.append((shard, before))
        before += n
    starts = spark.createDataFrame(starts, "shard int, shard_start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0), batch.column(1)):
                block = Block(payload.as_py())
                bounds = block.bounds()
                crc = [zlib.crc32(block.ids[a:b].astype("<u4")) for a, b in zip(bounds, bounds[1:])]
                at = np.array(bounds, np.int64)
                columns = [pa.array(block.doc_ids, pa.int64()), pa.array(at[:-1] + start.as_py()), pa.array(np.diff(at))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    placed = blocks.join(F.broadcast(starts), "shard").select(F.col("first_id") + F.col("shard_start"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
