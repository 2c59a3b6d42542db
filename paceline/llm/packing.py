"""Pattern packing of token pieces into sequences by non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.wordbpe import encoder
from paceline.operators.ordered import global_index
from paceline.sources.scratch import pin

#: Patterns are made of lengths rounded up to ``capacity / UNITS`` tokens.
UNITS = 512
ROUNDS = 400


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 4096,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each whole document.

    ``end_id`` closes a document; only documents above the capacity are cut. A null text is
    an empty document, which has its end id alone; a null id stays null.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc_id, ids in encoder(tokenizer).stream(zip(batch.column(0).to_pylist(), map(_text, batch.column(1)))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, value in zip(columns, (doc_id, piece, start, len(part), zlib.crc32(part), part)):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, kinds)


def _text(value: pa.Scalar) -> str | None:
    return value.as_py()


def patterns(units: int, used: np.ndarray) -> np.ndarray:
    """All ways to fill ``units`` with one, two or three used sizes; a row each, zero for none."""
    sizes = np.flatnonzero(used[1:]) + 1
    rows = [np.array([[units, 0, 0]])] if used[units] else []
    for a in sizes[sizes * 2 <= units]:
        if used[units - a]:
            rows.append(np.array([[a, units - a, 0]]))
        b = sizes[(sizes >= a) & (sizes * 2 <= units - a)]
        b = b[used[units - a - b]]
        rows.append(np.stack([np.full(len(b), a), b, units - a - b], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def repeat_counts(histogram: np.ndarray, shapes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x for which the patterns, x times each, come nearest to the histogram.

    Accelerated projected gradient steps; a pattern touches three sizes, so a step is a sum
    and a look-up over the patterns. Size zero stands for "none" and takes no part.
    """
    target = histogram.astype(float)
    scale = max(target.max(initial=0), 1.0)

    def made(x: np.ndarray) -> np.ndarray:
        out = np.bincount(shapes.ravel(), np.repeat(x, 3), len(target))
        out[0] = 0
        return out

    x = momentum = np.zeros(len(shapes))
    if not len(shapes):
        return x
    probe = np.ones(len(shapes))
    for _ in range(30):  # the largest curvature
        back = made(probe)[shapes].sum(axis=1)
        top = np.linalg.norm(back) / np.linalg.norm(probe)
        probe = back / np.linalg.norm(back)
    t = 1.0
    for _ in range(rounds):
        rest = made(momentum) - target / scale
        rest[0] = 0
        new = np.maximum(0, momentum - rest[shapes].sum(axis=1) / (1.01 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


class Plan:
    """Where the pieces go: runs ``(length, rank, count, sequence)``.

    The piece with a rank of its length in ``rank .. rank + count`` goes to the sequence
    that is as far from ``sequence``. The number of runs depends on the capacity only.
    """

    def __init__(self, histogram: np.ndarray):
        self.left = histogram.astype(np.int64).copy()
        self.total, self.sequences, self.runs = histogram.astype(np.int64), 0, []

    def take(self, length: int, count: int, sequence: int) -> None:
        self.runs.append((length, int(self.total[length] - self.left[length]), count, sequence))
        self.left[length] -= count

    def by_patterns(self, capacity: int, units: int) -> None:
        """Fit repeat counts of the patterns, round them, and fill them as far as pieces are left."""
        grain = -(-capacity // units)
        units = capacity // grain  # a size in units never stands for more than the capacity
        unit = -(-np.arange(capacity + 1) // grain)
        bins = np.bincount(unit, self.left, unit[-1] + 1).astype(np.int64)[: units + 1]
        shapes = patterns(units, bins > 0)
        wanted = np.rint(repeat_counts(bins, shapes)).astype(np.int64)
        for k in np.argsort(-wanted, kind="stable"):
            if wanted[k] < 1:
                break
            slots = shapes[k][shapes[k] > 0]
            sizes, uses = np.unique(slots, return_counts=True)
            times = int(min(wanted[k], (bins[sizes] // uses).min()))
            if times < 1:
                continue
            np.subtract.at(bins, slots, times)
            for size in slots:
                at, need = self.sequences, times
                for length in range((size - 1) * grain + 1, min(size * grain, capacity) + 1):
                    if count := int(min(need, self.left[length])):
                        self.take(length, count, at)
                        at, need = at + count, need - count
            self.sequences += times

    def best_fit(self, capacity: int) -> None:
        """The rest, longest first, each into the fullest open sequence that has room."""
        room: dict[int, list[list[int]]] = {}  # room left: runs of sequences (first, count)
        for length in np.flatnonzero(self.left)[::-1].tolist():
            for space in sorted(s for s in room if s >= length):
                while self.left[length] and room.get(space):
                    first, count = room[space].pop()
                    fits = space // length  # best fit goes on with the same sequence
                    whole = min(count, int(self.left[length]) // fits)
                    for k in range(fits if whole else 0):
                        self.take(length, whole, first)
                    if whole:
                        room.setdefault(space - fits * length, []).append([first, whole])
                    if whole < count:
                        some = int(self.left[length])
                        if some:  # fewer than one sequence takes
                            for _ in range(some):
                                self.take(length, 1, first + whole)
                            room.setdefault(space - some * length, []).append([first + whole, 1])
                            whole += 1
                        if whole < count:
                            room[space].append([first + whole, count - whole])
                        break
            fits = capacity // length
            for per, count in ((fits, int(self.left[length]) // fits), (int(self.left[length]) % fits, 1)):
                if per and count:
                    for _ in range(per):
                        self.take(length, count, self.sequences)
                    room.setdefault(capacity - per * length, []).append([self.sequences, count])
                    self.sequences += count
            room = {s: r for s, r in room.items() if r and s > 0}


def plan(histogram: np.ndarray, capacity: int) -> Plan:
    """``histogram[l]``: pieces of length l, from 0 (unused) to the capacity."""
    made = Plan(histogram)
    made.by_patterns(capacity, min(UNITS, capacity))
    made.best_fit(capacity)
    return made


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, length``.

    The driver sees the histogram of lengths, which has one number per length up to the
    capacity, and makes the plan from it alone. A piece finds its run by its rank in the
    global order of lengths, which range partitions give without one task per length; so a
    length that a third of all pieces share is nothing special. Repeated rows are pieces
    of their own; an empty table gives an empty result.
    """
    pieces = pin(pieces)
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        histogram[length] = n
    made = plan(histogram, capacity)
    before = np.cumsum(histogram) - histogram
    runs = np.array(sorted((before[length] + rank, at) for length, rank, _, at in made.runs), np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column("row_index").to_numpy()
            at = np.searchsorted(runs[:, 0], index, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(runs[at, 1] + index - runs[at, 0])], [*batch.schema.names[:-1], "sequence_id"]
            )

    placed = global_index(pieces, ["length", "doc_id", "piece"], unique=False)
    placed = placed.select(*pieces.columns, "row_index")
    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece")
    before_it = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.mapInArrow(run, f"{kinds}, sequence_id long").withColumn(
        "offset", F.coalesce(F.sum("length").over(before_it), F.lit(0).cast("long"))
    )
