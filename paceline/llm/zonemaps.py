"""Centroid clustering over blocks of vectors in the order of a space-filling curve."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.sources.scratch import pin

#: Vectors of a block, and the axes and bits of the curve that orders them.
BLOCK, AXES, BITS = 128, 8, 7
#: Components beyond this have distances that no long holds.
LARGEST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (0 to 2^bits - 1).

    Skilling's transform: undo the rotations from the highest bit down, Gray-code what is
    left, and read the bits across the axes.
    """
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inverted, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        carry ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= carry
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            keys = keys << 1 | axis >> bit & 1
    return keys


@dataclass(frozen=True)
class Curve:
    """The grid that vectors are put on: leading directions of some of them, and its range."""

    axes: np.ndarray
    low: np.ndarray
    step: np.ndarray

    @classmethod
    def through(cls, some: np.ndarray) -> Curve:
        """Directions in which these vectors differ most; the range is twice theirs."""
        centred = some - some.mean(axis=0)
        axes = np.linalg.svd(centred, full_matrices=True)[2][:AXES].T
        at = some @ axes
        reach = np.maximum((at.max(axis=0) - at.min(axis=0)) / 2, 1.0)
        return cls(axes, at.min(axis=0) - reach, 4 * reach / (1 << BITS))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        cells = np.floor((vectors @ self.axes - self.low) / self.step)
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def exact_type(*parts: np.ndarray) -> type:
    """Doubles where every sum of products of these whole numbers stays below 2^53, else longs."""
    largest = max([int(np.abs(p).max()) for p in parts if p.size], default=0)
    return np.float64 if parts[0].shape[-1] * (2 * largest) ** 2 < 1 << 53 else np.int64


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each box, which centroids may be the nearest of a point in it (boolean, box by centroid).

    One is none if even its distance from the box exceeds another's from the farthest corner,
    or if it is farther than another one everywhere: the difference of two squared distances
    is linear, so its largest value in a box is found axis by axis. Whole numbers, no rounding.
    """
    kind = exact_type(low, high, centroids)
    low, high, c = low.astype(kind), high.astype(kind), centroids.astype(kind)
    least, most = np.zeros((len(low), len(c)), kind), np.zeros((len(low), len(c)), kind)
    for j, centre in enumerate(c):
        below, above = centre - low, high - centre
        least[:, j] = (np.maximum(np.maximum(-below, -above), 0) ** 2).sum(axis=1)
        most[:, j] = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
    out = least <= most.min(axis=1, keepdims=True)
    squares = (c * c).sum(axis=1)
    for j, centre in enumerate(c):
        slope = 2 * (c - centre)  # of |x - centre|^2 - |x - other|^2
        highest = high @ np.maximum(slope, 0).T + low @ np.minimum(slope, 0).T + squares[j] - squares
        out &= ~(highest < 0)
    return out


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid (the first of several) and the squared distance, exactly."""
    kind = exact_type(vectors, centroids)
    v, c = vectors.astype(kind), centroids.astype(kind)
    distance = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    label = distance.argmin(axis=1)
    return label, distance[np.arange(len(v)), label].astype(np.int64)


def _valid(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & finite


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    whole = np.floor(vectors.astype(np.float64) * scale)
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ArithmeticError(f"a component of {np.abs(whole).max():.0f} steps is beyond {LARGEST}")
    return whole.astype(np.int64)


def _blocks(rows: DataFrame, curve: Curve, dims: int, scale: float) -> DataFrame:
    """One row per block: ``n, low, high, total`` (the zone map), ``ids`` and ``vectors``."""
    kind = dict(rows.dtypes)["id"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(_matrix(batch.column(1), dims), scale)
            packed = pa.array([v.tobytes() for v in whole.astype("<i4")], pa.binary())
            keys = pa.array(curve.keys(whole.astype(np.float64)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, packed], ["id", "key", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(["id", "vector"])
            table = table if left is None else pa.concat_tables([left, table])
            whole = table.num_rows - table.num_rows % BLOCK
            if whole:
                yield block_rows(table.slice(0, whole))
            left = table.slice(whole)
        if left is not None and left.num_rows:
            yield block_rows(left)

    def block_rows(table: pa.Table) -> pa.RecordBatch:
        ids = pa.concat_arrays(table["id"].chunks)
        vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), "<i4").reshape(-1, dims)
        starts = range(0, len(vectors), BLOCK)
        parts = [vectors[i : i + BLOCK] for i in starts]
        columns = [
            pa.array([len(p) for p in parts], pa.int32()),
            pa.array([p.min(axis=0).tobytes() for p in parts], pa.binary()),
            pa.array([p.max(axis=0).tobytes() for p in parts], pa.binary()),
            pa.array([p.sum(axis=0, dtype="<i8").tobytes() for p in parts], pa.binary()),
            pa.ListArray.from_arrays(pa.array([*starts, len(vectors)], pa.int32()), ids),
            pa.array([p.tobytes() for p in parts], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["n", "low", "high", "total", "ids", "vectors"])

    # Equal vectors have equal keys: the number of the row lets any count of them be cut.
    placed = rows.mapInArrow(keyed, f"id {kind}, key long, vector binary").withColumn("tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    schema = f"n int, low binary, high binary, total binary, ids array<{kind}>, vectors binary"
    return pin(placed.mapInArrow(cut, schema))


def _boxes(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<i4").reshape(-1, dims) for i in (1, 2))
    return low.astype(np.int64), high.astype(np.int64)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """By centroid and axis the sum of its vectors; by (centroid, -1) their number."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            low, high = _boxes(batch, dims)
            n, sums, vectors = (batch.column(i) for i in (0, 3, 4))
            for i, mask in enumerate(candidates(low, high, centroids)):
                of = np.flatnonzero(mask)
                if len(of) == 1:  # the zone map has all there is to know
                    total[of[0], :dims] += np.frombuffer(sums[i].as_py(), "<i8")
                    total[of[0], dims] += n[i].as_py()
                    continue
                v = np.frombuffer(vectors[i].as_py(), "<i4").reshape(-1, dims).astype(np.int64)
                label, _ = nearest(v, centroids[of])
                for j in np.unique(label):
                    total[of[j], :dims] += v[label == j].sum(axis=0)
                    total[of[j], dims] += (label == j).sum()
        place = np.indices(total.shape)
        axis = np.where(place[1] == dims, -1, place[1])
        columns = [pa.array(x.ravel(), t) for x, t in ((place[0], pa.int32()), (axis, pa.int32()), (total, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "axis", "total"])

    parts = blocks.select("n", "low", "high", "total", "vectors").mapInArrow(run, "cluster int, axis int, total long")
    found = parts.groupBy("cluster", "axis").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r.cluster, r.axis): int(r.total) for r in found.collect()}


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    dims = centroids.shape[1]
    kind = dict(blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = _boxes(batch, dims)
            for i, mask in enumerate(candidates(low, high, centroids)):
                of = np.flatnonzero(mask)
                v = np.frombuffer(batch.column(4)[i].as_py(), "<i4").reshape(-1, dims).astype(np.int64)
                label, distance = nearest(v, centroids[of])
                columns = [batch.column(3).slice(i, 1).flatten(), pa.array(of[label], pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return blocks.select("n", "low", "high", "ids", "vectors").mapInArrow(run, f"id {kind}, cluster int, distance long")


@dataclass(frozen=True)
class Clustering:
    """Final centroids (row by number), the blocks, and ``id, cluster, distance`` of every vector."""

    centroids: np.ndarray
    blocks: DataFrame
    rows: DataFrame


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: float = 64.0,
    salt: str = "1:",
) -> Clustering | None:
    """Group vectors around ``k`` centroids in so many rounds; none if no vector can take part.

    Vectors with ``dims`` components, none null or not finite, become whole numbers
    ``floor(scale * x)``; the others are left out. The first centroids are the vectors whose
    salted id has the smallest SHA-256 (null ids hash as the salt alone; equal ids go by
    their components); there are fewer if there are fewer vectors. A round assigns every
    vector to its nearest centroid (the first of several) and moves centroids to the floor
    of their vectors' mean; one without vectors stays. All of it is exact whatever the
    curve's axes, which only say which vectors share a block. Repeated rows are rows of
    their own. A component beyond 2^27 steps is an error, as distances would not fit a long.

    The vectors are shuffled once. A round reads the blocks, looks at the vectors of those
    with several candidates only, and shuffles one row per centroid and axis of each task.
    """
    vector = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector")).where(_valid(F.col("vector"), dims))
    salted = F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = rows.orderBy(F.sha2(salted.cast("binary"), 256), "vector").limit(k).collect()
    if not first:
        return None
    centroids = _whole(np.array([r.vector for r in first], np.float64), scale)
    blocks = _blocks(rows, Curve.through(centroids.astype(np.float64)), dims, scale)
    for _ in range(rounds):
        sums = _sums(blocks, centroids)
        for j in range(len(centroids)):
            if n := sums[j, -1]:
                centroids[j] = [sums[j, axis] // n for axis in range(dims)]
    return Clustering(centroids, blocks, pin(_assigned(blocks, centroids)))


def digest(vectors: DataFrame) -> DataFrame:
    """The result of the query; an empty table gives an empty result."""
    spark: SparkSession = vectors.sparkSession
    found = cluster(vectors)
    types = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    if found is None:
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in types.items()]).limit(0)
    by_cluster = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    inertia = {r.cluster: int(r.d) for r in by_cluster.collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    about = [(j, d, sum(inertia.values()), sha[j]) for j, d in inertia.items()]  # one row per centroid
    schema = ", ".join(f"{c} {t}" for c, t in types.items() if c != "distance")
    rows = found.rows.withColumnRenamed("id", "vec_id").join(F.broadcast(spark.createDataFrame(about, schema)), "cluster")
    return rows.select("vec_id", *types)


def _oracle(rounds: int = 3) -> str:
    ctes = [
        "e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 "
        "AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "x AS (SELECT vec_id, unnest(range(64)) AS d, "
        "unnest(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM e)",
        "s AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS k FROM e)",
        "c0 AS (SELECT s.k, x.d, x.v FROM s JOIN x ON s.vec_id = x.vec_id WHERE s.k < 16)",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"p{i} AS (SELECT x.vec_id, c.k, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS dist "
            f"FROM x JOIN c{i} c ON x.d = c.d GROUP BY x.vec_id, c.k)"
        )
        ctes.append(f"a{i} AS (SELECT * FROM p{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) = 1)")
        ctes.append(
            f"m{i} AS (SELECT k, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM "
            f"(SELECT a.k, x.d, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN x ON a.vec_id = x.vec_id GROUP BY a.k, x.d))"
        )
        ctes.append(
            f"c{i + 1} AS (SELECT c.k, c.d, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k AND c.d = m.d)"
        )
    return (
        f"WITH {', '.join(ctes)}, h AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY k) "
        f"SELECT a.vec_id, a.k AS cluster, a.dist AS distance, CAST(sum(a.dist) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.dist) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256 FROM a{rounds} a JOIN h ON a.k = h.k"
    )


ORACLE = _oracle()
