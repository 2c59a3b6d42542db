"""Embedding near-dedup with an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.graph import components
from paceline.operators.ordered import broadcast_if
from paceline.sources.scratch import pin

#: Vectors that the codebooks and the number of visited cells are fitted on.
SAMPLE_ROWS = 8192
#: Vectors a cell has on average, and rows of one side of a tile.
CELL_ROWS, TILE_ROWS = 128, 256
MAX_CODES = 256
#: Vectors whose cells are ranked at once.
BLOCK = 512
#: Share of pairs at the threshold that the visits of one of the two must find.
TARGET_RECALL = 0.98


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; zero rows stay zero."""
    x = np.asarray(vectors, np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (np.square(centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, total / np.maximum(n, 1), centres)
    return centres


@dataclass
class Index:
    """Codebooks of the two halves; a cell is a pair of codes, one of each."""

    left: np.ndarray
    right: np.ndarray
    visits: int = 1

    @property
    def codes(self) -> int:
        return len(self.left)

    def nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each unit vector, nearest first.

        The multi-sequence traversal for many vectors at once: with the codes of each half
        in order of distance, the cell at ranks (i, j) has (i + 1)(j + 1) cells no further
        off, itself included, so the first ``count`` cells lie where that product is small.
        """
        half, k = self.left.shape[1], self.codes
        sorted_codes, sorted_far = [], []
        for part, book in ((x[:, :half], self.left), (x[:, half:], self.right)):
            far = np.square(book).sum(axis=1) - 2 * part @ book.T
            order = np.argsort(far, axis=1, kind="stable")[:, :count]
            sorted_codes.append(order)
            sorted_far.append(np.take_along_axis(far, order, axis=1))
        i, j = np.array([(i, j) for i in range(min(k, count)) for j in range(min(k, count // (i + 1)))]).T
        far = sorted_far[0][:, i] + sorted_far[1][:, j]
        first = np.argsort(far, axis=1, kind="stable")[:, :count]
        return (sorted_codes[0][:, i] * k + sorted_codes[1][:, j])[np.arange(len(x))[:, None], first]


def codes_for(rows: int) -> int:
    """Codes of each half for so many vectors."""
    return int(np.clip(round((rows / CELL_ROWS) ** 0.5), 1, MAX_CODES))


def one_cell(dims: int) -> Index:
    """The index of vectors too few for several cells."""
    half = -(-dims // 2)
    return Index(np.zeros((1, half)), np.zeros((1, dims - half)))


def fit(sample: np.ndarray, rows: int, cosine: float, target: float = TARGET_RECALL) -> Index:
    """Codebooks from a sample of unit vectors, and how many cells to visit.

    Codes grow with the square root of the rows, so a cell keeps about ``CELL_ROWS``. The
    number of visits is the least for which a vector at exactly the threshold, in a random
    direction from a sample vector, lies in a visited cell with the target frequency;
    closer pairs are found more often.
    """
    rng = np.random.default_rng(11)
    half = -(-sample.shape[1] // 2)
    codes = min(codes_for(rows), len(sample))
    index = Index(_kmeans(sample[:, :half], codes, rng), _kmeans(sample[:, half:], codes, rng))
    x = sample[rng.choice(len(sample), min(len(sample), 1000), replace=False)]
    other = rng.normal(size=x.shape)
    other = unit(other - (other * x).sum(axis=1, keepdims=True) * x)
    y = cosine * x + (1 - cosine**2) ** 0.5 * other
    home = index.nearest(y, 1)
    index.visits = min(8, codes * codes)
    while index.visits < codes * codes:
        found = (index.nearest(x, index.visits) == home).any(axis=1).mean()
        if found >= target:
            break
        index.visits = min(codes * codes, index.visits * 3 // 2)
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _tile(index: Index, cosine: float, members: dict, visitors: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one tile: counts for members and visitors, and edges that connect what is linked."""
    m, v = members["x"], visitors["x"]
    near = v @ m.T >= cosine
    near &= visitors["id"][:, None] != members["id"][None, :]
    a, b = np.nonzero(near)
    for_visitor = np.bincount(a, members["n"][b], len(v)).astype(np.int64)
    # The other way counts where the member doesn't visit the visitor's cell itself.
    if len(a):
        rows = np.unique(b)
        seen = index.nearest(m[rows], index.visits)
        home = visitors["home"][a]
        once = ~(seen[np.searchsorted(rows, b)] == home[:, None]).any(axis=1)
        for_member = np.bincount(b[once], visitors["n"][a[once]], len(m)).astype(np.int64)
    else:
        for_member = np.zeros(len(m), np.int64)
    label = np.arange(len(v) + len(m))
    while len(a):
        low = np.minimum(label[a], label[b + len(v)])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b + len(v), low)
        label = label[label]
        if (label == before).all():
            break
    ids = np.concatenate([visitors["id"], members["id"]])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return for_visitor, for_member, np.stack([ids[moved], ids[label[moved]]])


def links(vectors: DataFrame, cosine: float = 0.9, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id, n, other``: partial link counts (``n``) and connecting edges (``other``) of unit-free vectors.

    ``vectors`` has distinct ``x``, the smallest ``id`` of each, and ``n``, how many rows share
    it. Each length of vectors has an index of its own. Every vector is indexed in one cell and visits several;
    a pair is compared in full, in double precision, where either visits the other's cell.
    Cells and their visitors are cut into tiles of bounded size; each tile returns counts
    and a forest, never its pairs.
    """
    spark = vectors.sparkSession
    models: dict[int, Index] = {}
    # One row per length; only those with vectors for several cells need codebooks.
    for d, n in vectors.groupBy(F.size("x").alias("d")).count().orderBy("d").collect():
        if codes_for(n) == 1:
            models[d] = one_cell(d)
            continue
        sample = vectors.where(F.size("x") == d).orderBy(F.xxhash64("id")).limit(sample_rows).select("x").toArrow()
        models[d] = fit(unit(_matrix(sample["x"])), n, cosine)
    if not models:
        return spark.createDataFrame([], "id long, n long, other long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(0))
            for d in lengths.unique().to_pylist():
                model, own = models[d], batch.filter(pc.equal(lengths, d))
                x = unit(_matrix(own.column(0)))
                cells = np.concatenate([model.nearest(x[i : i + BLOCK], model.visits) for i in range(0, len(x), BLOCK)])
                listed = pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))
                size = pa.array(np.full(len(x), d), pa.int32())
                yield pa.RecordBatch.from_arrays([*own.columns, size, listed], ["x", "id", "n", "d", "cells"])

    kind = dict(vectors.dtypes)["x"]
    placed = vectors.select("x", "id", "n").mapInArrow(place, f"x {kind}, id long, n long, d int, cells array<int>")
    placed = pin(placed)
    members = placed.select("x", "id", "n", "d", F.col("cells")[0].alias("cell"))
    again = [F.col(c).alias(f"v_{c}") for c in ("x", "id", "n")] + [F.col("d")]
    visitors = placed.select(*again, F.col("cells")[0].alias("v_home"), F.explode("cells").alias("cell"))
    parts = lambda rows, name: F.ceil(rows / TILE_ROWS).cast("int").alias(name)
    sizes = placed.select("d", F.posexplode("cells").alias("p", "cell")).groupBy("d", "cell").agg(
        F.sum(F.when(F.col("p") == 0, 1).otherwise(0)).alias("m"), F.count("*").alias("v")
    )
    sizes = sizes.where("m > 0").select("d", "cell", parts(F.col("m"), "mp"), parts(F.col("v"), "vp"))
    # One row per cell: as many as the codebooks of all lengths have.
    sizes = broadcast_if(sizes, sum(m.codes**2 for m in models.values()))
    own = lambda name, count: F.pmod(F.xxhash64(name), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    members = members.join(sizes, ["d", "cell"]).select("x", "id", "n", "d", "cell", own("id", "mp").alias("mp"), each("vp").alias("vp"))
    visitors = visitors.join(sizes, ["d", "cell"]).select(
        "v_x", "v_id", "v_n", "v_home", F.col("d").alias("v_d"), F.col("cell").alias("v_cell"),
        own("v_id", "vp").alias("v_vp"), each("mp").alias("v_mp"),
    )

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        side = lambda t: {k: t[k].to_numpy() for k in ("id", "n", "home") if k in t.column_names} | {"x": unit(_matrix(t["x"]))}
        if not len(left) or not len(right):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        m, v = side(left), side(right.rename_columns([c.removeprefix("v_") for c in right.column_names]))
        for_visitor, for_member, edges = _tile(models[key[0].as_py()], cosine, m, v)
        ids = np.concatenate([v["id"], m["id"]])
        counts = np.concatenate([for_visitor, for_member])
        ids, counts = ids[counts > 0], counts[counts > 0]
        nothing = pa.nulls(edges.shape[1], pa.int64())
        return pa.table(
            {
                "id": pa.concat_arrays([pa.array(ids, pa.int64()), pa.array(edges[0], pa.int64())]),
                "n": pa.concat_arrays([pa.array(counts, pa.int64()), nothing]),
                "other": pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(edges[1], pa.int64())]),
            }
        )

    tiles = members.groupBy("d", "cell", "mp", "vp").cogroup(visitors.groupBy("v_d", "v_cell", "v_mp", "v_vp"))
    return tiles.applyInArrow(compare, "id long, n long, other long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing; others link with vectors of their own length. Rows with one vector are one node,
    however many there are. A null id links with nothing and is its own; repeated rows of
    one id count each.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    good = F.exists("x", lambda v: v != 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(good & F.col("id").isNotNull(), F.lit(False))
    classes = pin(rows.where(usable).groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    found = pin(links(classes.select("x", F.col("rep").alias("id"), "n"), cosine))
    counts = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("links"))
    groups = components(found.where("other is not null"), "id", "other")
    table = (
        classes.join(counts, classes["rep"] == counts["id"], "left")
        .drop("id")
        .join(groups, F.col("rep") == groups["node"], "left")
        .select(
            F.col("x").alias("cx"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    out = rows.withColumn("usable", usable).join(table, F.col("usable") & (F.col("x") == F.col("cx")), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


ORACLE = """
with recursive v as (
    select vec_id, embedding::double[] as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
        and len(list_filter(embedding, lambda c: c <> 0)) > 0
), e as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
    where list_cosine_similarity(a.x, b.x) >= 0.9
), reach as (
    select a as id, b as other from e union select r.id, e.b from reach r join e on r.other = e.a
), n as (
    select a as id, count(*) as n from e group by a
), c as (
    select id, min(other) as least from reach group by id
)
select vec_id, coalesce(n.n, 0)::bigint as n_links, least(vec_id, coalesce(c.least, vec_id)) as component_id,
    vec_id <= coalesce(c.least, vec_id) as kept
from embeddings left join n on n.id = vec_id left join c on c.id = vec_id
"""
