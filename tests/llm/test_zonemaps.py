import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from paceline.llm import zonemaps

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, k=16, rounds=3, dims=64, scale=64):
    """The query's rows for (vec_id, vector)."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        label = [best(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, label) if m == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *best(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sum(x[2] for x in found if x[1] == j), total, sha[j]) for i, j, d in found), key=repr)


def vectors(n, seed=1, spread=0.05, groups=12):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(groups)]
    f32 = lambda x: float(np.float32(x))
    return [(i, [f32(c + rng.gauss(0, spread)) for c in rng.choice(centres)]) for i in range(n)]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n, spread, block", [(1, 0.05, 256), (15, 0.05, 4), (400, 0.02, 16), (400, 0.7, 7)])
def test_against_brute_force(spark, monkeypatch, n, spread, block):
    monkeypatch.setattr(zonemaps, "BLOCK", block)
    rows = vectors(n, n, spread)
    got = zonemaps.digest(frame(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert result(got) == slow(rows)


def test_copies_ties_and_vectors_that_do_not_take_part(spark, monkeypatch):
    monkeypatch.setattr(zonemaps, "BLOCK", 32)
    rows = vectors(60, 3)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # most vectors are one
    rows += [(2000 + i, [float(i % 2)] * 64) for i in range(40)] + [(2000, [0.0] * 64)] * 3
    rows += [(None, [0.5] * 64), (None, [-0.25] * 64)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [0.0] * 63, [float("-inf")] * 64]
    rows += [(3000 + i, v) for i, v in enumerate(bad)]
    assert result(zonemaps.digest(frame(spark, rows))) == slow(rows)


def test_equal_vectors_fill_blocks_of_bounded_size(spark):
    rows = [(i, [0.125] * 64) for i in range(3000)]
    found = zonemaps.cluster(frame(spark, rows))
    assert found.blocks.agg({"n": "max"}).first()[0] <= zonemaps.BLOCK
    assert found.rows.count() == 3000 and found.rows.select("cluster").distinct().count() == 1


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-(2**20), 2**20)) for _ in range(64)]) for i in range(60)]
    assert result(zonemaps.digest(frame(spark, rows))) == slow(rows)
    with pytest.raises(Exception, match="is beyond"):
        zonemaps.digest(frame(spark, [(1, [1e30] * 64)]))


def test_empty_and_other_columns(spark):
    rows = vectors(20, 5)
    wide = spark.createDataFrame(
        [(i, v, 1, "x", 2, "k") for i, v in rows], "vec_id long, embedding array<float>, id int, vector string, cluster int, `key` string"
    )
    assert result(zonemaps.digest(wide)) == slow(rows)
    empty = zonemaps.digest(wide.limit(0))
    assert empty.count() == 0 and empty.dtypes == zonemaps.digest(wide).dtypes


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = zonemaps.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_the_nearest_and_shrink_with_the_box():
    rng = np.random.default_rng(6)
    centroids = rng.integers(-60, 60, (16, 64))
    for spread in (0, 2, 20, 90, 2**24):
        points = centroids[rng.integers(0, 16, 40)][:, None, :] + rng.integers(-spread, spread + 1, (40, 30, 64))
        low, high = points.min(axis=1), points.max(axis=1)
        mask = zonemaps.candidates(low, high, centroids)
        for box, may in zip(points, mask):
            label, distance = zonemaps.nearest(box, centroids)
            some, least = zonemaps.nearest(box, centroids[np.flatnonzero(may)])
            assert (np.flatnonzero(may)[some] == label).all() and (least == distance).all()
        if spread <= 2:
            assert mask.sum(axis=1).max() == 1
    equal = np.array([[0, 0], [0, 0], [5, 5]])
    assert zonemaps.candidates(np.array([[0, 0]]), np.array([[1, 1]]), equal).tolist() == [[True, True, False]]


def test_few_candidates_on_clustered_vectors(spark):
    found = zonemaps.cluster(frame(spark, vectors(6000, 7, 0.03)))
    low, high = [], []
    for r in found.blocks.select("low", "high").collect():
        low.append(np.frombuffer(r.low, "<i4"))
        high.append(np.frombuffer(r.high, "<i4"))
    mask = zonemaps.candidates(np.array(low, np.int64), np.array(high, np.int64), found.centroids)
    assert mask.mean() < 0.5
