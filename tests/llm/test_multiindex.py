import numpy as np
import pytest

from paceline.llm import multiindex


def brute(x, ids, cosine=0.9):
    u = multiindex.unit(x)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    n, label = near.sum(axis=1), np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            return n, label
        label = new


def data(seed, rows, dims=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, dims))
    for lo in range(0, rows // 3, 6):  # small groups, some of them chains
        for i in range(lo + 1, lo + 5):
            x[i] = x[i - 1] + rng.normal(size=dims) * rng.choice([0.1, 0.3, 0.45])
    hot = rows // 2
    x[hot : hot + rows // 6] = x[hot] + rng.normal(size=(rows // 6, dims)) * 0.25
    x[hot + 5 : hot + 60] = x[hot + 5]
    x[7] = x[8] * 3.0
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    x = data(seed, 1800)
    ids = np.random.default_rng(seed).permutation(len(x)) * 3
    docs = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, n int")
    n, label = brute(x, ids)
    got = {r.vec_id: r for r in multiindex.near_duplicates(docs).collect()}
    found = np.array([got[int(i)].n_links for i in ids])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    component = np.array([got[int(i)].component_id for i in ids])
    assert (component >= label).all() and (component == label).mean() > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_visits_are_in_order():
    rng = np.random.default_rng(2)
    x = multiindex.unit(rng.normal(size=(300, 10)))
    index = multiindex.Index(rng.normal(size=(9, 5)), rng.normal(size=(9, 5)))
    far = (np.square(x[:, None, :5] - index.left).sum(axis=2))[:, :, None] + np.square(x[:, None, 5:] - index.right).sum(axis=2)[:, None, :]
    want = np.argsort(far.reshape(len(x), -1), axis=1)
    for count in (1, 4, 20, 81):
        assert (index.nearest(x, count) == want[:, :count]).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None])]
    rows += [(20, [3.0, 4.0, 0.0]), (21, [3.0, 4.0, 0.5]), (22, [6.0, 8.0, 0.0]), (23, [2.0]), (24, [5.0]), (25, [-5.0])]
    rows += [(9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [-0.0, 5.0]), (12, [1e300, 1e299])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in multiindex.near_duplicates(docs).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 25)]
    alone += [(20, 2, 20, True), (21, 2, 20, False), (22, 2, 20, False), (23, 1, 23, True), (24, 1, 23, False)]
    linked = [(1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (10, 4, 1, False), (12, 4, 1, False)]
    assert got == sorted([(0, 0, 0, True), *alone, *linked])
    assert multiindex.near_duplicates(docs.limit(0)).count() == 0


def test_recall_with_thousands_of_cells(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "CELL_ROWS", 2)
    x = data(5, 6000, 48)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    n, label = brute(x, range(len(x)))
    got = sorted(multiindex.near_duplicates(docs).collect())
    found = np.array([r.n_links for r in got])
    assert multiindex.codes_for(len(x)) ** 2 > 2500
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    assert (np.array([r.component_id for r in got]) == label).mean() > 0.97


def test_equal_vectors_of_any_length_link(spark):
    """Several lengths, one of them with many cells."""
    rng = np.random.default_rng(9)
    x = [rng.normal(size=d) for d in [3] * 40 + [7] * 900 + [8] * 5]
    x = [v for v in x for _ in range(2)]
    x = [v.astype(np.float32) * (1 + i % 2) for i, v in enumerate(x)]  # pairs of equal direction
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in multiindex.near_duplicates(docs).collect()}
    for d in (3, 7, 8):
        ids = [i for i, v in enumerate(x) if len(v) == d]
        n, _ = brute(np.array([x[i] for i in ids]), ids)
        assert all(got[i].n_links >= 1 for i in ids) and sum(got[i].n_links for i in ids) >= 0.97 * n.sum()
        assert all(got[i].n_links <= k for i, k in zip(ids, n))
