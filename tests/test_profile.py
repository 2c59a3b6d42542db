import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.functions.numeric import normal_quantile
from paceline.operators import profile


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2] if i % 7 else None, round(rng.gauss(10, 3), 3)) for i in range(400)]
    rows += [(400 + i, "a", 9.5) for i in range(200)] + [(600, "b", None)]
    return spark.createDataFrame(rows, "id int, g string, v double").persist()


def known(sample, group="all"):
    return np.array(
        [r.v for r in sample.collect() if r.v is not None and (group == "all" or r.g == group)]
    )


def test_overview(sample):
    panels = profile.data_overview(sample.withColumn("date", F.lit("x")), time="date")
    typed = profile.data_overview(sample.withColumn("when", F.lit("2020-01-01").cast("date")))
    assert "rows_over_time" in typed and "rows_over_time" not in profile.data_overview(sample)
    assert set(panels) == {"nulls", "dtypes", "bytes", "histogram", "top_values", "rows_over_time"}
    nulls = {r["column"]: (r.nulls, r.null_pct) for r in panels["nulls"].collect()}
    assert nulls["v"] == (1, pytest.approx(100 / 601)) and nulls["id"] == (0, 0)
    assert [tuple(r) for r in panels["dtypes"].collect()] == [("double", 1), ("int", 1), ("string", 2)]
    assert panels["top_values"].first().g == "a"
    sizes = {r["column"]: r.bytes for r in panels["bytes"].collect()}
    assert sizes["v"] == 8 * 600 and sizes["id"] == 4 * 601 and sizes["date"] == 601


def test_inspect(sample):
    parts = profile.inspect_table(sample, 2, 3)
    assert tuple(parts["shape"].first()) == (601, 3)
    assert parts["sample"].columns == ["id", "g"] and parts["sample"].count() == 3
    assert profile.added_columns(sample, sample.withColumn("w", F.lit(1))) == ["w"]
    counts = profile.stage_counts({"x": sample, "y": sample.filter("id < 10").select("id")}).collect()
    assert [tuple(r) for r in counts] == [("x", 601, 3), ("y", 10, 1)]


@pytest.mark.parametrize("bins", [1, 7, 30])
def test_histogram(sample, bins):
    want, edges = np.histogram(known(sample), bins)
    got = profile.histogram(sample, "v", bins).orderBy("bin").collect()
    assert [r.rows for r in got] == want.tolist()
    assert [r.bin_start for r in got] == pytest.approx(edges[:-1].tolist())
    dense, _ = np.histogram(known(sample), bins, density=True)
    got = profile.histogram(sample, "v", bins, density=True).orderBy("bin").collect()
    assert [r.density for r in got] == pytest.approx(dense.tolist())


def test_histogram_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.rows for r in profile.histogram(df, "v", 4).orderBy("bin").collect()] == [0, 0, 2, 0]
    assert profile.histogram(df.filter("v > 5"), "v", 4).collect() == []


@pytest.mark.parametrize("group", ["all", "a", "b", None])
def test_quantiles(sample, group):
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    by = [] if group == "all" else ["g"]
    out = profile.exact_quantiles(sample, "v", probs, by)
    row = out.first() if group == "all" else out.filter(F.col("g").eqNullSafe(F.lit(group))).first()
    values = known(sample, group)
    assert row["rows"] == len(values)
    assert [row[p] for p in probs] == pytest.approx([float(np.quantile(values, q)) for q in probs.values()])


def test_box_and_category(sample):
    values = known(sample)
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    got = profile.box_stats(sample, "v").first()
    assert (got.q1, got.median, got.q3) == pytest.approx((q1, q2, q3))
    assert (got.whisker_low, got.whisker_high) == (inside.min(), inside.max())
    assert got.outliers == len(values) - len(inside) and got["rows"] == len(values)
    by_group = {r.g: r for r in profile.category_distribution(sample, "g", "v").collect()}
    a = known(sample, "a")
    assert (by_group["a"]["mean"], by_group["a"]["std"]) == pytest.approx((a.mean(), a.std(ddof=1)))
    assert set(by_group) == {"a", "b", None}


def test_scatter(sample):
    first = profile.scatter_sample(sample, "id", ["v"], 0.2)
    assert sorted(r.id for r in first.collect()) == sorted(r.id for r in first.collect())
    assert 60 < first.count() < 180
    cells = profile.binned_pairs(sample, "id", "v", 100.0, 5.0)
    assert cells.agg(F.sum("rows")).first()[0] == 600


def test_correlations(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.random(), 1.0) for _ in range(50)] + [(None, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    got = {(r.x, r.y): r.r for r in profile.correlations(df).collect()}
    full = np.array(rows[:-1])
    assert got[("x", "y")] == pytest.approx(np.corrcoef(full[:, 0], full[:, 1])[0, 1])
    assert got[("x", "c")] is None
    assert [r.feature for r in profile.top_correlations(df, "x").collect()] == ["y"]
    with pytest.raises(ValueError):
        profile.correlations(df, ["x"])


def test_normal_quantile(spark):
    probs = [1e-300, 1e-20, 1e-6, 0.01, 0.0749, 0.075, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in probs], "p double")
    got = [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in probs], rel=1e-12)


def test_qq(sample):
    points = profile.qq_points(sample, "v", "id")
    got = points.orderBy("rank").collect()
    n = len(got)
    assert n == 600
    medians = [1 - 0.5 ** (1 / n), *[(i - 0.3175) / (n + 0.365) for i in range(2, n)], 0.5 ** (1 / n)]
    theory = np.array([NormalDist().inv_cdf(p) for p in medians])
    ordered = np.sort(known(sample))
    assert [r.theoretical for r in got] == pytest.approx(theory.tolist())
    assert [r.ordered for r in got] == ordered.tolist()
    fit = profile.qq_fit(points).first()
    slope, intercept = np.polyfit(theory, ordered, 1)
    assert tuple(fit) == pytest.approx((slope, intercept, np.corrcoef(theory, ordered)[0, 1]))


def test_kde(sample):
    values = known(sample)
    width = values.std(ddof=1) * len(values) ** -0.2
    got = profile.kde_curve(sample, "v", 25).orderBy("point").collect()
    xs = np.linspace(values.min() - 3 * width, values.max() + 3 * width, 25)
    want = np.exp(-0.5 * ((xs[:, None] - values) / width) ** 2).sum(1) / (len(values) * width * np.sqrt(2 * np.pi))
    assert [r.x for r in got] == pytest.approx(xs.tolist())
    assert [r.density for r in got] == pytest.approx(want.tolist())


def test_density_by_category(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(200)] + [(None, rng.gauss(5, 2)) for _ in range(50)]
    rows += [("one", 1.0)] * 5 + [("a", None), ("a", float("nan")), ("a", float("inf")), ("two", 1.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = profile.density_by_category(df, "g", "v", 20)
    got = {}
    for r in out.collect():
        got.setdefault(r.g, {})[r.point] = (r.x, r.density)
    assert set(got) == {"a", None, "two"}
    for g, curve in got.items():
        vs = [v for h, v in rows if h == g and v is not None and math.isfinite(v)]
        mean = sum(vs) / len(vs)
        width = math.sqrt(sum((v - mean) ** 2 for v in vs) / (len(vs) - 1)) * len(vs) ** -0.2
        low, high = min(vs) - 2 * width, max(vs) + 2 * width
        for k in range(20):
            x = low + k * (high - low) / 19
            d = sum(math.exp(-0.5 * ((x - v) / width) ** 2) for v in vs) / (len(vs) * width * math.sqrt(2 * math.pi))
            assert curve[k] == (pytest.approx(x), pytest.approx(d))
    assert profile.density_by_category(df.limit(0), "g", "v").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # rows appear above the sums only


def test_stages_are_counted_while_they_are_written(spark, tmp_path):
    writer = profile.StageWriter(spark)
    context = spark.sparkContext

    def jobs(group, write):
        context.setJobGroup(group, group)
        write()
        context.setJobGroup("rest", "rest")
        return len(context.statusTracker().getJobIdsForGroup(group))

    df = spark.range(0, 1000, 1, 4).withColumn("year", F.col("id") % 3)
    plain = jobs("plain", lambda: profile.write_stage(df, str(tmp_path / "p"), "year", ["id"]))
    noted = jobs("noted", lambda: writer.write("one", df, str(tmp_path / "o"), "year", ["id"]))
    assert noted == plain
    two = writer.write("two", df.where("id < 10"), str(tmp_path / "t"))
    assert two.count() == 10
    writer.write("none", df.limit(0), str(tmp_path / "n"))
    assert [tuple(r) for r in writer.counts().collect()] == [("one", 1000, 2), ("two", 10, 2), ("none", 0, 2)]


def test_values_that_are_not_finite_have_no_rank(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, float("inf")), (4, None), (5, 1.0)], "k int, v double")
    assert sorted(r.k for r in profile.qq_points(df, "v", "k").collect()) == [1, 5]
    found = profile.category_distribution(df.withColumn("g", F.lit("x")), "g", "v").first()
    assert (found["mean"], found.rows) == (1.5, 2)
