import random

import pytest
from pyspark.sql import functions as F

from paceline.operators import clean, history
from paceline.operators.ordered import Prior, global_index, prior_aggregates, range_blocks
from paceline.schema import RACE

COLUMNS = [
    "cum_num_races", "cum_avg_pace", "cum_best_pace", "cum_total_distance", "cum_shortest_distance",
    "cum_longest_distance", "cum_avg_distance", "cum_ws_finishes", "recent_avg_distance",
    "distance_gap_from_longest", "athlete_age",
]
GOLDEN = {
    (1, 2020): [0, -1, -1, -1, -1, -1, 0, -1, -1, 51, 35],
    (1, 2021): [1, 4.2, 4.2, 50, 50, 50, 50, 0, 50, 0, 36],
    (1, 2022): [2, 4.05, 3.9, 100, 50, 50, 50, 0, 50, 50, 37],
    (2, 2020): [0, -1, -1, -1, -1, -1, 0, -1, -1, 81, 30],
    (2, 2021): [1, 3.0, 3.0, 80, 80, 80, 80, 0, 80, 0, 31],
    (2, 2022): [2, 2.90625, 2.8125, 160, 80, 80, 80, 0, 80, -20, 32],
    (3, 2021): [0, -1, -1, -1, -1, -1, 0, -1, -1, 71, 41],
    (3, 2022): [1, 23 / 7, 23 / 7, 70, 70, 70, 70, 0, 70, 30, 42],
}


@pytest.mark.parametrize("limit", [1000, 1])
def test_golden_features(races, limit):
    """The same values whether entities go through one window or are cut into blocks."""
    out = history.history_features(clean.clean_races(races), max_group_rows=limit)
    got = {(r[RACE.entity], r[RACE.year]): [r[c] for c in COLUMNS] for r in out.collect()}
    assert got.keys() == GOLDEN.keys()
    for key, want in GOLDEN.items():
        assert got[key] == pytest.approx(want), key


SPECS = [
    Prior("n", "count"),
    Prior("total", "sum", "v"),
    Prior("low", "min", "v"),
    Prior("high", "max", "v"),
    Prior("mean", "mean", "v"),
    Prior("near2", "recent_mean", "v", 2),
    Prior("near5", "recent_mean", "v", 5),
]


def expected(rows):
    """Naive recount: for each row, look at all rows of its entity that sort before it."""
    out = {}
    for e, t, i, _ in rows:
        past = sorted(r for r in rows if r[0] == e and (r[1], r[2]) < (t, i))
        vals = [r[3] for r in past]
        known = [v for v in vals if v is not None]

        def mean(xs):
            xs = [x for x in xs if x is not None]
            return sum(xs) / len(xs) if xs else None

        out[i] = (
            len(past),
            sum(known) if known else None,
            min(known, default=None),
            max(known, default=None),
            mean(vals),
            mean(vals[-2:]),
            mean(vals[-5:]),
        )
    return out


@pytest.mark.parametrize("limit", [10_000, 40, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_prior_aggregates_equal_a_naive_recount(spark, limit, seed):
    """One entity holds a third of the rows and another third has no entity at all."""
    rng = random.Random(seed)
    entities = [7] * 100 + [None] * 100 + [rng.randrange(8, 40) for _ in range(100)]
    rows = [
        (e, rng.randrange(5), i, None if rng.random() < 0.2 else round(rng.random() * 10, 2))
        for i, e in enumerate(entities)
    ]
    df = spark.createDataFrame(rows, "e int, t int, i int, v double")
    out = prior_aggregates(df, "e", ["t", "i"], SPECS, limit)
    got = {r.i: tuple(r[s.name] for s in SPECS) for r in out.collect()}
    want = expected([(e if e is not None else -1, t, i, v) for e, t, i, v in rows])
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i]), i


def test_equal_rows_can_be_cut(spark):
    """A thousand copies of one row: counts run 0 .. 999 and are spread over blocks."""
    df = spark.range(1000).select(F.lit(1).alias("e"), F.lit(5).alias("t"), F.lit(2.0).alias("v"))
    out = prior_aggregates(df, "e", ["t"], SPECS[:2], 50, unique=False)
    assert sorted(r.n for r in out.select("n").collect()) == list(range(1000))
    cut = range_blocks(df, ["e", "t"], 8, unique=False)
    assert cut.groupBy("_block").count().agg(F.max("count")).first()[0] < 500


def test_global_index_over_blocks(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"))
    out = global_index(df, ["k"], "i", blocks=6)
    assert all(r.k == r.i for r in out.collect())
    assert out.count() == 500


def test_empty_table(spark):
    df = spark.createDataFrame([], "e int, t int, i int, v double")
    assert prior_aggregates(df, "e", ["t", "i"], SPECS).collect() == []


def test_one_exchange_and_one_sort(races):
    """Gender rule and all history features share one shuffle and one sort."""
    raw = races.persist()
    plan = history.history_features(clean.clean_races(raw), size_source=raw)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [") == 1
    assert "SinglePartition" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
