"""Both ways to compute an operator give one schema and one result."""

import decimal

import pytest
from conftest import race_row, race_table
from pyspark.sql import functions as F

from paceline.operators import history, profile, split, validate
from paceline.operators.ordered import Prior, prior_aggregates
from paceline.schema import RACE
from paceline.sources import scratch


@pytest.mark.parametrize("kind", ["int", "decimal(12,2)", "double"])
def test_windows_and_blocks_agree(spark, kind):
    rows = [(i, None if i % 3 == 0 else i % 5, decimal.Decimal(i * 7 % 11), -1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, g int, v decimal(12,2), mean double").withColumn("v", F.col("v").cast(kind))
    specs = [Prior("n", "count"), Prior("total", "sum", "v"), Prior("mean", "mean", "v"), Prior("low", "min", "v"), Prior("high", "max", "v"), Prior("recent", "recent_mean", "v", 3)]
    one = prior_aggregates(df, "g", ["k"], specs)
    other = prior_aggregates(df, "g", ["k"], specs, max_group_rows=20)
    assert one.dtypes == other.dtypes
    assert one.columns == ["k", "g", "v", "n", "total", "mean", "low", "high", "recent"]
    near = lambda r: tuple(round(float(x), 9) if x is not None else None for x in r)
    assert sorted(map(near, one.collect()), key=str) == sorted(map(near, other.collect()), key=str)
    again = prior_aggregates(other, "g", ["k"], specs, max_group_rows=20)
    assert again.columns == other.columns and again.count() == 300


def null_races(spark):
    rows = [race_row(None, y, e, "50km", "4:00:00") for y, e in ((2020, "A"), (2021, "B"), (2022, "Run (50km"), (2023, "C"))]
    rows += [race_row(1, y, "A", "50km", "4:30:00") for y in (2020, 2021, 2022)]
    races = race_table(spark, rows).withColumn(RACE.pace, F.lit(5.0)).withColumn(RACE.distance, F.lit(50.0))
    return history.history_features(races, event_pattern="Run (50km")


def test_null_entity_is_split_and_checked(spark):
    df = null_races(spark)
    train, test, _ = split.split_by_target_event(df, 2022, "Run (50km")
    assert test.count() == 1
    years = [r[0] for r in train.filter(F.col(RACE.entity).isNull()).select(RACE.year).orderBy(RACE.year).collect()]
    assert years == [2020, 2021]
    assert train.filter(F.col(RACE.entity) == 1).count() == 3
    assert validate.temporal_issues(df).count() == 0
    wrong = df.withColumn("cum_num_races", F.col("cum_num_races") + 1)
    assert validate.temporal_issues(wrong).filter("entity_id is null").count() == 3
    leaked = validate.split_issues(df, test, 2022, "Run (50km")
    assert leaked.filter("type = 'future_data_in_training' and entity_id is null").count() == 1


def test_patterns_are_literal_unless_asked(spark):
    df = null_races(spark)
    assert split.split_by_year(df, 2022, "RUN (", case_insensitive=True)[1].count() == 1
    assert split.split_by_year(df, 2022, "^Run .50km$", literal=False)[1].count() == 1
    assert split.split_by_year(df, 2022, "^Run")[1].count() == 0


def test_profiles_leave_out_what_is_not_finite(spark):
    values = [float(i % 10) for i in range(50)] + [float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    clean = df.limit(0).union(spark.createDataFrame([(v,) for v in values[:50]], "v double"))
    for make in (lambda x: profile.histogram(x, "v", 5), lambda x: profile.box_stats(x, "v"), lambda x: profile.kde_curve(x, "v", 20)):
        assert sorted(map(str, make(df).collect())) == sorted(map(str, make(clean).collect()))
    plan = profile.kde_curve(df, "v", 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") <= 1


def test_scratch_folder_is_removed(spark, tmp_path):
    with scratch.scratch(spark) as folder:
        spark.range(3).write.parquet(f"{folder}/t")
        assert spark.read.parquet(f"{folder}/t").count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(f"{folder}/t").count()


def test_local_cluster_is_a_cluster():
    assert scratch._one_process("local") and scratch._one_process("local[8]")
    assert not scratch._one_process("local-cluster[2,1,1024]") and not scratch._one_process("spark://host:7077")
