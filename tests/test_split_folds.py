import pytest
from pyspark.sql import functions as F

from paceline.operators import clean, folds, history, split
from paceline.schema import FEATURE_COLS, RACE


@pytest.fixture(scope="module")
def features(races):
    return history.history_features(clean.clean_races(races)).persist()


def keys(df):
    return sorted((r[RACE.entity], r[RACE.year]) for r in df.select(RACE.entity, RACE.year).collect())


def test_target_event_split(features):
    train, test, cols = split.split_by_target_event(features)
    assert keys(test) == [(1, 2022), (3, 2022)]
    assert keys(train) == [(1, 2020), (1, 2021), (2, 2020), (2, 2021), (2, 2022), (3, 2021)]
    assert cols == FEATURE_COLS and train.columns == features.columns


def test_last_test_row_is_the_cutoff(spark):
    rows = [(1, 2021, "a", 0), (1, 2022, "WS", 1), (1, 2022, "WS", 2), (1, 2023, "b", 3), (None, 2022, "c", 0)]
    df = spark.createDataFrame(rows, "`Athlete ID` int, `Year of event` int, `Event name` string, cum_num_races int")
    train, test, _ = split.split_by_target_event(df, 2022, "WS")
    assert test.count() == 2
    assert sorted(train.select("`Event name`").collect()) == [("WS",), ("a",), ("c",)]


def test_athlete_without_earlier_rows_does_not_train(spark):
    df = spark.createDataFrame(
        [(1, 2022, "WS", 0)], "`Athlete ID` int, `Year of event` int, `Event name` string, cum_num_races int"
    )
    train, test, _ = split.split_by_target_event(df, 2022, "WS")
    assert (train.count(), test.count()) == (0, 1)


def test_year_split(features):
    train, test, _ = split.split_by_year(features, 2022)
    assert all(y < 2022 for _, y in keys(train)) and len(keys(test)) == 3
    assert split.split_by_year(features, 2022, "western states")[1].count() == 0
    assert split.split_by_year(features, 2022, "western states", case_insensitive=True)[1].count() == 2


def test_time_folds_give_the_remainder_to_the_first_block(spark):
    df = spark.range(11).select(F.col("id"), (F.col("id") / 4).cast("int").alias("year"))
    out = folds.time_folds(df, ["year", "id"], 5)
    assert [r.fold for r in out.orderBy("row_index").collect()] == [-1] * 6 + [0, 1, 2, 3, 4]
    sizes = folds.fold_sizes(out, 5).orderBy("fold").collect()
    assert [tuple(r) for r in sizes] == [(i, 6 + i, 1) for i in range(5)]


def test_time_folds_need_enough_rows(spark):
    with pytest.raises(ValueError):
        folds.time_folds(spark.range(5), ["id"], 5)


def test_kfold_ranges(spark):
    out = folds.kfold_ranges(spark.range(11), ["id"], 4).orderBy("id").collect()
    assert [r.fold for r in out] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
