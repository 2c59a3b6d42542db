import math

import pytest
from pyspark.sql import functions as F

from paceline.operators import encode
from paceline.operators.joins import join_lookup

SCHEMA = "`Event_name_clean` string, pace_min_per_km double"


def encoded(df):
    return {r[0]: r[1] for r in df.select("Event_name_clean", "Race_Pace_Mean_Encoded").collect()}


def test_smoothing_and_unseen_categories(spark):
    train = spark.createDataFrame([("race_a", 10.0), ("race_a", 9.5)], SCHEMA)
    test = spark.createDataFrame([("race_b", 11.0), (None, 10.5)], SCHEMA)
    a, b = encode.target_encode(train, test)
    assert encoded(a) == {"race_a": pytest.approx(9.75)}
    assert encoded(b) == {"race_b": pytest.approx(9.75), None: pytest.approx(9.75)}


def test_weights_use_training_rows_only(spark):
    train = spark.createDataFrame([("a", 4.0), ("a", 6.0), ("b", 10.0), (None, 8.0), ("c", None)], SCHEMA)
    a, _ = encode.target_encode(train, train)
    mean = 7.0
    assert encoded(a) == {
        "a": pytest.approx((10 + 10 * mean) / 12),
        "b": pytest.approx((10 + 10 * mean) / 11),
        "c": pytest.approx(mean),
        None: pytest.approx(mean),
    }


def test_validation_folds_know_earlier_folds_only(spark):
    rows = [("a", 1.0, -1), ("b", 3.0, -1), ("a", 5.0, 0), ("new", 7.0, 0), ("a", 9.0, 1), ("new", 2.0, 1), (None, 0.0, 1)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, fold int")
    got = {(r.fold, r[0]): r.Race_Pace_Mean_Encoded for r in encode.encode_validation_folds(df).collect()}
    assert got == {
        (0, "a"): pytest.approx((1 + 10 * 2.0) / 11),
        (0, "new"): pytest.approx(2.0),
        (1, "a"): pytest.approx((6 + 10 * 4.0) / 12),
        (1, "new"): pytest.approx((7 + 10 * 4.0) / 11),
        (1, None): pytest.approx(4.0),
    }


@pytest.mark.parametrize("local", [100, 2])
def test_codes_are_shared_and_alphabetical(spark, local):
    one = spark.createDataFrame([("M",), ("F",), (None,)], "g string")
    two = spark.createDataFrame([("X",), ("F",)], "g string")
    a, b = encode.category_codes([one, two], "g", "code", local)
    assert {(r.g, r.code) for r in a.collect()} == {("M", 1), ("F", 0), (None, -1)}
    assert {(r.g, r.code) for r in b.collect()} == {("X", 2), ("F", 0)}


def test_one_hot(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "g string")
    test = spark.createDataFrame([("c",), ("z",)], "g string")
    a, b, names = encode.one_hot(train, test, "g")
    assert names == ["g_b", "g_c"]
    assert sorted(tuple(r) for r in a.collect()) == [(0, 0), (0, 0), (0, 1), (1, 0)]
    assert sorted(tuple(r) for r in b.collect()) == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        encode.one_hot_levels(train, "g", max_levels=2)


def test_clean_matrix(spark):
    rows = [(1.0,), (None,), (math.nan,), (math.inf,), (-math.inf,)]
    df = spark.createDataFrame(rows, "x double")
    assert [r.x for r in encode.clean_matrix(df, ["x"]).collect()] == [1.0, -1.0, -1.0, -1.0, -1.0]


@pytest.mark.parametrize("encoding,width", [("codes", 3), ("one_hot", 3)])
def test_model_matrix_round_trip(spark, tmp_path, encoding, width):
    train = spark.createDataFrame(
        [("M", 1.0, "a", 5.0), ("F", 2.0, "a", 6.0)], f"`Athlete gender` string, x double, {SCHEMA}"
    )
    new = spark.createDataFrame([("F", None, "zz")], "`Athlete gender` string, x double, `Event_name_clean` string")
    matrix = encode.ModelMatrix.fit(train, ["Athlete gender", "x"], encoding=encoding)
    assert len(matrix.names) == width
    matrix.save(str(tmp_path / "m"))
    loaded = encode.ModelMatrix.load(spark, str(tmp_path / "m"))
    got = dict(zip(loaded.names, loaded.transform(new, target=None).first().features))
    assert got["x"] == -1.0 and got["Race_Pace_Mean_Encoded"] == 5.5
    ready = matrix.transform(train, keep=["x"])
    assert ready.columns == ["features", "label", "x"]
    assert sorted(r.label for r in ready.collect()) == [5.0, 6.0]


def test_join_side_is_forced_only_when_counted(spark, monkeypatch):
    """Weights are broadcast up to a counted number of rows; beyond it the plan carries no hint."""
    df = spark.range(10).select(F.col("id").cast("string").alias("Event_name_clean"), F.lit(1.0).alias("pace_min_per_km"))
    for bound, hinted in ((10, True), (9, False)):
        monkeypatch.setattr(encode, "join_lookup", lambda *a, n=bound, **k: join_lookup(*a, **k, broadcast_rows=n))
        a, _ = encode.target_encode(df, df)
        assert ("ResolvedHint" in a._jdf.queryExecution().analyzed().toString()) == hinted


def test_one_scan_of_the_training_rows_per_fit(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("M", 1.0, "a", 5.0), ("F", 2.0, "b", 6.0), (None, 3.0, None, None)]
    train = spark.createDataFrame(rows, f"`Athlete gender` string, x double, {SCHEMA}")
    train = train.mapInArrow(counted, train.schema)
    for encoding in ("codes", "sparse"):
        before = read.value
        matrix = encode.ModelMatrix.fit(train, ["Athlete gender", "x"], encoding=encoding)
        assert read.value == before + 3
        # What is learnt stays as it is, however often it is used or stored.
        new = spark.createDataFrame([("F", 1.0, "a")], "`Athlete gender` string, x double, Event_name_clean string")
        assert matrix.transform(new, target=None).count() == 1
        assert read.value == before + 3


@pytest.mark.parametrize("local", [10_000, 100])
def test_sparse_one_hot_of_many_levels(spark, local):
    names = [f"level {i:04d}" for i in range(1500)]
    train = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [(None, -1)], "g string, _place int")
    test = spark.createDataFrame([("level 0007", 1), ("level 0000", 2), ("other", 3), (None, 4)], "g string, _place int")
    a, b, places = encode.sparse_one_hot(train, test, "g", "v", local)
    assert places == 1499 and a.columns == ["g", "_place", "v"]
    for r in a.collect():
        assert r.v.size == 1499 and list(r.v.indices) == ([r["_place"] - 1] if r["_place"] > 0 else [])
    assert {r["_place"]: list(zip(r.v.indices, r.v.values)) for r in b.collect()} == {1: [(6, 1.0)], 2: [], 3: [], 4: []}


def test_model_matrix_of_many_levels(spark, tmp_path):
    rows = [(f"l{i % 1200:04d}", float(i), "a", 5.0 + i % 3) for i in range(2400)]
    train = spark.createDataFrame(rows, f"`Athlete gender` string, x double, {SCHEMA}")
    matrix = encode.ModelMatrix.fit(train, ["Athlete gender", "x"], encoding="sparse")
    assert len(matrix.names) == 2 + 1199 and matrix.names[2] == "Athlete gender[0]"
    matrix.save(str(tmp_path / "m"))
    loaded = encode.ModelMatrix.load(spark, str(tmp_path / "m"))
    for m in (matrix, loaded):
        got = {r.x: r.features for r in m.transform(train, keep=["x"]).collect()}
        assert got[0.0].size == 1201 and list(got[5.0].indices) == [0, 1, 2 + 4] and got[5.0][6] == 1.0
