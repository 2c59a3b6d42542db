import pytest
from pyspark.sql import functions as F

from paceline.operators.joins import free_names, hot_keys, join_lookup


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows have key 7, a tenth none, the others one of 3000 keys."""
    x = F.col("id")
    key = F.when(x % 2 == 0, 7).when(x % 10 == 1, None).otherwise(x % 3001)
    df = spark.range(0, 60_000, 1, 16).select("id", key.cast("long").alias("k"))
    return df, spark.range(0, 2000).select(F.col("id").alias("key"), (F.col("id") * 3).alias("v"))


def rows(df):
    return sorted((r.id, r.k, r.v) for r in df.select("id", "k", "v").collect())


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_same_rows_by_every_way(spark, skewed, how, null_safe):
    df, table = skewed
    if null_safe:
        table = table.unionByName(spark.createDataFrame([(None, -1)], "key long, v long"))
    same = df.k.eqNullSafe(table.key) if null_safe else df.k == table.key
    want = rows(df.join(table, same, how))
    small = join_lookup(df, table, {"k": "key"}, how, null_safe)
    apart = join_lookup(df, table, {"k": "key"}, how, null_safe, broadcast_rows=10, hot_rows=1000)
    plain = join_lookup(df, table, {"k": "key"}, how, null_safe, broadcast_rows=10)
    assert rows(small) == rows(apart) == rows(plain) == want
    assert small.columns == apart.columns == plain.columns == ["id", "k", "v"]
    assert small.dtypes == apart.dtypes == plain.dtypes


def test_no_task_holds_the_hot_keys(spark, skewed):
    df, table = skewed
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")

    def largest(out):
        return out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    plain = df.join(table.hint("merge"), df.k == table.key, "left").select("id", "k", "v")
    assert largest(plain) > 30_000
    apart = join_lookup(df, table.hint("merge"), {"k": "key"}, broadcast_rows=10, hot_rows=1000)
    assert largest(apart) < 6_000
    spark.conf.set(coalesce, before)


def test_hot_keys(skewed):
    df, _ = skewed
    assert sorted(r.k or -1 for r in hot_keys(df, ["k"], 1000).collect()) == [-1, 7]
    assert hot_keys(df.limit(0), ["k"], 1).count() == 0


def test_several_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (None, "a", 7)], "x long, y string, `_key_0` int")
    table = spark.createDataFrame([(1, "a", 1.5), (2, "a", 2.5)], "x long, y string, w double")
    for hot in (1, 100):
        got = join_lookup(df, table, {"x": "x", "y": "y"}, broadcast_rows=1, hot_rows=hot)
        assert got.columns == ["x", "y", "_key_0", "w"]
        assert sorted((r["_key_0"], r.w) for r in got.collect()) == [(5, 1.5), (6, None), (7, None)]
    assert free_names(["_A", "b"], ["_a", "b", "c"]) == ["__a", "_b", "c"]


def test_empty_sides(spark, skewed):
    df, table = skewed
    assert join_lookup(df.limit(0), table, {"k": "key"}, broadcast_rows=10, hot_rows=10).count() == 0
    got = join_lookup(df, table.limit(0), {"k": "key"}, broadcast_rows=0, hot_rows=1000)
    assert got.where("v is null").count() == got.count() == df.count()
