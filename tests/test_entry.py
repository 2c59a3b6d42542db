"""A cross-section of the registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = [
    "clean_event_name_noise_documents", "typed_parse", "clean_races", "history_all", "event_type_history",
    "split_target_event_train", "time_folds", "target_encoding_per_fold", "model_matrix_clean",
    "metrics_by_experience", "validate_temporal_tampered", "validate_report", "category_distribution",
    "residual_histogram", "qq_points",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "events", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    want = sorted(repr([r[at[c]] for c in columns]) for r in result.fetchall())
    assert got == want


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
