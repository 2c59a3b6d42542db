import math

import pytest

from paceline.operators import metrics

PAIRS = [(10.0, 10.2), (9.5, 9.3), (11.0, 11.1), (10.5, 10.4)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "y_true double, y_pred double")


def test_nine_metrics(spark):
    got = metrics.regression_metrics(frame(spark, PAIRS)).first().asDict()
    want = {
        "MAE": 0.15, "MSE": 0.025, "RMSE": math.sqrt(0.025), "R²": 0.92, "MAPE": 1.491684,
        "MAE_percentage": 1.463415, "Accuracy_30s": 100, "Accuracy_1min": 100, "Accuracy_2min": 100,
        "count": 4, "zero_targets": 0,
    }
    assert got == pytest.approx(want, rel=1e-6)


def test_perfect_prediction(spark):
    got = metrics.regression_metrics(frame(spark, [(1.0, 1.0), (2.0, 2.0)])).first()
    assert (got["MAE"], got["RMSE"], got["R²"], got["Accuracy_30s"]) == (0, 0, 1, 100)


def test_edge_cases(spark):
    zero = metrics.regression_metrics(frame(spark, [(0.0, 1.0), (2.0, 1.0), (None, 5.0)])).first()
    assert (zero["MAPE"], zero["zero_targets"], zero["count"]) == (50, 1, 2)
    assert metrics.regression_metrics(frame(spark, [(2.0, 2.0), (2.0, 2.0)])).first()["R²"] == 1
    assert metrics.regression_metrics(frame(spark, [(2.0, 2.0), (2.0, 3.0)])).first()["R²"] == 0
    assert metrics.regression_metrics(frame(spark, [(2.0, 2.0)])).first()["R²"] is None


def test_long_form(spark):
    rows = metrics.metrics_long(frame(spark, PAIRS), model="m").collect()
    assert [r.metric for r in rows] == metrics.METRICS and {r.model for r in rows} == {"m"}


def test_bins_are_half_open_and_empty_bins_are_left_out(spark):
    rows = [(1.0, 1.0, 49.9), (1.0, 2.0, 50.0), (1.0, 3.0, 300.0), (1.0, 1.0, -5.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "y_true double, y_pred double, distance double")
    got = {r.distance_range: r["MAE"] for r in metrics.metrics_by_distance(df).collect()}
    assert got == {"< 50km": 0, "50-99km": 1, "≥ 200km": 2}
    custom = metrics.metrics_by_distance(df, bins=[0, 50, 400]).collect()
    assert {r.distance_range: r["count"] for r in custom} == {"[0, 50)": 1, "[50, 400)": 2}


def test_experience_and_category(spark):
    rows = [(1.0, 1.0, 4, "M"), (1.0, 2.0, 5, "F"), (1.0, 2.0, 100, "F")]
    df = spark.createDataFrame(rows, "y_true double, y_pred double, num_races int, gender string")
    assert {r.experience_range for r in metrics.metrics_by_experience(df).collect()} == {
        "0-4 races", "5-19 races", "100+ races",
    }
    assert {r.gender: r["count"] for r in metrics.metrics_by(df, "gender").collect()} == {"M": 1, "F": 2}


def test_models_sorted_by_error_in_one_scan(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.1), (2.0, 4.0, 2.1)], "y double, bad double, good double")
    out = metrics.compare_models(df, "y", {"bad": "bad", "good": "good"})
    assert [r.model for r in out.collect()] == ["good", "bad"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_score_summary(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "s double")
    assert tuple(metrics.score_summary(df, "s").first()) == (2, 1, 1, 3)


def test_segment_report_equals_the_single_reports(spark):
    rows = [(float(i), float(i) + (i % 4) / 2, i * 13 % 230, "MF"[i % 2] if i % 7 else None, i * 3 % 130) for i in range(60)]
    df = spark.createDataFrame(rows, "y_true double, y_pred double, distance int, gender string, num_races int")
    bins = {
        "distance_range": ("distance", metrics.DISTANCE_BINS, metrics.DISTANCE_LABELS),
        "experience_range": ("num_races", [0, 5, 20], None),
    }
    out = metrics.segment_report(df, bins, ["gender"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1
    got = {(r.segment, r.value): tuple(r)[2:] for r in out.collect()}
    single = {
        "distance_range": metrics.metrics_by_distance(df),
        "experience_range": metrics.metrics_by_experience(df, bins=[0, 5, 20]),
        "gender": metrics.metrics_by(df, "gender"),
    }
    want = {(name, r[0]): tuple(r)[1:] for name, t in single.items() for r in t.collect()}
    want["all", None] = tuple(metrics.regression_metrics(df).first())
    assert set(got) == set(want) and ("gender", None) in got
    for key, values in want.items():
        assert got[key] == tuple(pytest.approx(v) if isinstance(v, float) else v for v in values)
