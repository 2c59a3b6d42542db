import pytest
from pyspark.sql import functions as F

from conftest import race_row, race_table
from paceline.operators import clean, history, split, validate
from paceline.plans import flows
from paceline.schema import FEATURE_SCHEMA, RACE, schema_problems


def features(df):
    return history.history_features(clean.clean_races(df))


@pytest.fixture(scope="module")
def whole(races):
    return features(races).persist()


def test_clean_table_has_no_issues(whole):
    issues = validate.temporal_issues(whole)
    assert issues.count() == 0
    assert tuple(validate.temporal_summary(whole, issues).first()) == (True, 0, 3, 8)


def test_second_result_of_a_year_is_reported(spark):
    rows = [race_row(1, 2020, "A", "50km", "5:00:00")] + [
        race_row(1, 2021, e, "50km", "6:00:00") for e in ("B", "C")
    ]
    issues = validate.temporal_issues(features(race_table(spark, rows))).orderBy("type").collect()
    assert [(r.type, r.entity_id, r.year) for r in issues] == [
        ("cum_avg_pace_mismatch", 1, 2021),
        ("cum_num_races_mismatch", 1, 2021),
    ]
    assert (issues[1].expected, issues[1].actual) == (1.0, 2.0)


def test_tampered_values_are_found(whole):
    wrong = whole.withColumns(
        {
            "cum_num_races": F.when(F.col(RACE.entity) == 1, 9).otherwise(F.col("cum_num_races")),
            "cum_avg_pace": F.when(F.col(RACE.entity) == 3, 0.5).otherwise(F.col("cum_avg_pace")),
        }
    )
    issues = validate.temporal_issues(wrong)
    found = sorted((r.type, r.entity_id, r.year) for r in issues.collect())
    assert found == [
        ("cum_avg_pace_mismatch", 3, 2022),
        ("cum_num_races_mismatch", 1, 2021),
        ("cum_num_races_mismatch", 1, 2022),
    ]
    assert [r.type for r in validate.first_issues(issues, 2).collect()] == [f[0] for f in found[:2]]


def test_split_checks(whole):
    train, test, _ = split.split_by_target_event(whole)
    issues = validate.split_issues(train, test)
    assert issues.count() == 0
    assert tuple(validate.split_summary(train, test, issues).first()) == (True, 0, 2, 3)

    leaked = validate.split_issues(whole, test).collect()
    assert sorted((r.type, r.entity_id, r.year) for r in leaked) == [
        ("future_data_in_training", 1, 2022),
        ("future_data_in_training", 3, 2022),
    ]
    wrong = validate.split_issues(train, whole.filter(F.col(RACE.year) < 2022)).collect()
    assert sorted((r.type, r.entity_id) for r in wrong if r.entity_id) == [("future_data_in_training", 2)]
    assert {r.type for r in wrong if not r.entity_id} == {
        "missing_target_event", "missing_test_year", "multiple_test_years",
    }


def test_report_of_a_stored_table(spark, whole, tmp_path):
    path = str(tmp_path / "features")
    whole.write.parquet(path)
    settings = flows.RunSettings(output_dir=str(tmp_path))
    report = flows.validate_stage(spark, path, settings)["report"]
    assert sorted(tuple(r) for r in report.collect()) == [("split", True, 0), ("temporal", True, 0)]
    with pytest.raises(FileNotFoundError):
        flows.validate_stage(spark, str(tmp_path / "nothing"), settings)


def test_feature_schema(whole):
    assert schema_problems(whole.schema, FEATURE_SCHEMA) == []
    assert schema_problems(whole.drop("athlete_age").schema, FEATURE_SCHEMA) == ["missing column athlete_age"]
    text = whole.withColumn("athlete_age", F.col("athlete_age").cast("string"))
    assert schema_problems(text.schema, FEATURE_SCHEMA) == ["column athlete_age is string, expected bigint"]
