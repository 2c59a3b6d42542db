from datetime import datetime

import pytest
from pyspark.sql import types as T

from conftest import race_row, race_table
from paceline.schema import RAW_SCHEMA
from paceline.sources import runlog, tables
from paceline.sources.scratch import new_folder, shared_dir

HEADER = ",".join(f.name for f in RAW_SCHEMA.fields)


def test_csv_with_null_tokens_bad_cells_and_quotes(spark, tmp_path):
    lines = [
        HEADER,
        '2020,01.01.2020,"Run, ""big"" one (GER)",50km,10,4:30:15 h,NULL,NA,1985,M,M35,10.5,1',
        "20x0,null,Run,50km,,4:30:15 h,,,abc,F,F30,NA,2",
        "2021,01.01.2021,Run,50km",
    ]
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(lines) + "\n")
    rows = tables.read_races_csv(spark, str(path), row_id=True).orderBy("row_id").collect()
    assert rows[0]["Event name"] == 'Run, "big" one (GER)'
    assert rows[0]["Athlete club"] is None and rows[0]["Athlete country"] is None
    assert (rows[1]["Year of event"], rows[1]["Athlete year of birth"]) == (None, None)
    assert rows[1]["Event dates"] is None and rows[1]["Event number of finishers"] is None
    assert rows[1]["Athlete ID"] == 2 and rows[1]["Athlete average speed"] is None
    assert rows[2]["Year of event"] == 2021 and rows[2]["Athlete ID"] is None
    assert len({r.row_id for r in rows}) == 3
    assert tables.read_races_csv(spark, str(path)).schema == RAW_SCHEMA


def test_csv_with_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(HEADER + '\n2020,d,"Run\nTwo",50km,1,p,c,c,1985,M,M35,1,1\n')
    assert tables.read_races_csv(spark, str(path), multi_line=True).first()["Event name"] == "Run\nTwo"


def test_malformed_cells(spark):
    df = spark.createDataFrame([("1", "x"), ("a", "NA"), (None, "2.5")], "`Athlete ID` string, s string")
    schema = RAW_SCHEMA.__class__([f for f in RAW_SCHEMA.fields if f.name == "Athlete ID"])
    assert tuple(tables.malformed_cells(df, schema).first()) == ("Athlete ID", 1)


def test_inferred_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,x\n2,y\n")
    assert tables.read_csv_inferred(spark, str(path)).dtypes == [("a", "int"), ("b", "string")]


def test_stage_is_partitioned_and_pruned(spark, tmp_path):
    df = race_table(spark, [race_row(i, 2000 + i % 3, "Run", "50km", "5:00:00") for i in range(30)])
    path = str(tmp_path / "stage")
    back = tables.write_stage(df, path, "Year of event", ["Athlete ID"])
    assert back.count() == 30
    assert {p.name for p in (tmp_path / "stage").iterdir() if p.is_dir()} == {
        f"Year of event={y}" for y in (2000, 2001, 2002)
    }
    pruned = tables.read_stage(spark, path).filter("`Year of event` = 2001")
    assert "PartitionFilters: [isnotnull(Year of event" in pruned._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        tables.read_stage(spark, str(tmp_path / "nothing"))


def test_result_files(spark, tmp_path):
    predicted = spark.createDataFrame([(2.0, 1.5)], "label double, prediction double")
    tables.write_predictions_csv(predicted, str(tmp_path / "p"), "label", "prediction")
    back = spark.read.option("header", True).csv(str(tmp_path / "p")).first().asDict()
    assert back == {"actual_pace": "2.0", "predicted_pace": "1.5", "error": "0.5"}
    importance = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "feature string, importance double")
    tables.write_importance_csv(importance, str(tmp_path / "i"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "i")).collect()
    assert [r.feature for r in rows] == ["b", "a"]


def test_run_log(spark, tmp_path):
    out = str(tmp_path / "runs")
    runlog.log_run(spark, out, "cv", "one", {"mae": 1.0}, datetime(2024, 1, 1))
    runlog.log_run(spark, out, "cv", "two", {"mae": 2.0, "rmse": None}, datetime(2024, 1, 2))
    assert [(r.run_id, r.metric, r.value) for r in runlog.run_history(spark, out).collect()] == [
        ("one", "mae", 1.0),
        ("two", "mae", 2.0),
        ("two", "rmse", None),
    ]
    assert [r.run_id for r in runlog.latest_run(spark, out).collect()] == ["two", "two"]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_spread(spark):
    few = spark.range(100, numPartitions=1)
    assert tables.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=64)
    assert tables.spread(many) is many


def test_bad_rows_with_file_and_line(spark, tmp_path):
    """Lines of all kinds over several files, some of them read in several splits."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])
    kinds = {
        0: ("{k},ab,1.5", None), 1: ('{k},"a,b",2', None), 2: ('{k},"say ""so"", ok",2', None), 3: ('{k},"open,3', "unclosed_quote"),
        4: ("{k},few", "too_few"), 5: ("{k},a,b,4", "too_many"), 6: ("k{k},a,x", "malformed"), 7: ("{k},,NULL", None), 8: ("", None),
        9: ('{k},a,"1""', "unclosed_quote"), 10: ("{k}", "too_few"), 11: ("{k},a,1e", "malformed"),
    }
    want = {}
    for f in range(3):
        lines = ["k,name,x"]
        for i in range(4000):
            text, problem = kinds[(i * 7 + f) % 12]
            lines.append(text.format(k=i))
            if problem:
                want[f"f{f}.csv", len(lines)] = (problem, lines[-1])
        (tmp_path / f"f{f}.csv").write_text("\n".join(lines) + "\n")
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    spark.conf.set(split, "9000")
    try:
        bad = tables.bad_rows(spark, str(tmp_path), schema)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
        got = {(r.file.rsplit("/")[-1], r.line): r for r in bad.collect()}
    finally:
        spark.conf.set(split, before)
    assert {k: (r.problem, r.record) for k, r in got.items()} == want
    for r in got.values():
        wrong = ["k", "x"] if r.record.startswith("k") else ["x"]
        assert (r.columns or []) == (wrong if r.problem == "malformed" else [])
        if r.problem.startswith("too"):
            assert r.cells == r.record.count(",") + 1
    assert bad.columns == ["file", "line", "problem", "cells", "columns", "record"]
