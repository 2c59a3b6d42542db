import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import race_row, race_table
from paceline.operators import clean, encode, history, model
from paceline.operators.folds import time_folds
from paceline.plans import flows
from paceline.schema import FEATURE_COLS, FEATURE_SCHEMA, RACE, history_order, schema_problems
from paceline.sources.scratch import pin

SMALL = {"n_estimators": 5, "num_leaves": 8, "learning_rate": 0.5, "subsample": 1.0, "colsample_bytree": 1.0}


@pytest.fixture(scope="module")
def toy(spark):
    """A target that is a step of one input."""
    df = spark.range(60).select(
        F.col("id"),
        F.when(F.col("id") % 2 == 0, "M").otherwise("F").alias("Athlete gender"),
        (F.col("id") % 3).cast("double").alias("x"),
        F.lit("race").alias("Event_name_clean"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(9.0).alias("pace_min_per_km"),
    )
    ready, _, matrix = encode.prepare_model_data(df, df, ["Athlete gender", "x"], keep=["id"])
    return ready.persist(), matrix


def test_parameter_names():
    got = model.gbt_params()
    assert got == {
        "maxIter": 500, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8", "seed": 42,
    }
    assert model.gbt_params({"num_leaves": 128, "max_depth": 4, "verbose": -1})["maxDepth"] == 4
    assert model.gbt_params({"maxIter": 7, "n_estimators": 7})["maxIter"] == 7
    assert len(list(model.product(*model.DEFAULT_GRID.values()))) == 81


def test_fit_importance_and_reload(spark, toy, tmp_path):
    ready, matrix = toy
    fitted, predicted = model.train_and_predict(ready, ready, SMALL)
    assert predicted.count() == 60
    assert model.evaluate(predicted).first()["MAE"] < 0.2
    importance = model.feature_importance(fitted, matrix.names, ready).collect()
    assert importance[0].feature == "x" and sum(r.importance for r in importance) == pytest.approx(1)

    path = str(tmp_path / "model")
    model.save_model(fitted, matrix, path)
    rows = [("M", 0.0, "unseen"), ("F", 1.0, None)]
    new = spark.createDataFrame(rows, "`Athlete gender` string, x double, `Event_name_clean` string")
    again = model.score_rows(new, path, ["x"])
    same = fitted.transform(matrix.transform(new, target=None, keep=["x"]))
    assert {r.x: r.prediction for r in again.collect()} == {r.x: r.prediction for r in same.collect()}


def test_kfold_and_grid(toy):
    ready, _ = toy
    scores, summary = model.kfold_evaluation(ready, ["id"], 3, SMALL)
    assert scores.count() == 3 and summary.first()["max"] <= 0
    grid = {"n_estimators": [1, 4], "num_leaves": [2], "learning_rate": [0.5]}
    for selection in ("train", "holdout", "cv"):
        best, tried = model.grid_search(ready, grid, selection, ["id"], folds=2)
        assert best["n_estimators"] in (1, 4) and tried.count() == 2
        assert tried.first().params.startswith(f"n_estimators={best['n_estimators']}")
    with pytest.raises(ValueError):
        model.grid_search(ready, grid, "other")
    for selection in ("holdout", "cv"):  # the label is no order
        with pytest.raises(ValueError, match="order"):
            model.grid_search(ready, grid, selection)


def test_cached_input_stays_cached(toy):
    ready, _ = toy
    mine = ready.persist()
    try:
        model.train_and_predict(mine, mine, SMALL)
        assert mine.storageLevel.useMemory
    finally:
        mine.unpersist()
    model.train_and_predict(ready, ready, SMALL)
    assert not ready.storageLevel.useMemory


@pytest.fixture(scope="module")
def many_races(spark):
    rows = []
    for athlete in range(40):
        for year in range(2015, 2023):
            event = "Western States (USA)" if year == 2022 and athlete % 4 == 0 else f"{athlete % 5}th Run {year} (GER)"
            hours = 5 + (athlete + year) % 6
            rows.append(
                race_row(
                    athlete, year, event, f"{50 + athlete % 3 * 10}km", f"{hours}:00:00 h",
                    **{"Athlete gender": "MF"[athlete % 2], "Athlete year of birth": 1970.0 + athlete},
                )
            )
    return race_table(spark, rows)


def test_temporal_cv(many_races):
    features = history.history_features(clean.clean_races(many_races))
    scores = model.temporal_cv(features, FEATURE_COLS, 2, SMALL)
    assert [(r.fold, r.n_validation) for r in scores.orderBy("fold").collect()] == [(0, 106), (1, 106)]
    assert model.cv_summary(scores).first()["avg_mae"] > 0


@pytest.fixture(scope="module")
def finished(spark, many_races, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    many_races.write.option("header", True).csv(f"{folder}/raw")
    settings = flows.RunSettings(output_dir=f"{folder}/out", run_id="abc", cv_folds=2, params=SMALL)
    return folder, settings, flows.run(spark, "ml", settings, csv_path=f"{folder}/raw")


def test_full_run(spark, finished):
    folder, settings, result = finished
    assert result.metrics.first()["count"] == 10
    assert result.cv_scores.count() == 2 and result.importance.count() == 16
    features = spark.read.parquet(f"{folder}/out/features")
    assert features.count() == 320
    assert schema_problems(features.schema, FEATURE_SCHEMA) == []
    predictions = spark.read.option("header", True).csv(f"{folder}/out/test_predictions")
    assert predictions.columns == ["actual_pace", "predicted_pace", "error"] and predictions.count() == 10
    logged = spark.read.parquet(f"{folder}/out/cv_metrics/history")
    assert {r.run_id for r in logged.collect()} == {"abc"}
    scored = model.score_rows(features.filter(F.col(RACE.year) == 2022), result.model_path)
    assert scored.count() == 40


def test_other_entry_points(spark, finished, tmp_path):
    folder, settings, _ = finished
    stored = f"{folder}/out/features"
    other = flows.RunSettings(output_dir=str(tmp_path), cv_folds=2, params=SMALL)
    assert flows.run(spark, "cv", other, features_path=stored).cv_scores.count() == 2
    one_hot = flows.original_settings(other)
    result = flows.run(spark, "final", one_hot, features=spark.read.parquet(stored))
    assert "Athlete gender_M" in [r.feature for r in result.importance.collect()]
    assert flows.run(spark, "data", other, features_path=stored).count() == 320
    with pytest.raises(ValueError):
        flows.run(spark, "ml", other)
    with pytest.raises(ValueError):
        flows.run(spark, "other", other, features_path=stored)
    with pytest.raises(FileNotFoundError):
        flows.run(spark, "cv", other, features_path=str(tmp_path / "nothing"))


def test_scoring_a_stream(spark, toy, tmp_path):
    ready, matrix = toy
    fitted, _ = model.train_and_predict(ready, ready, SMALL)
    model.save_model(fitted, matrix, str(tmp_path / "model"))
    schema = "`Athlete gender` string, x double, `Event_name_clean` string"
    new = spark.createDataFrame([("M", 0.0, "race"), ("F", 1.0, "other")], schema)
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    scored = model.score_rows(stream, str(tmp_path / "model"), ["x"])
    query = (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_split_counts_are_those_of_the_trees(spark):
    rows = [(float(i % 7), float(i % 5), float(i % 3), (i % 7) * 2.0 + (i % 5) * (i % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, unused double, label double").withColumn("unused", F.lit(1.0))
    ready = VectorAssembler(inputCols=["a", "b", "unused"], outputCol="features").transform(df)
    fitted, _ = model.train_and_predict(ready, ready, SMALL)
    nodes = model.tree_nodes(fitted)
    listing = fitted.toDebugString  # each split is listed as an If and an Else
    want = {name: listing.count(f"If (feature {i} <=") for i, name in enumerate(["a", "b", "unused"])}
    counts = model.split_counts(nodes, ["a", "b", "unused"])
    assert {r.feature: r.splits for r in counts.collect()} == want and want["unused"] == 0 and want["a"] > 0
    assert nodes.count() == sum(t.numNodes for t in fitted.trees)
    assert nodes.where("feature is null").count() == sum((t.numNodes + 1) // 2 for t in fitted.trees)
    table = model.feature_importance(fitted, ["a", "b", "unused"], ready, "split").collect()
    assert [r.importance for r in table] == sorted(want.values(), reverse=True)
    with pytest.raises(ValueError):
        model.feature_importance(fitted, ["a", "b", "unused"], ready, "other")


def test_search_in_parallel_gives_the_same(toy):
    ready, _ = toy
    grid = {"n_estimators": [1, 3], "num_leaves": [2, 4], "learning_rate": [0.5]}
    one = model.grid_search(ready, grid, "holdout", ["id"])
    four = model.grid_search(ready, grid, "holdout", ["id"], parallelism=4)
    assert one[0] == four[0] and one[1].collect() == four[1].collect()


def test_folds_learn_from_one_pass(spark, many_races):
    """Every fold's matrix is the one fitted on its earlier rows; the rows of all folds are counted with it."""
    features = history.history_features(clean.clean_races(many_races))
    folded = pin(time_folds(features, history_order(features.columns), 3, unique=False))
    matrices, rows_of = encode.ModelMatrix.fit_folds(folded, FEATURE_COLS, folds=3)
    assert rows_of == {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}

    def rows(df):
        return sorted((round(r.label, 6), *[round(x, 6) for x in r.features]) for r in df.collect())

    for i, matrix in enumerate(matrices):
        before, own = folded.filter(F.col("fold") < i), folded.filter(F.col("fold") == i)
        x_train, x_val, alone = encode.prepare_model_data(before, own, FEATURE_COLS)
        assert matrix.names == alone.names
        assert rows(matrix.transform(before)) == rows(x_train)
        assert rows(matrix.transform(own)) == rows(x_val)


def test_node_ids_are_kept_for_deep_trees_only():
    assert not model.make_regressor({"num_leaves": 8}).getCacheNodeIds()
    assert model.make_regressor({"num_leaves": 64}).getCacheNodeIds()
