"""End-to-end runs: data, cross-validation, final training, and all of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators import clean, encode, history, metrics, model, split, validate
from paceline.operators.history import TARGET_EVENT
from paceline.operators.ordered import MAX_GROUP_ROWS
from paceline.operators.split import TEST_YEAR
from paceline.schema import RACE, ROW_ID, RaceColumns
from paceline.sources import runlog, tables


@dataclass(frozen=True)
class RunSettings:
    """What a run needs to know besides its input."""

    output_dir: str
    run_id: str = "unknown"
    test_year: int = TEST_YEAR
    target_event: str = TARGET_EVENT
    cv_folds: int = 5
    params: dict | None = None
    encoding: str = "codes"
    max_group_rows: int = MAX_GROUP_ROWS
    strict_durations: bool = False
    corrections: dict | None = None
    race: RaceColumns = field(default=RACE)


# ---- data -------------------------------------------------------------------


def build_features(raw: DataFrame, settings: RunSettings) -> DataFrame:
    """Clean and add history features, lazily."""
    return history.history_features(
        _clean(raw, settings),
        settings.race,
        event_pattern=settings.target_event,
        max_group_rows=settings.max_group_rows,
        size_source=raw,
    )


def _clean(raw: DataFrame, s: RunSettings) -> DataFrame:
    return clean.clean_races(
        raw,
        s.race,
        corrections=s.corrections,
        strict_durations=s.strict_durations,
        max_group_rows=s.max_group_rows,
    )


def run_data(spark: SparkSession, csv_path: str, settings: RunSettings) -> DataFrame:
    """CSV to feature table, each stage written once and read back.

    Stages go below ``output_dir``: ``sorted``, ``cleaned``, ``features``.  The feature
    stage is partitioned by year, so year splits read only their years.
    """
    race, out = settings.race, settings.output_dir
    raw = tables.read_races_csv(spark, csv_path, row_id=True)
    ordered = tables.write_stage(history.sort_for_sink(raw, race), f"{out}/sorted")
    cleaned = tables.write_stage(_clean(ordered, settings), f"{out}/cleaned")
    featured = history.history_features(
        cleaned, race, event_pattern=settings.target_event, max_group_rows=settings.max_group_rows
    )
    stage = tables.write_stage(featured, f"{out}/features", race.year, [race.entity, ROW_ID])
    return stage.select(*featured.columns)


# ---- modelling --------------------------------------------------------------


@dataclass
class RunResult:
    """What a run produced; tables are lazy."""

    metrics: DataFrame | None = None
    cv_scores: DataFrame | None = None
    cv_summary: DataFrame | None = None
    importance: DataFrame | None = None
    predictions: DataFrame | None = None
    model_path: str | None = None


def _split(features: DataFrame, s: RunSettings):
    return split.split_by_target_event(features, s.test_year, s.target_event, s.race)


def _cross_validate(train: DataFrame, cols: list[str], s: RunSettings, run: str, into: RunResult) -> None:
    into.cv_scores = model.temporal_cv(train, cols, s.cv_folds, s.params, s.race)
    into.cv_summary = model.cv_summary(into.cv_scores)
    runlog.log_run(
        train.sparkSession, f"{s.output_dir}/cv_metrics", run, s.run_id, into.cv_summary.first().asDict()
    )


def _train_final(
    train: DataFrame, test: DataFrame, cols: list[str], s: RunSettings, run: str, into: RunResult
) -> None:
    out = s.output_dir
    x_train, x_test, matrix = encode.prepare_model_data(
        train, test, cols, s.race.pace, s.race.event_clean, encoding=s.encoding,
        keep=[s.race.distance, s.race.gender, "cum_num_races"],
    )
    fitted, predicted = model.train_and_predict(x_train, x_test, s.params)
    into.predictions = tables.write_stage(
        predicted.drop(encode.FEATURES, "rawPrediction"), f"{out}/predictions"
    )
    tables.write_predictions_csv(into.predictions, f"{out}/test_predictions", encode.LABEL, model.PREDICTION)
    into.importance = model.feature_importance(fitted, matrix.names, train, "split")
    tables.write_importance_csv(into.importance, f"{out}/feature_importance")
    into.model_path = f"{out}/model"
    model.save_model(fitted, matrix, into.model_path)
    into.metrics = metrics.regression_metrics(into.predictions, encode.LABEL, model.PREDICTION)
    values = {f"test_{k}": v for k, v in into.metrics.first().asDict().items()}
    runlog.log_run(train.sparkSession, f"{out}/test_metrics", run, s.run_id, values)


def run_ml(features: DataFrame, settings: RunSettings) -> RunResult:
    """Split, cross-validate, train on all training rows, evaluate, save."""
    result = RunResult()
    train, test, cols = _split(features, settings)
    _cross_validate(train, cols, settings, "ml", result)
    _train_final(train, test, cols, settings, "ml", result)
    return result


def run_cv(features: DataFrame, settings: RunSettings) -> RunResult:
    """Split and cross-validate only."""
    result = RunResult()
    train, _, cols = _split(features, settings)
    _cross_validate(train, cols, settings, "cv", result)
    return result


def run_final_training(features: DataFrame, settings: RunSettings) -> RunResult:
    """Split, train and evaluate without cross-validation."""
    result = RunResult()
    train, test, cols = _split(features, settings)
    _train_final(train, test, cols, settings, "final", result)
    return result


MODES = {"ml": run_ml, "cv": run_cv, "final": run_final_training}


def run(
    spark: SparkSession,
    mode: str,
    settings: RunSettings,
    csv_path: str | None = None,
    features: DataFrame | None = None,
    features_path: str | None = None,
) -> RunResult | DataFrame:
    """Start from a raw CSV, a feature table or a stored feature table.

    ``mode`` is ``data`` (feature table only), ``ml``, ``cv`` or ``final``.
    """
    if mode != "data" and mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if features is None and features_path is not None:
        features = tables.read_stage(spark, features_path)
    if features is None and csv_path is not None:
        features = run_data(spark, csv_path, settings)
    if features is None:
        raise ValueError("give csv_path, features or features_path")
    return features if mode == "data" else MODES[mode](features, settings)


def original_settings(settings: RunSettings) -> RunSettings:
    """The first version of the flow: strict durations, name corrections, one-hot gender."""
    return RunSettings(
        **{
            **settings.__dict__,
            "encoding": "one_hot",
            "strict_durations": True,
            "corrections": clean.DISTANCE_CORRECTIONS,
        }
    )


# ---- validation -------------------------------------------------------------


def leakage_report(features: DataFrame, settings: RunSettings) -> dict[str, DataFrame]:
    """Temporal and split checks of a feature table: issue lists and one summary row each."""
    race = settings.race
    temporal = validate.temporal_issues(features, race)
    train, test, _ = _split(features, settings)
    on_split = validate.split_issues(train, test, settings.test_year, settings.target_event, race)
    t = validate.temporal_summary(features, temporal, race).select(
        F.lit("temporal").alias("check"), "valid", "issues"
    )
    s = validate.split_summary(train, test, on_split, race).select(F.lit("split").alias("check"), "valid", "issues")
    return {"temporal_issues": temporal, "split_issues": on_split, "report": t.unionByName(s)}


def validate_stage(spark: SparkSession, path: str, settings: RunSettings) -> dict[str, DataFrame]:
    """The leakage report of a stored feature table."""
    return leakage_report(tables.read_stage(spark, path), settings)
