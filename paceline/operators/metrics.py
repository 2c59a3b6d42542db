"""Regression metrics, overall and per segment, each in one aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.numeric import bin_label, edge_labels

# Report bins, their labels, and accuracy thresholds in min/km.
DISTANCE_BINS = [0, 50, 100, 160, 200, math.inf]
DISTANCE_LABELS = ["< 50km", "50-99km", "100-159km", "160-199km", "≥ 200km"]
EXPERIENCE_BINS = [0, 5, 20, 50, 100, math.inf]
EXPERIENCE_LABELS = ["0-4 races", "5-19 races", "20-49 races", "50-99 races", "100+ races"]
THRESHOLDS = {"Accuracy_30s": 0.5, "Accuracy_1min": 1.0, "Accuracy_2min": 2.0}
METRICS = ["MAE", "MSE", "RMSE", "R²", "MAPE", "MAE_percentage", *THRESHOLDS]


def metric_columns(y_true: str, y_pred: str) -> list[Column]:
    """The nine metrics as aggregate columns.

    R² is null below two rows; with a constant target it is 1 for a perfect
    prediction and 0 otherwise.  MAPE leaves rows with a zero target out.
    """
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    error = y - p
    mae, mse = F.avg(F.abs(error)), F.avg(error * error)
    rows, spread = F.count(error), F.var_pop(y)
    r2 = (
        F.when(rows < 2, None)
        .when(spread > 0, 1 - F.try_divide(mse, spread))
        .otherwise(F.when(mse == 0, 1.0).otherwise(0.0))
    )
    within = [
        (F.avg((F.abs(error) <= t).cast("int")) * 100).alias(name) for name, t in THRESHOLDS.items()
    ]
    return [
        mae.alias("MAE"),
        mse.alias("MSE"),
        F.sqrt(mse).alias("RMSE"),
        r2.alias("R²"),
        (F.avg(F.abs(F.try_divide(error, y))) * 100).alias("MAPE"),
        (F.try_divide(mae, F.avg(y)) * 100).alias("MAE_percentage"),
        *within,
    ]


def _counts(y_true: str, y_pred: str) -> list[Column]:
    usable = F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()
    return [
        F.count(F.when(usable, 1)).alias("count"),
        F.count(F.when(usable & (F.col(y_true) == 0), 1)).alias("zero_targets"),
    ]


def regression_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row with the nine metrics, the row count and the rows MAPE left out."""
    return df.agg(*metric_columns(y_true, y_pred), *_counts(y_true, y_pred))


def metrics_long(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", model: str = "Model"
) -> DataFrame:
    """The metrics as (model, metric, value) rows."""
    wide = df.agg(*metric_columns(y_true, y_pred))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return wide.select(F.lit(model).alias("model"), F.inline(pairs))


def metrics_by(df: DataFrame, segment: str, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Metrics per value of a category."""
    return df.groupBy(segment).agg(*metric_columns(y_true, y_pred), *_counts(y_true, y_pred))


def metrics_by_bin(
    df: DataFrame,
    value: str,
    edges: list[float],
    labels: list[str] | None,
    output: str,
    y_true: str = "y_true",
    y_pred: str = "y_pred",
) -> DataFrame:
    """Metrics per half-open bin; values outside all bins and empty bins do not show."""
    labels = edge_labels(edges) if labels is None else labels
    binned = df.withColumn(output, bin_label(F.col(value), edges, labels))
    return metrics_by(binned.filter(F.col(output).isNotNull()), output, y_true, y_pred)


def metrics_by_distance(
    df: DataFrame, distance: str = "distance", bins: list[float] | None = None, **columns: str
) -> DataFrame:
    edges, labels = (bins, None) if bins else (DISTANCE_BINS, DISTANCE_LABELS)
    return metrics_by_bin(df, distance, edges, labels, "distance_range", **columns)


def metrics_by_experience(
    df: DataFrame, races: str = "num_races", bins: list[float] | None = None, **columns: str
) -> DataFrame:
    edges, labels = (bins, None) if bins else (EXPERIENCE_BINS, EXPERIENCE_LABELS)
    return metrics_by_bin(df, races, edges, labels, "experience_range", **columns)


def segment_report(
    df: DataFrame,
    bins: dict[str, tuple[str, list[float], list[str] | None]],
    categories: list[str],
    y_true: str = "y_true",
    y_pred: str = "y_pred",
) -> DataFrame:
    """All segment reports in one pass: ``segment, value`` and the metrics; ``all`` is the whole table.

    ``bins`` has (column, edges, labels) by segment name; values outside all bins don't show
    in that segment, a null category is a value.  Grouping sets carry each row once into every
    segment and combine before the one shuffle, which has one row per segment value and task.
    """
    labels = {n: bin_label(F.col(c), e, edge_labels(e) if t is None else t) for n, (c, e, t) in bins.items()}
    labels |= {c: F.col(c).cast("string") for c in categories}
    places = {name: f"_s{i}" for i, name in enumerate(labels)}
    rows = df.select(
        F.col(y_true).alias("_y"), F.col(y_pred).alias("_p"), *[c.alias(places[n]) for n, c in labels.items()]
    )
    sets = [[F.col(p)] for p in places.values()]
    grouped = rows.groupingSets([*sets, []], *places.values()).agg(
        F.grouping_id().alias("_id"), *metric_columns("_y", "_p"), *_counts("_y", "_p")
    )
    # Bit i of the id, from the highest down, is zero in the set of segment i only.
    whole = (1 << len(places)) - 1
    segment, value = F.lit("all"), F.lit(None).cast("string")
    for i, (name, place) in enumerate(places.items()):
        own = F.col("_id") == whole - (1 << (len(places) - 1 - i))
        segment, value = F.when(own, name).otherwise(segment), F.when(own, F.col(place)).otherwise(value)
    out = grouped.select(segment.alias("segment"), value.alias("value"), *METRICS, "count", "zero_targets")
    return out.where(~F.col("segment").isin(list(bins)) | F.col("value").isNotNull())


def compare_models(df: DataFrame, y_true: str, predictions: dict[str, str]) -> DataFrame:
    """Metrics of several prediction columns of one table, best MAE first.

    All models are measured in the same pass; rows are not multiplied by models.
    """
    packed = df.agg(
        *[F.struct(*metric_columns(y_true, c)).alias(f"_m{i}") for i, c in enumerate(predictions.values())]
    )
    each = F.array(
        *[
            F.struct(F.lit(name).alias("model"), *[F.col(f"_m{i}")[m].alias(m) for m in METRICS])
            for i, name in enumerate(predictions)
        ]
    )
    return packed.select(F.inline(each)).orderBy("MAE", "model")


def with_error(df: DataFrame, y_true: str, y_pred: str, output: str = "error") -> DataFrame:
    """Actual minus predicted."""
    return df.withColumn(output, F.col(y_true) - F.col(y_pred))


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """Mean, population deviation and range of fold scores."""
    return df.agg(
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    )
