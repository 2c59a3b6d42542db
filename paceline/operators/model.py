"""Gradient-boosted regression with MLlib: fit, temporal and plain validation, tuning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import product

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators.encode import FEATURES, LABEL, ModelMatrix
from paceline.operators.folds import FOLD, kfold_ranges, time_folds
from paceline.operators.metrics import regression_metrics, score_summary
from paceline.schema import RACE, ROW_ID, RaceColumns, history_order
from paceline.sources.scratch import new_folder, pin, shared_dir

PREDICTION = "prediction"

# Default training settings and the default search grid.
DEFAULT_PARAMS = {
    "n_estimators": 500,
    "learning_rate": 0.05,
    "num_leaves": 64,
    "max_depth": -1,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
    "random_state": 42,
}
DEFAULT_GRID = {
    "n_estimators": [300, 500, 700],
    "learning_rate": [0.01, 0.05, 0.1],
    "num_leaves": [32, 64, 128],
    "subsample": [0.7, 0.8, 0.9],
}

_RENAMED = {
    "n_estimators": "maxIter",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "random_state": "seed",
}
_IGNORED = {"verbose", "n_jobs"}
CHECKPOINT_EVERY = 10
#: Levels up to which a row's node is sooner found anew than kept in a table of its own, written at every level.
SHALLOW = 4
#: Folds fitted at once; each keeps its training rows cached meanwhile.
FOLDS_AT_ONCE = 2


def gbt_params(params: dict | None = None) -> dict:
    """MLlib parameters for boosted trees; both naming styles are accepted.

    MLlib grows trees level by level, so a leaf limit becomes the depth that holds as
    many leaves, and the smaller of that and a positive ``max_depth`` is used.
    """
    given = {**DEFAULT_PARAMS, **(params or {})}
    out: dict = {}
    depth = math.ceil(math.log2(given.pop("num_leaves")))
    limit = given.pop("max_depth")
    out["maxDepth"] = min(depth, limit) if limit and limit > 0 else depth
    share = given.pop("colsample_bytree")
    out["featureSubsetStrategy"] = "all" if share >= 1 else str(share)
    for name, value in given.items():
        if name not in _IGNORED:
            out[_RENAMED.get(name, name)] = value
    return out


def make_regressor(params: dict | None = None) -> GBTRegressor:
    given = gbt_params(params)
    deep = given["maxDepth"] > SHALLOW
    settings = {"cacheNodeIds": deep, "checkpointInterval": CHECKPOINT_EVERY, **given}
    return GBTRegressor(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, **settings)


def train_and_predict(
    train: DataFrame, test: DataFrame, params: dict | None = None
) -> tuple[GBTRegressionModel, DataFrame]:
    """Fit on the assembled ``train`` and add predictions to ``test``."""
    shared_dir(train.sparkSession)
    with _cached(train):
        model = make_regressor(params).fit(train)
    return model, model.transform(test)


@contextmanager
def _cached(*tables: DataFrame) -> Iterator[None]:
    """Keep tables cached meanwhile; what the caller has cached stays so afterwards."""
    own = [t for t in tables if not (t.storageLevel.useMemory or t.storageLevel.useDisk)]
    for t in own:
        t.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        for t in own:
            t.unpersist()


def evaluate(predicted: DataFrame) -> DataFrame:
    return regression_metrics(predicted, LABEL, PREDICTION)


def _of_folds(spark: SparkSession, score: Callable[[int], tuple], folds: int) -> list[tuple]:
    """The scores of all folds in order; a few are fitted at once, as one leaves cores idle between its levels."""
    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(score), range(folds)))


def temporal_cv(
    train: DataFrame,
    feature_cols: list[str],
    folds: int = 5,
    params: dict | None = None,
    race: RaceColumns = RACE,
    order: list[str] | None = None,
) -> DataFrame:
    """Expanding-window cross-validation with the encoding refitted inside every fold.

    One row per fold.  The columns needed are sorted and written once with their folds, so that
    each fold reads little but its own rows.  One pass counts the rows and the labels of every
    fold, from which the preparation of each follows (see ``ModelMatrix.fit_folds``).
    """
    order = order or history_order(train.columns, race)
    columns = list(dict.fromkeys([*feature_cols, race.pace, race.event_clean, *order]))
    folded = pin(time_folds(train.select(*columns), order, folds, unique=ROW_ID in order))
    matrices, rows_of = ModelMatrix.fit_folds(folded, feature_cols, race.pace, race.event_clean, folds=folds)

    def score(i: int) -> tuple:
        x_train = matrices[i].transform(folded.filter(F.col(FOLD) < i), race.pace)
        x_val = matrices[i].transform(folded.filter(F.col(FOLD) == i), race.pace)
        m = evaluate(train_and_predict(x_train, x_val, params)[1]).first()
        n_train = sum(n for fold, n in rows_of.items() if fold < i)
        return i, n_train, m["count"], m["MAE"], m["RMSE"]

    rows = _of_folds(train.sparkSession, score, folds)
    kinds = "fold int, n_train bigint, n_validation bigint, mae double, rmse double"
    return train.sparkSession.createDataFrame(rows, kinds)


def cv_summary(scores: DataFrame) -> DataFrame:
    """Average and population deviation of fold MAE and RMSE, as one row."""
    return scores.agg(
        F.avg("mae").alias("avg_mae"),
        F.avg("rmse").alias("avg_rmse"),
        F.stddev_pop("mae").alias("std_mae"),
        F.stddev_pop("rmse").alias("std_rmse"),
    )


def kfold_evaluation(
    assembled: DataFrame, order: list[str], folds: int = 5, params: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """Contiguous K-fold scores (negative MAE) and their summary."""
    folded = kfold_ranges(assembled, order, folds)

    def score(i: int) -> tuple:
        fit, rest = folded.filter(F.col(FOLD) != i), folded.filter(F.col(FOLD) == i)
        return i, -evaluate(train_and_predict(fit, rest, params)[1]).first()["MAE"]

    rows = _of_folds(assembled.sparkSession, score, folds)
    scores = assembled.sparkSession.createDataFrame(rows, "fold int, score double")
    return scores, score_summary(scores, "score")


def tree_nodes(model: GBTRegressionModel) -> DataFrame:
    """One row per node of an ensemble: ``tree, node, feature, threshold, gain, rows, prediction``.

    ``feature`` is the number of the input a node splits on, null for a leaf; ``threshold`` is
    the largest value that goes left; ``rows`` are the training rows that reached the node
    (of the sample its tree was grown on). The trees are read from the stored form of the
    model, so the table is as large as they are and no node passes the driver.
    """
    spark = SparkSession.active()
    path = new_folder(spark, "trees")
    model.write().save(path)
    node, inner = F.col("nodeData"), F.col("nodeData.leftChild") >= 0
    numeric = inner & (F.col("nodeData.split.numCategories") < 0)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, node["split"]["featureIndex"]).alias("feature"),
        F.when(numeric, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, node["gain"]).alias("gain"),
        node["rawCount"].alias("rows"),
        node["prediction"].alias("prediction"),
    )


def split_counts(nodes: DataFrame, names: list[str]) -> DataFrame:
    """How often each input is split on in a table of nodes; zero for one that never is."""
    counts = nodes.where(F.col("feature").isNotNull()).groupBy("feature").agg(F.count(F.lit(1)).alias("splits"))
    inputs = nodes.sparkSession.createDataFrame(list(enumerate(names)), "place int, name string")
    found = inputs.join(counts, inputs.place == counts.feature, "left")
    return found.select(F.col("name").alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"))


def feature_importance(model: GBTRegressionModel, names: list[str], df: DataFrame, kind: str = "gain") -> DataFrame:
    """Inputs by importance, largest first: ``gain`` (sums to one) or ``split`` (number of splits)."""
    if kind == "split":
        counts = split_counts(tree_nodes(model), names)
        return counts.select("feature", F.col("splits").cast("double").alias("importance")).orderBy(
            F.desc("importance"), "feature"
        )
    if kind != "gain":
        raise ValueError(f"unknown importance {kind!r}")
    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def grid_search(
    train: DataFrame,
    grid: dict[str, list] | None = None,
    selection: str = "train",
    order: list[str] | None = None,
    holdout_share: float = 0.2,
    folds: int = 3,
    parallelism: int = 1,
) -> tuple[dict, DataFrame]:
    """Try every combination, lowest MAE wins; returns the best settings and all scores.

    ``selection`` says what is scored: the training rows themselves (``train``), the
    last rows in ``order`` (``holdout``), or expanding-window folds (``cv``).  The latter two
    need an ``order``: without one, nothing says which rows come later.

    Up to ``parallelism`` combinations are fitted at once, over one cached input: the late
    levels of a tree leave most of a cluster idle.  Seeds are fixed, so scores and the winner
    (of equal ones the first in the grid) don't depend on it.
    """
    if selection in ("holdout", "cv") and not order:
        raise ValueError(f"selection {selection!r} needs an order")
    grid = {k: list(v) for k, v in (grid or DEFAULT_GRID).items()}
    if selection == "train":
        pairs = [(train, train)]
    elif selection == "holdout":
        blocks = max(2, round(1 / holdout_share))
        parts = kfold_ranges(train, order, blocks)
        pairs = [(parts.filter(F.col(FOLD) < blocks - 1), parts.filter(F.col(FOLD) == blocks - 1))]
    elif selection == "cv":
        parts = time_folds(train, order, folds)
        pairs = [(parts.filter(F.col(FOLD) < i), parts.filter(F.col(FOLD) == i)) for i in range(folds)]
    else:
        raise ValueError(f"unknown selection {selection!r}")

    evaluator = RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="mae")
    candidates = [dict(zip(grid, values)) for values in product(*grid.values())]

    def mean_error(params: dict) -> float:
        scores = [evaluator.evaluate(train_and_predict(fit, score, params)[1]) for fit, score in pairs]
        return sum(scores) / len(scores)

    tables = list({id(t): t for pair in pairs for t in pair}.values())
    with _cached(*tables), ThreadPoolExecutor(max(1, parallelism)) as pool:
        for t in tables:
            t.count()  # else candidates that start together fill the cache several times
        task = inheritable_thread_target(train.sparkSession)(mean_error)
        tried = list(zip(candidates, pool.map(task, candidates)))
    best = min(tried, key=lambda t: t[1])[0]
    rows = [(", ".join(f"{k}={v}" for k, v in p.items()), float(s)) for p, s in tried]
    table = train.sparkSession.createDataFrame(rows, "params string, mae double")
    return {**DEFAULT_PARAMS, **best}, table.orderBy("mae", "params")


def save_model(model: GBTRegressionModel, matrix: ModelMatrix, path: str) -> None:
    """Store the trees and everything needed to prepare new rows for them."""
    PipelineModel([model]).write().overwrite().save(f"{path}/trees")
    matrix.save(f"{path}/matrix")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, ModelMatrix]:
    return PipelineModel.load(f"{path}/trees"), ModelMatrix.load(spark, f"{path}/matrix")


def score_rows(df: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Predictions of a stored model for new feature rows.

    The event name is encoded with the stored weights, so a new event gets the training mean.
    """
    model, matrix = load_model(df.sparkSession, path)
    return model.transform(matrix.transform(df, target=None, keep=keep)).drop(FEATURES)
