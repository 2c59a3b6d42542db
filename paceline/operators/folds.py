"""Fold numbers for temporal and plain cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators.ordered import global_index

INDEX = "row_index"
FOLD = "fold"


def _needs_rows(n: int, least: int) -> None:
    if n < least:
        raise ValueError(f"{n} rows are too few: at least {least} are needed")


def time_folds(df: DataFrame, order: list[str], folds: int = 5, unique: bool = True) -> DataFrame:
    """Add the global time index and the fold in which a row is validated.

    Rows are cut into ``folds`` equal last blocks, numbered 0 .. folds-1, and a first
    block, numbered -1, that also takes the remainder.  A row trains every fold with a
    higher number, so one column describes all expanding-window folds.
    """
    indexed = global_index(df, order, INDEX, unique=unique)
    n = indexed.count()
    _needs_rows(n, folds + 1)
    size = n // (folds + 1)
    start = n - folds * size
    place = F.floor((F.col(INDEX) - start) / size)
    return indexed.withColumn(FOLD, F.when(F.col(INDEX) < start, -1).otherwise(place).cast("int"))


def kfold_ranges(df: DataFrame, order: list[str], folds: int = 5, unique: bool = True) -> DataFrame:
    """Add the index and a contiguous fold; the first ``n mod folds`` folds get one row more."""
    indexed = global_index(df, order, INDEX, unique=unique)
    n = indexed.count()
    _needs_rows(n, folds)
    size, extra = divmod(n, folds)
    long_part = extra * (size + 1)
    place = F.when(F.col(INDEX) < long_part, F.floor(F.col(INDEX) / (size + 1))).otherwise(
        extra + F.floor((F.col(INDEX) - long_part) / size)
    )
    return indexed.withColumn(FOLD, place.cast("int"))


def fold_sizes(folded: DataFrame, folds: int) -> DataFrame:
    """Training and validation rows of each expanding-window fold."""
    counts = {r[FOLD]: r["n"] for r in folded.groupBy(FOLD).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(i, sum(n for f, n in counts.items() if f < i), counts.get(i, 0)) for i in range(folds)]
    return folded.sparkSession.createDataFrame(rows, "fold int, n_train bigint, n_validation bigint")
