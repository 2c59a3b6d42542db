"""Readers and writers: raw CSV, stage Parquet, result CSV files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions.text import null_if_token
from paceline.schema import RAW_SCHEMA, ROW_ID

# Spellings of a missing value in the raw file.
NULL_TOKENS = ["", "NULL", "null", "NA"]


def type_text_columns(
    df: DataFrame, schema: T.StructType = RAW_SCHEMA, null_tokens: list[str] | None = None
) -> DataFrame:
    """Text columns to the declared types; null tokens and malformed cells become null."""
    tokens = NULL_TOKENS if null_tokens is None else null_tokens
    typed = []
    for f in schema.fields:
        c = null_if_token(F.col(f"`{f.name}`"), tokens)
        typed.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*typed)


def read_races_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_SCHEMA,
    null_tokens: list[str] | None = None,
    multi_line: bool = False,
    row_id: bool = False,
) -> DataFrame:
    """Scan a results CSV with a declared schema; no inference pass, columns by position.

    Columns are read as text and typed with ``try_cast``, so one malformed cell costs
    that cell only.  ``row_id`` adds a unique number taken from file split and line
    order, which repeats on a retried task; it makes every later order total.
    ``multi_line`` allows line breaks inside quotes, but makes files unsplittable.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
        .csv(path)
    )
    typed = type_text_columns(raw, schema, null_tokens)
    return typed.withColumn(ROW_ID, F.monotonically_increasing_id()) if row_id else typed


def malformed_cells(
    df_text: DataFrame, schema: T.StructType = RAW_SCHEMA, null_tokens: list[str] | None = None
) -> DataFrame:
    """Per typed column, how many text cells are neither missing nor parseable."""
    tokens = NULL_TOKENS if null_tokens is None else null_tokens
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    counts = []
    for f in typed:
        c = null_if_token(F.col(f"`{f.name}`"), tokens)
        bad = c.isNotNull() & c.try_cast(f.dataType).isNull()
        counts.append(F.count(F.when(bad, 1)))
    wide = df_text.agg(*[c.alias(f"_c{i}") for i, c in enumerate(counts)])
    rows = [
        F.struct(F.lit(f.name).alias("column"), F.col(f"_c{i}").alias("malformed")) for i, f in enumerate(typed)
    ]
    return wide.select(F.inline(F.array(*rows)))


def bad_rows(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_SCHEMA,
    null_tokens: list[str] | None = None,
    header: bool = True,
) -> DataFrame:
    """The lines of a CSV that don't parse: ``file, line, problem, cells, columns, record``.

    ``problem`` is ``unclosed_quote`` (an odd number of quotes), ``too_few`` or ``too_many``
    cells, or ``malformed`` when the ``columns`` named hold neither their type nor a missing
    value.  ``record`` is the line as it stands (what a reader keeps in its corrupt-record
    column), ``cells`` how many it has, ``line`` its number in the file, from 1.

    Files are read in splits: a line's number is its place in the split, from row ids that
    follow file order, plus the lines of the file's earlier splits, of which there are as many
    as the scan has.  Blank lines are no records.  Only the split sums and the bad lines move.
    """
    tokens = NULL_TOKENS if null_tokens is None else null_tokens
    lines = spark.read.text(path).select(
        F.col("value").alias("record"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))

    record = F.col("record")
    quotes = F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))
    # Whatever is quoted counts as one cell; a quote inside quotes is written twice.
    bare = F.regexp_replace(record, '"[^"]*"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    as_text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema.fields))])
    parsed = F.from_csv(record, as_text.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"'})
    wrong = []
    for i, f in enumerate(schema.fields):
        if not isinstance(f.dataType, T.StringType):
            c = null_if_token(F.col("_cells").getField(f"c{i}"), tokens)
            wrong.append(F.when(c.isNotNull() & c.try_cast(f.dataType).isNull(), F.lit(f.name)))
    expected = len(schema.fields)
    problem = (
        F.when(F.col("_quotes") % 2 == 1, "unclosed_quote")
        .when(F.col("cells") < expected, "too_few")
        .when(F.col("cells") > expected, "too_many")
        .when(F.size("columns") > 0, "malformed")
    )
    whole = (F.col("_quotes") % 2 == 0) & (F.col("cells") == expected)
    named = F.filter(F.array(*wrong), lambda c: c.isNotNull()) if wrong else F.array().cast("array<string>")
    found = (
        lines.where(F.trim(record) != "")
        .withColumns({"_quotes": quotes, "cells": cells, "_cells": parsed})
        .withColumn("columns", F.when(whole, named))
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
    )
    placed = found.join(splits, ["file", "_start"]).withColumn(
        "line", F.col("_before") + F.col("_id") - F.col("_first") + 1
    )
    out = placed.where(F.col("line") > 1) if header else placed
    return out.select("file", "line", "problem", "cells", "columns", "record")


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types (costs an extra pass over the file)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_stage(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    then_by: list[str] | None = None,
    rows: Observation | None = None,
) -> DataFrame:
    """Write one stage as snappy Parquet and return it read back, so it is computed once.

    With ``partition_by``, rows are first ranged on it and ``then_by``: a large partition
    is spread over many tasks, and a task writes files for few partitions only.  ``rows``
    gets the number of rows while they are written.
    """
    if partition_by:
        df = df.repartitionByRange(partition_by, *(then_by or []))
    if rows is not None:  # above the range shuffle, whose sampling must not count
        df = df.observe(rows, F.count(F.lit(1)).alias("rows"))
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Lazy scan of a stage; ``FileNotFoundError`` when it is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no stage table at {path}") from e
        raise


def write_predictions_csv(predicted: DataFrame, path: str, y_true: str, y_pred: str) -> None:
    """Actual, predicted and error columns as CSV."""
    out = predicted.select(
        F.col(y_true).alias("actual_pace"),
        F.col(y_pred).alias("predicted_pace"),
        (F.col(y_true) - F.col(y_pred)).alias("error"),
    )
    out.write.mode("overwrite").option("header", True).csv(path)


def write_importance_csv(importance: DataFrame, path: str) -> None:
    """Feature importance (one row per model input), sorted, as a single CSV part."""
    ordered = importance.orderBy(F.desc("importance"), "feature")
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def spread(df: DataFrame) -> DataFrame:
    """Share out a table with fewer file splits than the session has cores.

    Matters for costly expressions over small files; a table with enough splits, which
    is any large one, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
