"""Run metrics as tables: the latest result and an append-only history."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, run string, ts timestamp, metric string, value double"


def run_rows(
    spark: SparkSession, run: str, run_id: str, metrics: dict[str, float], at: datetime | None = None
) -> DataFrame:
    """One row per metric of one run; ``run_id`` is the caller's (a commit, for example)."""
    at = at or datetime.now(timezone.utc)
    rows = [(run_id, run, at, name, None if v is None else float(v)) for name, v in metrics.items()]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def log_run(
    spark: SparkSession,
    output_dir: str,
    run: str,
    run_id: str,
    metrics: dict[str, float],
    at: datetime | None = None,
) -> DataFrame:
    """Overwrite ``latest`` and append to ``history`` below ``output_dir``."""
    rows = run_rows(spark, run, run_id, metrics, at).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{output_dir}/latest")
    rows.write.mode("append").parquet(f"{output_dir}/history")
    return rows


def run_history(spark: SparkSession, output_dir: str) -> DataFrame:
    return spark.read.parquet(f"{output_dir}/history").orderBy("ts", "run_id", "metric")


def latest_run(spark: SparkSession, output_dir: str) -> DataFrame:
    return spark.read.parquet(f"{output_dir}/latest").orderBy(F.col("metric"))
