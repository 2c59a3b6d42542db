"""A race-results view over the ``orders`` and ``customer`` tables.

Every value follows from the order and its customer by plain arithmetic, so the view
grows with the tables and can be written the same way in other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators.clean import evaluate_once
from paceline.schema import RAW_SCHEMA, ROW_ID
from paceline.sources.tables import spread

TEST_YEAR = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def race_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen raw columns plus the order key as a unique ``row_id``."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    year = F.year("o_orderdate")

    def text(n):
        return n.cast("string")

    def two_digits(n):
        return F.lpad(text(n), 2, "0")

    name = (
        F.when(k % 9 == 0, "Western States 100 (USA)")
        .when(k % 31 == 1, "Stockholm Fotrally (SWE)")
        .when(k % 31 == 2, "maratonmarschen stockholm (swe)")
        .when(k % 23 == 3, "Ultraroztocze 120km (POL)")
        .when(k % 29 == 4, F.concat(F.lit("9ª Ultra São Paulo - "), text(year)))
        .otherwise(F.concat(text(k % 40), F.lit("th Trail Run ("), text(year), F.lit(") (GER)")))
    )
    distance = (
        F.when(k % 12 == 0, "6h")
        .when(k % 12 == 1, "100km/2Etappen")
        .when(k % 12 == 2, "300km")
        .when(k % 12 == 3, "50mi")
        .when(k % 12 == 4, "50K")
        .when(k % 61 == 7, F.lit(None))
        .otherwise(F.concat(text(30 + k % 120), F.lit("km")))
    )
    clock = F.concat(
        two_digits(3 + k % 20), F.lit(":"), two_digits(k % 60), F.lit(":"), two_digits((k * 7) % 60), F.lit(" h")
    )
    performance = (
        F.when(k % 17 == 5, "123.4 km").when(k % 13 == 0, F.concat(F.lit("1d "), clock)).otherwise(clock)
    )
    gender = F.when(F.when(c % 29 == 0, k % 2).otherwise(c % 2) == 0, "M").otherwise("F")
    columns = {
        "Year of event": year.cast("int"),
        "Event dates": F.date_format("o_orderdate", "dd.MM.yyyy"),
        "Event name": name,
        "Event distance/length": distance,
        "Event number of finishers": (50 + k % 500).cast("int"),
        "Athlete performance": performance,
        "Athlete club": F.lit(None).cast("string"),
        "Athlete country": F.lit(None).cast("string"),
        "Athlete year of birth": F.when(c % 37 != 0, (1940 + c % 45).cast("double")),
        "Athlete gender": gender,
        "Athlete age category": F.concat(gender, text(F.floor((c % 45) / 10) * 10)),
        "Athlete average speed": F.lit(None).cast("double"),
        "Athlete ID": c,
    }
    view = joined.select(*[columns[f.name].alias(f.name) for f in RAW_SCHEMA.fields], k.alias(ROW_ID))
    # Behaves like a stored table: the expressions above are not copied into later filters.
    return evaluate_once(view, [n for n, c in columns.items() if n not in ("Athlete ID", "Year of event")])


def race_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity column alone, at least as many rows per entity as the view: measures group sizes."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("Athlete ID"))
