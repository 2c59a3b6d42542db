"""Checks that no future information reached features or training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.history import TARGET_EVENT
from paceline.operators.split import TEST_YEAR
from paceline.schema import RACE, RaceColumns

TOLERANCE = 1e-9


def _issue(kind: Column, entity: Column, year: Column, expected: Column, actual: Column, message: Column):
    return [
        kind.cast("string").alias("type"),
        entity.cast("bigint").alias("entity_id"),
        year.cast("int").alias("year"),
        expected.cast("double").alias("expected"),
        actual.cast("double").alias("actual"),
        message.cast("string").alias("message"),
    ]


def temporal_issues(
    df: DataFrame,
    race: RaceColumns = RACE,
    count_col: str = "cum_num_races",
    mean_col: str = "cum_avg_pace",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Rows whose history features differ from a recount over strictly earlier years.

    Rows are first reduced to one per (entity, year), so the running window over an
    entity holds one row per year, however many results the entity has.  A second
    result in one year is reported by definition, since its features include the first.
    """
    yearly = df.groupBy(F.col(race.entity).alias("_entity"), F.col(race.year).alias("_year")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(race.pace).alias("_n"), F.sum(race.pace).alias("_sum")
    )
    earlier = Window.partitionBy("_entity").orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    past = yearly.select(
        "_entity",
        "_year",
        F.sum("_rows").over(earlier).alias("_races"),
        F.try_divide(F.sum("_sum").over(earlier), F.sum("_n").over(earlier)).alias("_mean"),
    ).filter(F.col("_races") > 0)

    checked = df.select(
        F.col(race.entity).alias("_id"),
        F.col(race.year).alias("_when"),
        F.col(count_col).alias("_count"),
        F.col(mean_col).alias("_avg"),
    ).join(past, F.col("_id").eqNullSafe(F.col("_entity")) & (F.col("_when") == F.col("_year")))
    races, count = F.col("_races").cast("double"), F.col("_count").cast("double")
    off = F.abs(F.col("_avg") - F.col("_mean"))
    slack = tolerance * F.greatest(F.lit(1.0), F.abs(F.col("_mean")))
    found = F.array_compact(
        F.array(
            F.when(
                ~count.eqNullSafe(races),
                F.struct(F.lit("cum_num_races_mismatch").alias("k"), races.alias("e"), count.alias("a")),
            ),
            F.when(
                off > slack,
                F.struct(
                    F.lit("cum_avg_pace_mismatch").alias("k"), F.col("_mean").alias("e"), F.col("_avg").alias("a")
                ),
            ),
        )
    )
    each = checked.select("_id", "_when", F.explode(found).alias("_f"))
    return each.select(
        *_issue(
            F.col("_f.k"), F.col("_id"), F.col("_when"), F.col("_f.e"), F.col("_f.a"), F.lit(None)
        )
    )


def temporal_summary(df: DataFrame, issues: DataFrame, race: RaceColumns = RACE) -> DataFrame:
    """One row: valid flag, issue count, entities and records checked."""
    n_issues = issues.agg(F.count(F.lit(1))).scalar()
    entity = F.col(race.entity)
    checked = df.agg(
        (F.count_distinct(entity) + F.max(F.when(entity.isNull(), 1).otherwise(0))).alias("_entities"),
        F.count(F.lit(1)).alias("_records"),
    )
    return checked.select(
        (n_issues == 0).alias("valid"),
        n_issues.alias("issues"),
        F.coalesce("_entities", F.lit(0)).alias("total_athletes_checked"),
        F.col("_records").alias("total_records_checked"),
    )


def split_issues(
    train: DataFrame,
    test: DataFrame,
    test_year: int = TEST_YEAR,
    target_event: str = TARGET_EVENT,
    race: RaceColumns = RACE,
) -> DataFrame:
    """Problems of a split: wrong test rows, or test entities with training rows
    in the test year or later."""
    year, event = F.col(race.year), F.col(race.event)
    nothing = F.lit(None)
    facts = test.agg(
        F.count(F.when(event.contains(target_event), 1)).alias("_events"),
        F.count(F.when(year == test_year, 1)).alias("_in_year"),
        F.count_distinct(year).alias("_years"),
    )
    found = F.array_compact(
        F.array(
            F.when(
                F.col("_events") == 0,
                F.struct(
                    F.lit("missing_target_event").alias("k"),
                    F.lit(f"{target_event} not found in test set").alias("m"),
                    F.lit(None).cast("double").alias("a"),
                ),
            ),
            F.when(
                F.col("_in_year") == 0,
                F.struct(
                    F.lit("missing_test_year").alias("k"),
                    F.lit(f"{test_year} not found in test years").alias("m"),
                    F.lit(None).cast("double").alias("a"),
                ),
            ),
            F.when(
                F.col("_years") > 1,
                F.struct(
                    F.lit("multiple_test_years").alias("k"),
                    F.lit("more than one test year").alias("m"),
                    F.col("_years").cast("double").alias("a"),
                ),
            ),
        )
    )
    on_test = facts.select(F.explode(found).alias("_f")).select(
        *_issue(F.col("_f.k"), nothing, nothing, nothing, F.col("_f.a"), F.col("_f.m"))
    )
    late = train.filter(year >= test_year).groupBy(race.entity).agg(F.max(year).alias("_latest"))
    tested = test.select(F.col(race.entity).alias("_tested")).distinct()
    leaked = late.join(tested, F.col(race.entity).eqNullSafe(F.col("_tested")), "left_semi").select(
        *_issue(
            F.lit("future_data_in_training"), F.col(race.entity), F.col("_latest"), nothing, nothing, nothing
        )
    )
    return leaked.unionByName(on_test)


def split_summary(train: DataFrame, test: DataFrame, issues: DataFrame, race: RaceColumns = RACE) -> DataFrame:
    """One row: valid flag, issue count, distinct test and training entities."""
    n_issues = issues.agg(F.count(F.lit(1))).scalar()
    train_entities = train.agg(F.count_distinct(race.entity)).scalar()
    return test.agg(F.count_distinct(race.entity).alias("test_athletes")).select(
        (n_issues == 0).alias("valid"),
        n_issues.alias("issues"),
        "test_athletes",
        train_entities.alias("train_athletes"),
    )


def first_issues(issues: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` issues in a fixed order."""
    return issues.orderBy("type", "entity_id", "year", "expected", "actual", "message").limit(n)
