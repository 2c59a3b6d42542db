"""Per-entity history features that see earlier rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import numeric
from paceline.operators.ordered import MAX_GROUP_ROWS, Prior, prior_aggregates
from paceline.schema import RACE, ROW_ID, RaceColumns, history_order

TARGET_EVENT = "Western States"
NO_HISTORY = -1


def history_features(
    df: DataFrame,
    race: RaceColumns = RACE,
    order: list[str] | None = None,
    event_pattern: str = TARGET_EVENT,
    recent: int = 3,
    max_group_rows: int = MAX_GROUP_ROWS,
    size_source: DataFrame | None = None,
    literal: bool = True,
) -> DataFrame:
    """Add the eleven history and age features.

    ``event_pattern`` is text that an event name contains; a regular expression with
    ``literal=False``.

    All window features share one partitioning and one order, so Spark plans a single
    exchange and a single sort for entities of ordinary size.
    """
    order = history_order(df.columns, race) if order is None else order
    hit = "_target_event"
    specs = [
        Prior("cum_num_races", "count"),
        Prior("cum_avg_pace", "mean", race.pace),
        Prior("cum_best_pace", "min", race.pace),
        Prior("cum_total_distance", "sum", race.distance),
        Prior("cum_shortest_distance", "min", race.distance),
        Prior("cum_longest_distance", "max", race.distance),
        Prior("cum_ws_finishes", "sum", hit),
        Prior("recent_avg_distance", "recent_mean", race.distance, recent),
    ]
    event = F.col(race.event)
    found = event.contains(event_pattern) if literal else event.rlike(event_pattern)
    marked = df.withColumn(hit, found.cast("bigint"))
    out = prior_aggregates(
        marked, race.entity, order, specs, max_group_rows, size_source, unique=ROW_ID in order
    ).drop(hit)

    none = F.lit(NO_HISTORY)
    filled = {s.name: F.coalesce(F.col(s.name), none) for s in specs if s.kind != "count"}
    out = out.withColumns(filled)
    races = F.col("cum_num_races")
    return out.withColumns(
        {
            "cum_avg_distance": F.when(races > 0, F.col("cum_total_distance") / races).otherwise(F.lit(0.0)),
            "distance_gap_from_longest": F.col(race.distance) - F.col("cum_longest_distance"),
            "athlete_age": numeric.age_at(F.col(race.year), F.col(race.birth_year)),
        }
    )


def sort_for_sink(df: DataFrame, race: RaceColumns = RACE) -> DataFrame:
    """Global order by entity, year, event name and tiebreakers; use only before a write."""
    return df.orderBy(race.entity, *history_order(df.columns, race))
