"""Row filters and the cleaning stage: raw results to usable race rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import numeric, text
from paceline.operators.joins import free_names
from paceline.operators.ordered import MAX_GROUP_ROWS, broadcast_if, group_sizes
from paceline.schema import RACE, RaceColumns, history_order
from paceline.sources.scratch import pin

# Events that are no races (matched anywhere in the name, in any case).
EVENTS_TO_REMOVE = ["Stockholm Fotrally (SWE)", "Maratonmarschen Stockholm (SWE)"]
MAX_KM = 250

# Event name -> (distance in km, distance text) that replace wrong entries.
DISTANCE_CORRECTIONS = {"Ultraroztocze 120km (POL)": (120.0, "120km")}


def keep_distance_races(df: DataFrame, column: str) -> DataFrame:
    """Drop time-based and stage events, and rows without a distance text."""
    c = F.lower(F.col(column))
    return df.filter(~c.rlike(f"{text.TIME_BASED}|{text.STAGE_BASED}"))


def drop_named_events(df: DataFrame, column: str, names: list[str] | None = None) -> DataFrame:
    """Drop rows whose event name contains any of ``names``, ignoring case."""
    names = EVENTS_TO_REMOVE if names is None else names
    if not names:
        return df.filter(F.col(column).isNotNull())
    pattern = "(?i)" + "|".join(re.sub(r"([().\[\]{}*+?^$|\\])", r"\\\1", n) for n in names)
    return df.filter(~F.col(column).rlike(pattern))


def drop_listed_events(df: DataFrame, column: str, listed: DataFrame, name: str) -> DataFrame:
    """Drop rows whose event name is on a list, whatever its length; rows without a name go too.

    Names are the same if they are equal without case and without white space around or
    repeated inside.  A list counted to be short is broadcast, a longer one shuffled; either
    way each name is hashed once, where a pattern would be tried name by name.
    """

    def key(c: str) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.col(f"`{c}`"), r"\s+", " ")))

    (wanted,) = free_names(df.columns, ["_listed"])
    names = pin(listed.select(key(name).alias(wanted)).where(F.col(wanted).isNotNull()).distinct())
    names = broadcast_if(names, names.count())
    return df.where(F.col(f"`{column}`").isNotNull()).join(names, key(column) == F.col(wanted), "left_anti")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``columns`` (NaN stays)."""
    return df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def single_valued_entities(
    df: DataFrame,
    entity: str,
    attribute: str,
    order: list[str] | None = None,
    size_source: DataFrame | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Keep the rows of entities that show exactly one value of ``attribute``.

    Null counts as a value of its own, and a null entity is a group of its own.
    While no entity is larger than ``max_group_rows``, one window does it; given the
    ``order`` of later history windows, they reuse its shuffle and its sort.  With
    larger entities, conflicts come from a map-side combined aggregate and an anti join,
    which adaptive execution can split.  ``size_source`` is a cheaper table to measure
    group sizes on, whose groups are at least as large.
    """
    value = F.col(attribute)
    sizes = group_sizes(df if size_source is None else size_source, entity, max_group_rows)
    if sizes.largest <= max_group_rows:
        w = Window.partitionBy(entity)
        if order:
            w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        known, rows = F.count(value).over(w), F.count(F.lit(1)).over(w)
        # The equality is null for an entity without any known value.
        one = F.coalesce(F.min(value).over(w) == F.max(value).over(w), F.lit(True))
        kept = df.withColumn("_one_value", one & ((known == 0) | (known == rows)))
        return kept.filter("_one_value").drop("_one_value")

    seen = df.groupBy(F.col(entity).alias("_entity")).agg(
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.count(value).alias("_known"),
        F.count(F.lit(1)).alias("_rows"),
    )
    mixed = (F.col("_lo") != F.col("_hi")) | ((F.col("_known") > 0) & (F.col("_known") < F.col("_rows")))
    conflicts = seen.filter(mixed).select("_entity")
    return df.join(conflicts, df[entity].eqNullSafe(conflicts["_entity"]), "left_anti")


def entities_not_in(df: DataFrame, entity: str, excluded: DataFrame) -> DataFrame:
    """Rows whose entity is not listed in ``excluded`` (same column name)."""
    return df.join(excluded.select(entity).distinct(), entity, "left_anti")


def with_distance_km(
    df: DataFrame,
    race: RaceColumns = RACE,
    corrections: dict[str, tuple[float, str]] | None = None,
    legacy_units: bool = False,
) -> DataFrame:
    """Distance text to kilometres, with fixed corrections for named events."""
    source, name = F.col(race.distance_text), F.col(race.event)
    number = text.distance_number(source)
    km, label = text.miles_to_km(source, number, legacy_units), source
    for event, (fixed_km, fixed_label) in (corrections or {}).items():
        km = F.when(name == event, F.lit(fixed_km)).otherwise(km)
        label = F.when(name == event, F.lit(fixed_label)).otherwise(label)
    return df.withColumns(
        {
            "distance_numeric": number,
            "distance_str": F.lower(source),
            race.distance: km,
            race.distance_text: label,
        }
    )


def evaluate_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep Catalyst from copying the expressions of ``columns`` into later filters.

    A filter over a computed column is normally pushed below it, which repeats every
    regular expression behind the column for each mention.  Rows made by a generator
    stop that, at the cost of one struct per row.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    packed = F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in columns])))
    return df.select(*others, packed).select(*df.columns)


def missing_distance_events(df: DataFrame, race: RaceColumns = RACE) -> DataFrame:
    """Distinct (event, year) of rows without a distance text."""
    return df.filter(F.col(race.distance_text).isNull()).select(race.event, race.year).distinct()


def names_with_digits(df: DataFrame, column: str, digits: int = 4, first: int = 10) -> DataFrame:
    """The alphabetically first distinct names that still hold a run of digits."""
    held = df.filter(F.col(column).rlike(rf"\d{{{digits}}}")).select(column).distinct()
    return held.orderBy(column).limit(first)


def clean_races(
    df: DataFrame,
    race: RaceColumns = RACE,
    events_to_remove: list[str] | None = None,
    corrections: dict[str, tuple[float, str]] | None = None,
    max_km: float = MAX_KM,
    legacy_units: bool = False,
    strict_durations: bool = False,
    max_group_rows: int = MAX_GROUP_ROWS,
    size_source: DataFrame | None = None,
) -> DataFrame:
    """The cleaning stage: filters first, then parsers, then the single-gender rule.

    Group sizes are measured on the uncleaned table (or on ``size_source``), which reads
    one column only.
    """
    kept = df.drop(race.club, race.country)
    kept = require(kept, [race.gender, race.birth_year, race.age_category, race.performance])
    kept = keep_distance_races(kept, race.distance_text)
    kept = drop_named_events(kept, race.event, events_to_remove)
    parse = text.duration_seconds_strict if strict_durations else text.duration_seconds
    parsed = with_distance_km(kept, race, corrections, legacy_units).withColumn(
        "performance_seconds", parse(F.col(race.performance))
    )
    parsed = evaluate_once(parsed, [race.distance, "performance_seconds"])
    whole = require(parsed, ["performance_seconds", race.distance]).filter(
        F.col(race.distance).between(0, max_km)
    )
    whole = whole.withColumn(
        race.pace, numeric.pace_min_per_km(F.col("performance_seconds"), F.col(race.distance))
    )
    whole = require(whole, [race.pace])
    consistent = single_valued_entities(
        whole, race.entity, race.gender, history_order(df.columns, race),
        df if size_source is None else size_source, max_group_rows,
    )
    return consistent.withColumns(
        {
            race.event_clean: text.clean_event_name(F.col(race.event)),
            "performance_clean": text.clean_performance(F.col(race.performance)),
        }
    )


def distinct_reduction(df: DataFrame, before: str, after: str) -> DataFrame:
    """Distinct values of two columns and the reduction in percent, in one scan."""
    counts = df.agg(
        F.count_distinct(before).alias("distinct_before"), F.count_distinct(after).alias("distinct_after")
    )
    removed = F.col("distinct_before") - F.col("distinct_after")
    return counts.withColumn("reduction_pct", F.try_divide(removed, F.col("distinct_before")) * 100)
