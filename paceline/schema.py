"""Column names and schemas of the race tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The thirteen columns of the raw results file, in file order.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("Year of event", T.IntegerType()),
        T.StructField("Event dates", T.StringType()),
        T.StructField("Event name", T.StringType()),
        T.StructField("Event distance/length", T.StringType()),
        T.StructField("Event number of finishers", T.IntegerType()),
        T.StructField("Athlete performance", T.StringType()),
        T.StructField("Athlete club", T.StringType()),
        T.StructField("Athlete country", T.StringType()),
        T.StructField("Athlete year of birth", T.DoubleType()),
        T.StructField("Athlete gender", T.StringType()),
        T.StructField("Athlete age category", T.StringType()),
        T.StructField("Athlete average speed", T.DoubleType()),
        T.StructField("Athlete ID", T.LongType()),
    ]
)

# The fifteen model inputs, before the encoded event name is added.
FEATURE_COLS = [
    "Year of event",
    "Event number of finishers",
    "Athlete gender",
    "Event distance_numeric",
    "cum_num_races",
    "cum_avg_pace",
    "cum_best_pace",
    "cum_ws_finishes",
    "cum_total_distance",
    "cum_avg_distance",
    "cum_shortest_distance",
    "cum_longest_distance",
    "recent_avg_distance",
    "distance_gap_from_longest",
    "athlete_age",
]
ENCODED_COL = "Race_Pace_Mean_Encoded"
CATEGORICAL_COLS = ["Athlete gender"]

ROW_ID = "row_id"


@dataclass(frozen=True)
class RaceColumns:
    """Names of the columns the race operators read; replace any to use other tables."""

    entity: str = "Athlete ID"
    year: str = "Year of event"
    dates: str = "Event dates"
    event: str = "Event name"
    event_clean: str = "Event_name_clean"
    distance_text: str = "Event distance/length"
    distance: str = "Event distance_numeric"
    performance: str = "Athlete performance"
    finishers: str = "Event number of finishers"
    birth_year: str = "Athlete year of birth"
    gender: str = "Athlete gender"
    age_category: str = "Athlete age category"
    club: str = "Athlete club"
    country: str = "Athlete country"
    pace: str = "pace_min_per_km"


RACE = RaceColumns()


def history_order(columns: list[str], race: RaceColumns = RACE) -> list[str]:
    """Order of one entity's rows: year, event name, then tiebreakers.

    Ends in the unique ``row_id`` when the table has one, which makes every
    window value deterministic and lets any group of rows be cut anywhere.
    """
    ties = [race.dates, race.distance_text, race.performance, race.finishers, ROW_ID]
    return [race.year, race.event] + [c for c in ties if c in columns]


def schema_problems(actual: T.StructType, expected: T.StructType) -> list[str]:
    """Columns of ``expected`` that ``actual`` lacks or holds with another type."""
    have = {f.name: f.dataType for f in actual.fields}
    problems = []
    for f in expected.fields:
        if f.name not in have:
            problems.append(f"missing column {f.name}")
        elif have[f.name] != f.dataType:
            problems.append(
                f"column {f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}"
            )
    return problems


# Output of the feature stage, without the columns carried along from the raw table.
FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("Event_name_clean", T.StringType()),
        T.StructField("Event distance_numeric", T.DoubleType()),
        T.StructField("performance_seconds", T.LongType()),
        T.StructField("pace_min_per_km", T.DoubleType()),
        T.StructField("cum_num_races", T.LongType()),
        T.StructField("cum_avg_pace", T.DoubleType()),
        T.StructField("cum_best_pace", T.DoubleType()),
        T.StructField("cum_total_distance", T.DoubleType()),
        T.StructField("cum_shortest_distance", T.DoubleType()),
        T.StructField("cum_longest_distance", T.DoubleType()),
        T.StructField("cum_avg_distance", T.DoubleType()),
        T.StructField("cum_ws_finishes", T.LongType()),
        T.StructField("recent_avg_distance", T.DoubleType()),
        T.StructField("distance_gap_from_longest", T.DoubleType()),
        T.StructField("athlete_age", T.LongType()),
    ]
)
