"""Splits of a feature table in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.operators.history import TARGET_EVENT
from paceline.operators.joins import free_names, join_lookup
from paceline.schema import FEATURE_COLS, RACE, RaceColumns
from paceline.sources.scratch import pin

TEST_YEAR = 2022  # fixed value


def matches(column: str, event: str, case_insensitive: bool = False, literal: bool = True) -> Column:
    """Whether a name contains ``event`` as it stands, or with ``literal=False`` as a regular expression."""
    if not literal:
        return F.col(column).rlike(("(?i)" if case_insensitive else "") + event)
    return F.lower(column).contains(event.lower()) if case_insensitive else F.col(column).contains(event)


def split_by_target_event(
    df: DataFrame,
    test_year: int = TEST_YEAR,
    target_event: str = TARGET_EVENT,
    race: RaceColumns = RACE,
    count_col: str = "cum_num_races",
    case_insensitive: bool = False,
    literal: bool = True,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Test on one event of one year; train on what those entities did before it
    and on all rows of everyone else.

    An entity with several test rows is cut at the last of them; a null entity is one like
    any other.  The cutoffs are written and counted: few are broadcast, so the table isn't
    shuffled; with more, hot entities are joined apart.
    """
    is_test = (F.col(race.year) == test_year) & matches(race.event, target_event, case_insensitive, literal)
    test = df.filter(is_test)
    (cutoff,) = free_names(df.columns, ["_cutoff"])
    cutoffs = pin(test.groupBy(race.entity).agg(F.max(count_col).alias(cutoff)))
    joined = join_lookup(df, cutoffs, {race.entity: race.entity}, null_safe=True)
    keep = F.col(cutoff).isNull() | (F.col(count_col) < F.col(cutoff))
    train = joined.filter(keep).select(*df.columns)
    return train, test, list(FEATURE_COLS)


def split_by_year(
    df: DataFrame,
    test_year: int = TEST_YEAR,
    target_event: str | None = None,
    race: RaceColumns = RACE,
    case_insensitive: bool = False,
    literal: bool = True,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Test on one year (optionally one event of it); train on all earlier years."""
    test = df.filter(F.col(race.year) == test_year)
    if target_event:
        test = test.filter(matches(race.event, target_event, case_insensitive, literal))
    train = df.filter(F.col(race.year) < test_year)
    return train, test, list(FEATURE_COLS)
