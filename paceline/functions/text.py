"""Column functions over event names, distance texts and durations.

All are plain Column expressions, so they stay inside code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text patterns that decide the results.
# (?U) gives \d, \b and \w their Unicode meaning.
YEAR = r"(?U)\(?\b(19|20)\d{2}\b\)?"
COUNTRY_CODE = r"\([a-z]{3}\)"
EDITION = r"(?U)\d+(ª|th|st|nd|rd)"
EDITION_ORDINAL = r"(?U)\d+ª"
NOISE = [
    r"(?U)\d+\s*(km|k|miles|mile|mi|h|hr|hour|hours|stunden|óra|órás)\b",
    r"(?U)etappe[:\s]\d+",
    r"kidsrun",
    r"winter challenge",
    r"trail race",
    r"road race",
]
NOT_ALNUM = r"[^a-z0-9]+"
NOT_ALPHA = r"[^a-z]+"
DURATION = r"(?:(\d+)d\s+)?(\d+):(\d+):(\d+)"
STRICT_HMS = r"^\d{1,2}:\d{2}:\d{2}$"
STRICT_DHMS = r"^\d+d \d{2}:\d{2}:\d{2}$"
NUMBER = r"(\d+(\.\d+)?)"
PERFORMANCE_SUFFIX = r" h| km"
TIME_BASED = r"h|hr|hour|hours|d|day|days|min"
STAGE_BASED = r"/|:|x"
KM_PER_MILE = 1.60934


def group(c: Column, pattern: str, index: int) -> Column:
    """One regex group; null when there is no match or the group took no part."""
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def groups(c: Column, pattern: str, count: int) -> Column:
    """All regex groups as a struct with fields ``1`` .. ``count``."""
    return F.struct(*[group(c, pattern, i).alias(str(i)) for i in range(1, count + 1)])


def _drop_all(c: Column, patterns: list[str]) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def _tidy(c: Column, unwanted: str) -> Column:
    """Runs of unwanted characters, white space among them, become one space."""
    return F.trim(F.regexp_replace(c, unwanted, " "))


def _without_km(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit("km"), F.lit("")), F.lit("k"), F.lit(""))


def clean_event_name(c: Column) -> Column:
    """Lower-case name without years, country codes, edition numbers and punctuation."""
    return _tidy(_drop_all(F.lower(c), [YEAR, COUNTRY_CODE, EDITION]), NOT_ALNUM)


def clean_event_name_noise(c: Column, noise: list[str] | None = None) -> Column:
    """Stronger normaliser: also removes distance, duration and stage words and all digits."""
    noise = NOISE if noise is None else noise
    return _tidy(_drop_all(F.lower(c), [YEAR, EDITION_ORDINAL, COUNTRY_CODE, *noise]), NOT_ALPHA)


def with_clean_name(
    df: DataFrame,
    source: str = "Event name",
    target: str = "Event_name_clean",
    cleaner: Callable[[Column], Column] = clean_event_name,
) -> DataFrame:
    """Add a normalised name using any Column -> Column cleaner (a pandas_udf also fits)."""
    return df.withColumn(target, cleaner(F.col(source)))


def clean_performance(c: Column) -> Column:
    return F.regexp_replace(c, PERFORMANCE_SUFFIX, "")


def duration_seconds(c: Column) -> Column:
    """Seconds of the first ``[Xd ]HH:MM:SS`` in the text, null without one.

    The pattern runs once per row; the parts are cut out of its match.
    """
    found = group(c, DURATION, 0)
    clock = F.substring_index(found, "d", -1)
    has_days = found.contains("d")

    def number(part: Column) -> Column:
        return F.trim(part).try_cast("int").cast("bigint")

    days = F.when(has_days, number(F.substring_index(found, "d", 1))).otherwise(F.lit(0))
    hours = number(F.substring_index(clock, ":", 1))
    minutes = number(F.substring_index(F.substring_index(clock, ":", 2), ":", -1))
    seconds = number(F.substring_index(clock, ":", -1))
    return days * 86400 + hours * 3600 + minutes * 60 + seconds


def duration_seconds_strict(c: Column) -> Column:
    """As ``duration_seconds``, but only for texts that are a duration and nothing else."""
    bare = clean_performance(c)
    return F.when(bare.rlike(STRICT_HMS) | bare.rlike(STRICT_DHMS), duration_seconds(bare))


def distance_number(c: Column) -> Column:
    """First number of a distance text, unit ignored."""
    return group(_without_km(c), NUMBER, 1).try_cast("double")


def miles_to_km(text: Column, number: Column, legacy_units: bool = False) -> Column:
    """Convert ``number`` when ``text`` is in miles.

    The kilometre suffix is taken out before looking for an ``m``.  With
    ``legacy_units`` the unit test sees the raw text, so ``km`` counts as miles.
    """
    if legacy_units:
        in_miles = text.contains("m")
    else:
        in_miles = _without_km(text).contains("m")
    return F.when(in_miles, number * KM_PER_MILE).otherwise(number)


def distance_km(text: Column, legacy_units: bool = False) -> Column:
    return miles_to_km(text, distance_number(text), legacy_units)


def null_if_token(c: Column, tokens: list[str]) -> Column:
    """Null for any of the given spellings of a missing value."""
    return F.when(c.isin(tokens), None).otherwise(c)
