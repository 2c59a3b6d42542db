"""Column expressions over words and lines, shared by the operators that stay in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate words (fixed by the contract): blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """All words of a text in order, unchanged; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a text are in a set."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def indices(first: Column, count: Column) -> Column:
    """``first, first + 1, ...``: so many integers, none if the count isn't above zero."""
    empty = F.array().cast("array<int>")
    return F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(empty)
