"""Scalar expressions. All are built-in Spark expressions, so none leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, negative where end is earlier (length of stay)."""
    return F.datediff(end, start)


def age_years(start: Column, end: Column) -> Column:
    """Years of 365 days from start to end, to one decimal; null where either date is."""
    return F.round(days_between(start, end) / F.lit(365.0), 1)


def mortality_target(death: Column) -> Column:
    """'Y' where a date of death is recorded, else 'N'."""
    return F.when(death.isNull(), "N").otherwise("Y")


def label_from_target(target: Column) -> Column:
    """1.0 for 'Y' and 0.0 for anything else, null included."""
    return F.when(target == "Y", 1.0).otherwise(0.0)


def flag_is_one(flag: Column) -> Column:
    """True where a flag held as text is the number 1; text that is no number never matches."""
    return flag.try_cast("int") == 1


def text_contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where the text holds any of the words, case-sensitive."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def text_matches(text: Column, pattern: str) -> Column:
    """True where the regular expression is found anywhere in the text."""
    return text.rlike(pattern)
