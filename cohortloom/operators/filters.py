"""Row filters and code-list operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import flag_is_one, text_contains_any


def flagged_abnormal(events: DataFrame, flag: str = "FLAG") -> DataFrame:
    """Events whose flag says abnormal."""
    return events.where(F.col(flag).contains("abnormal"))


def flagged_any(events: DataFrame, flag: str = "FLAG") -> DataFrame:
    """Events with any flag at all."""
    return events.where(F.col(flag).isNotNull())


def flagged_one(events: DataFrame, flag: str = "WARNING") -> DataFrame:
    """Events whose numeric text flag is 1."""
    return events.where(flag_is_one(F.col(flag)))


def equal_to(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def title_search(lookup: DataFrame, title: str, words: Sequence[str]) -> DataFrame:
    """Lookup rows whose title holds any of the words, case-sensitive."""
    return lookup.where(text_contains_any(F.col(title), words))


def code_table(
    spark: SparkSession, codes: Mapping[str, str] | Iterable[str], code: str = "ITEMCODE", name: str = "NAME"
) -> DataFrame:
    """A code list as a table: ``(code, name)`` from a mapping, ``(code)`` from plain codes."""
    fields = [T.StructField(code, T.StringType(), True)]
    if isinstance(codes, Mapping):
        fields.append(T.StructField(name, T.StringType(), True))
        rows = list(codes.items())
    else:
        rows = [(c,) for c in codes]
    return spark.createDataFrame(rows, T.StructType(fields))


def _listed(code: str, codes: Iterable) -> F.Column:
    # codes are text, whatever type the list was written in
    return F.col(code).cast("string").isin([str(c) for c in codes])


def _as_text(codes: DataFrame, code: str) -> DataFrame:
    return codes.select(F.col(code).cast("string").alias("_listed"))


def codes_in_set(events: DataFrame, codes: DataFrame | Iterable, code: str) -> DataFrame:
    """Events whose code is listed.

    A Python list becomes an IN predicate that reaches the file scan. A table (one column named ``code``) becomes
    a semi join whose strategy Spark picks from the sizes it sees. Either way codes are compared as text.
    """
    if isinstance(codes, DataFrame):
        return events.join(_as_text(codes, code), F.col(code).cast("string") == F.col("_listed"), "left_semi")
    return events.where(_listed(code, codes))


def codes_not_in_set(events: DataFrame, codes: DataFrame | Iterable, code: str) -> DataFrame:
    """Events whose code is not listed; events without a code are kept."""
    if isinstance(codes, DataFrame):
        return events.join(_as_text(codes, code), F.col(code).cast("string") == F.col("_listed"), "left_anti")
    return events.where(F.col(code).isNull() | ~_listed(code, codes))
