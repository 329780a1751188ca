"""Joins of subjects, stays, events, lookups and count matrices.

Joins of two stored tables are left plain: Spark picks the strategy from the sizes it sees and splits skewed
partitions of a sort-merge join by itself. It cannot do that where one side is an aggregate on the join key, since
no shuffle then stands between the aggregate and the join; :func:`join_to_unique` covers that case.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.counts import top_k_counts
from cohortloom.operators.filters import code_table, title_search
from cohortloom.session import broadcast_rows, materialize


def join_to_unique(many: DataFrame, one: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key (``how``: inner or left_semi).

    ``one`` is written out first. Left in the plan, an aggregate on the join key would hand on its partitioning, and Spark
    splits a skewed partition only where a shuffle of its own stands on both sides of the join. With it written, the
    size of ``one`` is known too, and any key of ``many`` that is heavy, of whatever size, is split at run time.
    """
    return many.join(materialize(one), on, how)


def patient_admissions(patients: DataFrame, admissions: DataFrame, on: str = "SUBJECT_ID") -> DataFrame:
    """One row per admission of a known patient, with a single key column."""
    return patients.join(admissions, on, "inner")


def deaths_only(patients: DataFrame, admissions: DataFrame, death: str, on: str = "SUBJECT_ID") -> DataFrame:
    """Admissions of known patients that ended in a recorded death."""
    return patient_admissions(patients, admissions.where(F.col(death).isNotNull()), on)


def attach_matrix(
    admissions: DataFrame, matrix: DataFrame, on: str = "SUBJECT_ID"
) -> DataFrame:
    """Admission rows with the code counts of their subject.

    The grain is the grain of the key: by subject, every admission carries the counts of all admissions of the
    subject; build the matrix on the admission key and pass that key to count within the admission.
    """
    return join_to_unique(admissions, matrix, on, "inner")


def cohort_members(stays: DataFrame, on: str = "SUBJECT_ID", copies: str = "cohort_rows") -> DataFrame:
    """One row per subject of a cohort list, with the number of rows the subject has in it."""
    return stays.groupBy(on).agg(F.count(F.lit(1)).alias(copies))


def restrict_to_cohort(
    events: DataFrame, members: DataFrame, on: str = "SUBJECT_ID"
) -> DataFrame:
    """Events of cohort subjects, each once; ``members`` holds one row per subject."""
    return join_to_unique(events, members.select(on), on, "left_semi")


def cohort_events(
    events: DataFrame, members: DataFrame, on: str = "SUBJECT_ID"
) -> DataFrame:
    """Events of cohort subjects, each once, with the subject's number of cohort rows.

    A cohort list with one row per stay would repeat every event once per stay of its subject. The repeat count
    says the same in one row, so a subject with many stays and many events does not multiply out: sums weighted
    by it equal the sums over the repeated rows.
    """
    return join_to_unique(events, members, on, "inner")


def diagnoses_by_title(
    diagnoses: DataFrame, lookup: DataFrame, words: Sequence[str], code: str = "ICD9_CODE", title: str = "SHORT_TITLE"
) -> DataFrame:
    """Diagnoses whose code has a title with any of the words, with the columns of the lookup."""
    return diagnoses.join(title_search(lookup, title, words), code, "inner")


def code_overlap_count(lookup: DataFrame, code: str, codes: Iterable[str], name: str = "n") -> DataFrame:
    """Number of lookup rows whose code is in a code list, by a join with the list as a table."""
    listed = list(codes)
    table = broadcast_rows(code_table(lookup.sparkSession, listed, code), len(listed))
    return lookup.select(code).join(table, code).agg(F.count(F.lit(1)).alias(name))


def top_diagnoses_titled(diagnoses: DataFrame, lookup: DataFrame, code: str, title: str, k: int) -> DataFrame:
    """The k most frequent diagnosis codes with their titles."""
    top = top_k_counts(diagnoses, code, k)
    return lookup.select(code, title).join(broadcast_rows(top, k), code)


def whitelist(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose text is exactly one of the allowed ones."""
    return df.where(F.col(column).isin(list(allowed)))
