"""From patients, admissions and coded events to training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import (
    ADMISSION_DIAGNOSES,
    RISK_MARKERS,
    TITLE_WORDS,
    age_years,
    days_between,
    label_from_target,
    mortality_target,
)
from cohortloom.operators.counts import count_matrix, distinct_values, distinct_values_by_column, one_hot_counts, union_codes
from cohortloom.operators.features import assembler, code_vectors, positions
from cohortloom.operators.filters import codes_in_set, flagged_any, title_search
from cohortloom.operators.joins import attach_matrix, diagnoses_by_title, patient_admissions, whitelist
from cohortloom.session import materialize

#: Columns that describe an admission and are no model features. The age at death is known of the dead only, so it would give
#: the label away; the age at admission is the feature.
DESCRIPTIVE = [
    "SUBJECT_ID", "GENDER", "DOB", "AGE_AT_DEATH", "TARGET", "HADM_ID", "ADMITTIME", "DEATHTIME", "ADMISSION_TYPE",
    "INSURANCE", "DIAGNOSIS",
]


def patient_facts(patients: DataFrame) -> DataFrame:
    """Patient key, gender, birth, age at death in years (null for the living) and death-in-hospital target."""
    return patients.select(
        "SUBJECT_ID",
        "GENDER",
        "DOB",
        age_years(F.col("DOB"), F.col("DOD")).alias("AGE_AT_DEATH"),
        mortality_target(F.col("DOD_HOSP")).alias("TARGET"),
    )


def admission_facts(admissions: DataFrame) -> DataFrame:
    """Admissions with the length of stay in days in place of the discharge time."""
    stay = days_between(F.col("ADMITTIME"), F.col("DISCHTIME"))
    return admissions.withColumn("LOS", stay).drop("DISCHTIME")


def with_age(rows: DataFrame) -> DataFrame:
    """Rows with the age at admission in years."""
    return rows.withColumn("AGE", age_years(F.col("DOB"), F.col("ADMITTIME")))


def patients_info(patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """Patient facts and admission facts, one row per admission."""
    return with_age(patient_admissions(patient_facts(patients), admission_facts(admissions).drop("DEATHTIME")))


def condition_codes(
    labs: DataFrame,
    diagnoses: DataFrame,
    lookup: DataFrame,
    markers: Sequence[str] | Mapping[str, str] = RISK_MARKERS,
    words: Sequence[str] = TITLE_WORDS,
    diagnosis_code: str = "ICD9_CODE",
) -> DataFrame:
    """``(SUBJECT_ID, XCODE)``: flagged labs with a listed code, and diagnoses with a title of interest."""
    lab = codes_in_set(flagged_any(labs), markers, "ITEMID").select("SUBJECT_ID", F.col("ITEMID").alias("XCODE"))
    icd = diagnoses_by_title(diagnoses, lookup, words).select("SUBJECT_ID", F.col(diagnosis_code).alias("XCODE"))
    return union_codes({"lab": lab, "icd": icd})


def training_rows(
    patients: DataFrame,
    admissions: DataFrame,
    codes: DataFrame,
    vocabulary: Sequence[str],
    patient_categories: Mapping[str, Sequence[str]],
    admission_categories: Mapping[str, Sequence[str]],
    on: str = "SUBJECT_ID",
) -> DataFrame:
    """Admissions of known patients with code counts, one-hot counts of categories and the LABEL.

    The TARGET is a column of the patients or of the admissions. One-hot cells count the admissions of the subject,
    so a category of the patient holds the number of admissions in one cell. Everything with one row per subject is
    put together first, and the admissions are joined once. Subjects without codes drop out.
    """
    visits = one_hot_counts(admissions, on, admission_categories, total="_visits")
    subjects = patients.join(count_matrix(codes, on, "XCODE", vocabulary), on).join(visits, on)
    cells = {
        f"{column}_{value}": F.when(F.col(column) == F.lit(value), F.col("_visits")).otherwise(F.lit(0))
        for column, values in patient_categories.items()
        for value in values
    }
    rows = attach_matrix(admissions, subjects.withColumns(cells).drop("_visits"), on)
    return rows.withColumn("LABEL", label_from_target(F.col("TARGET")))


def hospital_training_rows(
    patients: DataFrame,
    admissions: DataFrame,
    labs: DataFrame,
    diagnoses: DataFrame,
    lookup: DataFrame,
    markers: Sequence[str] | Mapping[str, str] = RISK_MARKERS,
    words: Sequence[str] = TITLE_WORDS,
    allowed: Sequence[str] | None = ADMISSION_DIAGNOSES,
) -> DataFrame:
    """The whole path from the hospital tables to training rows.

    ``allowed`` keeps admissions with a listed diagnosis text and gives each text a one-hot column; None keeps all
    admissions and leaves the free text out, as it would need a column per text: :func:`hospital_training_vectors` has it.
    Here and there, one column per value of a category is what the caller asks for, so ``MAX_COLUMNS`` holds.
    """
    admitted = admission_facts(admissions).drop("DEATHTIME")
    categories = distinct_values_by_column(admitted, ["ADMISSION_TYPE", "INSURANCE"])
    if allowed is not None:
        admitted = whitelist(admitted, "DIAGNOSIS", allowed)
        categories["DIAGNOSIS"] = allowed
    facts = patient_facts(patients)
    titled = distinct_values(title_search(lookup, "SHORT_TITLE", words), "ICD9_CODE")
    vocabulary = [f"lab:{c}" for c in markers] + [f"icd:{c}" for c in titled]
    codes = condition_codes(labs, diagnoses, lookup, markers, words)
    genders = {"GENDER": distinct_values(facts, "GENDER")}
    return with_age(training_rows(facts, admitted, codes, vocabulary, genders, categories))


def _cell_counts(
    patients: DataFrame,
    admissions: DataFrame,
    codes: DataFrame,
    patient_categories: Sequence[str],
    admission_categories: Sequence[str],
    on: str,
) -> DataFrame:
    """``on, XCODE, n``: codes of each subject, and categories of its admissions and, as often as it was admitted, of its own.

    Each table is counted by subject first, so what is joined has a row per subject and value. Categories are those of known
    patients with codes. The counts are written out.
    """
    plain = codes.select(on, F.col("XCODE").cast("string").alias("XCODE")).groupBy(on, "XCODE").agg(F.count(F.lit(1)).alias("n"))
    if not (patient_categories or admission_categories):
        return materialize(plain)

    def marked(columns: Sequence[str]) -> list[Column]:
        return [F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in columns]

    # the empty mark stands for the admission itself
    marks = F.explode(F.array_compact(F.array(F.lit(""), *marked(admission_categories)))).alias("XCODE")
    visits = admissions.select(on, marks).groupBy(on, "XCODE").agg(F.count(F.lit(1)).alias("n"))
    own = F.array_compact(F.array(*marked(patient_categories))) if patient_categories else F.array().cast("array<string>")
    cells = visits.join(patients.select(on, own.alias("_own")), on)
    # an admission's mark stays as it is, the empty one becomes the patient's marks
    shown = F.when(F.col("XCODE") == "", F.col("_own")).otherwise(F.array("XCODE"))
    cells = cells.select(on, F.explode(shown).alias("XCODE"), "n", F.lit(False).alias("_coded"))
    # written before it is known who has codes, so that the events behind the codes are read once
    counted = materialize(plain.withColumn("_coded", F.lit(True)).unionByName(cells))
    with_codes = counted.where("_coded").select(on).distinct()
    return counted.join(with_codes, on, "left_semi").drop("_coded")


def training_vectors(
    patients: DataFrame,
    admissions: DataFrame,
    codes: DataFrame,
    patient_categories: Sequence[str],
    admission_categories: Sequence[str],
    numbers: Sequence[str] = (),
    vocabulary: DataFrame | None = None,
    fill: float | None = None,
    on: str = "SUBJECT_ID",
) -> DataFrame:
    """Admissions of known patients with LABEL and one sparse vector: as :func:`training_rows`, without a column per value.

    Codes, and each admission's values of the categories (marked ``column:value``), are counted by subject and position. The
    vocabulary (``XCODE, position``) is a table; without one it holds every value that occurs, in text order, so its width is
    free. ``numbers`` are columns of the patient or the admission that follow the counts; nulls in them become ``fill``, or NaN
    without one. Subjects without codes drop out.
    """
    counted = _cell_counts(patients, admissions, codes, patient_categories, admission_categories, on)
    listed = vocabulary if vocabulary is not None else positions(counted, "XCODE")
    known = patients.select(on, *[c for c in patients.columns if c not in admissions.columns])
    # all that there is per subject is written together, so that the join with the admissions can split a heavy subject
    rows = admissions.join(code_vectors(counted, on, "XCODE", listed, "counts", counted="n", beside=known), on)
    if numbers:
        rows = rows if fill is None else rows.na.fill(fill, list(numbers))
        rows = assembler(list(numbers), "_numbers", invalid="keep").transform(rows)
        rows = assembler(["counts", "_numbers"], "features").transform(rows).drop("counts", "_numbers")
    else:
        rows = rows.withColumnRenamed("counts", "features")
    return rows.withColumn("LABEL", label_from_target(F.col("TARGET")))


def hospital_training_vectors(
    patients: DataFrame,
    admissions: DataFrame,
    labs: DataFrame,
    diagnoses: DataFrame,
    lookup: DataFrame,
    markers: Sequence[str] | Mapping[str, str] = RISK_MARKERS,
    words: Sequence[str] = TITLE_WORDS,
    allowed: Sequence[str] | None = ADMISSION_DIAGNOSES,
    fill: float | None = 0.0,
) -> DataFrame:
    """The whole path from the hospital tables to ``SUBJECT_ID, HADM_ID, LABEL, features``, sparse.

    ``allowed`` keeps admissions with a listed diagnosis text, None keeps all. Diagnosis texts are features either way, however
    many there are. The last two cells are the length of stay and the age at admission.
    """
    admitted = admission_facts(admissions).drop("DEATHTIME")
    if allowed is not None:
        admitted = whitelist(admitted, "DIAGNOSIS", allowed)
    facts = patient_facts(patients)
    aged = with_age(admitted.join(facts.select("SUBJECT_ID", "DOB"), "SUBJECT_ID")).drop("DOB")
    codes = condition_codes(labs, diagnoses, lookup, markers, words)
    categories = ["ADMISSION_TYPE", "INSURANCE", "DIAGNOSIS"]
    rows = training_vectors(facts, aged, codes, ["GENDER"], categories, ["LOS", "AGE"], fill=fill)
    return rows.select("SUBJECT_ID", "HADM_ID", "LABEL", "features")
