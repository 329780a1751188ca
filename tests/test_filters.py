from pyspark.sql import functions as F

from cohortloom.functions import (
    RISK_MARKERS,
    TITLE_WORDS,
    age_years,
    days_between,
    label_from_target,
    mortality_target,
    text_matches,
)
from cohortloom.operators import filters
from cohortloom.plans import mortality


def ids(df):
    return sorted(r[0] for r in df.select("ROW_ID").collect())


def test_two_rules_for_abnormal(hospital):
    labs = hospital["lab_events"]
    assert ids(filters.flagged_abnormal(labs)) == [1, 2, 5, 6, 7, 8, 10, 11, 12]
    assert ids(filters.flagged_any(labs)) == [1, 2, 3, 5, 6, 7, 8, 10, 11, 12]


def test_text_flag_that_is_no_number_never_matches(hospital):
    assert hospital["chart_events"].count() == 4
    assert filters.flagged_one(hospital["chart_events"]).count() == 1


def test_listed_and_unlisted_codes_are_all_rows(spark, hospital):
    labs = hospital["lab_events"]
    inside = filters.codes_in_set(labs, RISK_MARKERS, "ITEMID")
    outside = filters.codes_not_in_set(labs, RISK_MARKERS, "ITEMID")
    assert ids(inside) == [1, 2, 3, 4, 6, 7, 9, 11, 12]
    assert ids(outside) == [5, 8, 10]  # 10 has no code
    table = filters.code_table(spark, RISK_MARKERS, code="ITEMID")
    assert ids(filters.codes_in_set(labs, table, "ITEMID")) == ids(inside)
    assert ids(filters.codes_not_in_set(labs, table, "ITEMID")) == ids(outside)


def test_number_codes_match_text_codes(hospital):
    assert ids(filters.codes_in_set(hospital["lab_events"], [50813], "ITEMID")) == [1, 2, 11]


def test_code_table(spark):
    named = filters.code_table(spark, RISK_MARKERS)
    assert named.dtypes == [("ITEMCODE", "string"), ("NAME", "string")]
    assert named.count() == 29 and named.where("ITEMCODE = '50813'").first()["NAME"] == "lactate"
    assert filters.code_table(spark, ["a", "b"]).columns == ["ITEMCODE"]


def test_title_search_is_case_sensitive(hospital):
    found = filters.title_search(hospital["diagnosis_lookup"], "SHORT_TITLE", TITLE_WORDS)
    assert sorted(r[0] for r in found.collect()) == ["99590", "99591", "99592"]
    flags = hospital["diagnosis_lookup"].select(text_matches(F.col("SHORT_TITLE"), "epsis").alias("f"))
    assert [r[0] for r in flags.collect()].count(True) == 2


def test_age_and_stay(spark):
    dates = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2150-01-01 23:00:00', TIMESTAMP_NTZ'2150-01-10 01:00:00'), "
                      "(TIMESTAMP_NTZ'2150-01-02 00:00:00', NULL), "
                      "(TIMESTAMP_NTZ'2150-01-02 00:00:00', TIMESTAMP_NTZ'2149-01-02 00:00:00') AS t(a, b)")  # fmt: skip
    got = dates.select(days_between(F.col("a"), F.col("b")), age_years(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(9, 0.0), (None, None), (-365, -1.0)]


def test_target_and_label(spark):
    df = spark.createDataFrame([("x",), (None,)], "death string").withColumn("t", mortality_target(F.col("death")))
    assert [r[0] for r in df.select("t").collect()] == ["Y", "N"]
    df = spark.createDataFrame([("Y",), ("N",), ("?",), (None,)], "t string")
    assert [r[0] for r in df.select(label_from_target(F.col("t"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_patient_facts(hospital, rows):
    facts = mortality.patient_facts(hospital["patients"])
    assert rows(facts.drop("DOB")) == [("p1", "F", 70.5, "Y"), ("p2", "M", 55.0, "N"), ("p3", "F", None, "N")]


def test_patients_info(hospital):
    info = mortality.patients_info(hospital["patients"], hospital["admissions"])
    assert info.columns == [
        "SUBJECT_ID", "GENDER", "DOB", "AGE_AT_DEATH", "TARGET", "HADM_ID", "ADMITTIME", "ADMISSION_TYPE", "INSURANCE",
        "DIAGNOSIS", "LOS", "AGE",
    ]
    got = {r["HADM_ID"]: (r["SUBJECT_ID"], r["LOS"]) for r in info.collect()}
    assert got == {"h1": ("p1", 9), "h2": ("p1", 0), "h3": ("p1", 12), "h4": ("p2", 4), "h5": ("p3", 2)}
    ages = {r["HADM_ID"]: r["AGE"] for r in info.collect()}
    assert ages["h1"] == 70.0 and ages["h5"] == 29.5  # known of the living too
    sepsis = filters.equal_to(info, "DIAGNOSIS", "SEPSIS")
    assert [r["HADM_ID"] for r in sepsis.collect()] == ["h1"]


def test_code_tables_of_either_type(spark):
    events = spark.createDataFrame([("7", 1), ("07", 2), ("x1", 3), (None, 4)], "code string, n int")
    numbers = spark.createDataFrame([(7,), (7,), (None,)], "code int")
    assert [r["n"] for r in filters.codes_in_set(events, numbers, "code").collect()] == [1]
    assert sorted(r["n"] for r in filters.codes_not_in_set(events, numbers, "code").collect()) == [2, 3, 4]
    numbered = spark.createDataFrame([(7, 1), (8, 2)], "code bigint, n int")
    texts = spark.createDataFrame([("7",), ("x1",)], "code string")
    assert [r["n"] for r in filters.codes_in_set(numbered, texts, "code").collect()] == [1]
