"""The test tables in the roles of the hospital tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.features import rename
from cohortloom.sources import read_parquet

MARKERS = {"click": "opened", "error": "failed", "purchase": "bought", "refund": "returned"}  # refund never occurs
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
WORDS = ["ring", "red"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CHAPTERS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ABNORMAL_FROM, DELTA_BELOW, COSTLY = 80.0, 5.0, 250_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename(table(spark, sf_dir, "customer"), {"c_custkey": "SUBJECT_ID", "c_mktsegment": "GENDER"})


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; status P stands for no recorded death."""
    named = rename(
        table(spark, sf_dir, "orders"),
        {
            "o_custkey": "SUBJECT_ID",
            "o_orderkey": "HADM_ID",
            "o_orderdate": "ADMITTIME",
            "o_orderpriority": "ADMISSION_TYPE",
            "o_orderstatus": "DIAGNOSIS",
            "o_totalprice": "COST",
        },
    )
    return named.withColumn("DEATHTIME", F.nullif("DIAGNOSIS", F.lit("P")))


def with_outcome(admissions: DataFrame) -> DataFrame:
    """Admissions with a TARGET that follows the cost, but for about one in ten by a hash of the key."""
    turned = F.conv(F.substring(F.md5(F.col("HADM_ID").cast("string")), 1, 8), 16, 10).cast("bigint") % 10 == 0
    return admissions.withColumn("TARGET", F.when((F.col("COST") >= COSTLY) != turned, "Y").otherwise("N"))


def labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events; a value out of the usual range raises a flag."""
    named = rename(
        table(spark, sf_dir, "events"),
        {"event_id": "ROW_ID", "user_id": "SUBJECT_ID", "event_type": "ITEMID", "ts": "CHARTTIME", "value": "VALUENUM"},
    )
    value = F.col("VALUENUM")
    flag = F.when(value >= ABNORMAL_FROM, "abnormal").when(value < DELTA_BELOW, "delta")
    return named.withColumn("FLAG", flag)


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rename(
        table(spark, sf_dir, "lineitem"),
        {"l_orderkey": "HADM_ID", "l_linenumber": "l_linenumber", "l_shipdate": "DISCHTIME"},
    )
    return lines.join(admissions(spark, sf_dir).select("HADM_ID", "SUBJECT_ID", "ADMITTIME"), "HADM_ID")


def admission_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis codes by admission, before the subject is known."""
    return rename(table(spark, sf_dir, "lineitem"), {"l_orderkey": "HADM_ID", "l_partkey": "ICD9_CODE"})


def admission_microbiology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specimens and organisms by admission, before the subject is known."""
    return rename(
        table(spark, sf_dir, "lineitem"),
        {"l_orderkey": "HADM_ID", "l_returnflag": "SPEC_TYPE_DESC", "l_linestatus": "ORG_NAME"},
    )


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename(
        table(spark, sf_dir, "part"), {"p_partkey": "ICD9_CODE", "p_name": "SHORT_TITLE", "p_type": "CHAPTER"}
    )
