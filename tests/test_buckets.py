import random

import pytest
from pyspark.sql import functions as F

from cohortloom.session import scratch_path
from cohortloom.sources import buckets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, kept)


@pytest.fixture
def tables(spark):
    """Events of which a third are of one subject, some of none, and subjects."""
    draw = random.Random(4)
    events = [(draw.choice([7, draw.randint(0, 400), draw.randint(0, 400)]), k, "x.y") for k in range(3000)] + [(None, -1, "z")]
    events = spark.createDataFrame(events, "`subject id` int, event int, `a.b` string")
    subjects = spark.createDataFrame([(k, f"s{k}") for k in range(0, 500, 2)] + [(None, "nobody")], "`subject id` int, name string")
    write = lambda df, name: buckets.write_bucketed(df, scratch_path(spark, name), "subject id", 8)
    return events, subjects, write(events, "events"), write(subjects, "subjects")


def test_all_rows_are_kept_and_heavy_keys_stand_apart(tables, rows):
    events, subjects, many, one = tables
    assert rows(many.all_rows()) == rows(events) and rows(one.all_rows()) == rows(subjects)
    assert {r[0] for r in many.heavy.select("subject id").distinct().collect()} == {7} and one.heavy.isEmpty()
    assert many.all_rows().columns == events.columns


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_joins_as_of_plain_tables_without_a_shuffle(tables, rows, no_broadcast, how):
    events, subjects, many, one = tables
    joined = buckets.join_bucketed(many, one, how)
    assert rows(joined.all_rows()) == rows(events.join(subjects, "subject id", how))
    assert "Exchange hashpartitioning" not in plan(joined.rows) and "SortMergeJoin" in plan(joined.rows)
    assert "BroadcastHashJoin" in plan(joined.heavy)


def test_counts_without_a_shuffle(tables, rows, no_broadcast):
    events, subjects, many, one = tables
    joined = buckets.join_bucketed(many, one)
    counted = buckets.aggregate_bucketed(joined, F.count(F.lit(1)).alias("n"), F.max("name").alias("name"))
    wanted = events.join(subjects, "subject id").groupBy("subject id").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name"))
    assert rows(counted) == rows(wanted)
    assert "Exchange" not in plan(joined.rows.groupBy("subject id").count())


def test_opened_in_another_session_by_its_path(spark, rows):
    """The layout is with the table: no setting of the session takes part in it."""
    path = scratch_path(spark, "kept")
    buckets.write_bucketed(spark.range(100).withColumn("v", F.col("id") % 7), path, "id", 6)
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "3")
    other.sql("DROP TABLE IF EXISTS " + "bucketed_" + __import__("hashlib").sha256(f"{path}/buckets".encode()).hexdigest()[:32])
    table = buckets.read_bucketed(other, path)
    assert table.buckets == 6 and rows(table.all_rows()) == [(k, k % 7) for k in sorted(range(100), key=str)]
    with pytest.raises(ValueError, match="differ"):
        buckets.join_bucketed(table, buckets.BucketedTable(table.rows, table.heavy, "id", 5))


def test_an_empty_table(spark):
    empty = buckets.write_bucketed(spark.range(0), scratch_path(spark, "empty"), "id", 4)
    assert empty.all_rows().count() == 0 and buckets.join_bucketed(empty, empty).all_rows().count() == 0
