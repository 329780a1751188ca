import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cohorts, joins

EDGES = [0, 1, -1, 32_767, 32_768, 32_769, 65_536, -32_768, -32_769, 10**9, -(10**9), 7]


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(6)
    events = [(draw.choice([*EDGES, None, draw.randint(-70_000, 70_000)]), k, "o", 1) for k in range(2000)]
    events = spark.createDataFrame(events, "`s.id` bigint, event int, _octets string, _range_no int")
    members = spark.createDataFrame([(k, 2 + k % 3) for k in [*EDGES[::2], *range(-70_000, 70_000, 3)]], "`s.id` bigint, n int")
    return events, members.groupBy("`s.id`").agg(F.max("n").alias("n"))


def test_every_bit_is_tested(tables, rows):
    events, members = tables
    wanted = events.join(members, events["`s.id`"] == members["`s.id`"], "left_semi")
    found = cohorts.in_cohort(events, cohorts.cohort_bitmaps(members, "s.id"), "s.id")
    assert rows(found) == rows(wanted) and found.columns == events.columns


def test_as_the_joins(spark, rows):
    draw = random.Random(7)
    events = spark.createDataFrame([(draw.randint(0, 99), k) for k in range(500)], "SUBJECT_ID int, event int")
    members = spark.createDataFrame([(k, k % 4) for k in range(0, 120, 5)], "SUBJECT_ID int, cohort_rows int")
    assert rows(cohorts.restrict_by_bitmap(events, members)) == rows(joins.restrict_to_cohort(events, members))
    assert rows(cohorts.cohort_events_by_bitmap(events, members)) == rows(joins.cohort_events(events, members))
    text = lambda df: df.withColumn("SUBJECT_ID", F.concat(F.lit("s"), F.col("SUBJECT_ID")))
    assert rows(cohorts.restrict_by_bitmap(text(events), text(members))) == rows(joins.restrict_to_cohort(text(events), text(members)))


def test_numbers_far_apart_are_joined(spark, rows, monkeypatch):
    events = spark.createDataFrame([(k * 10**12, k) for k in range(50)], "SUBJECT_ID bigint, event int")
    monkeypatch.setattr(cohorts, "BROADCAST_BYTES", 5 * cohorts.BITMAP_BYTES)
    found = cohorts.restrict_by_bitmap(events, events.where("event % 2 = 0"))
    assert rows(found) == rows(events.where("event % 2 = 0"))
    assert "_octets" not in found._jdf.queryExecution().toString()


def test_only_events_of_the_cohort_are_shuffled(spark):
    """The bitmap is met where events are read, below any exchange of theirs."""
    events = spark.range(10_000).select((F.col("id") % 1000).alias("SUBJECT_ID"), F.col("id").alias("event"))
    members = spark.createDataFrame([(5, 1)], "SUBJECT_ID bigint, cohort_rows int")
    found = cohorts.cohort_events_by_bitmap(events, members)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 10 and "BroadcastHashJoin" in plan and "bitmapBucketNumber" in plan
    assert cohorts.restrict_by_bitmap(events, members.where("SUBJECT_ID < 0")).count() == 0
