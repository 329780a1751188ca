"""Cohorts as bitmaps: events of other subjects are dropped where they are read, before any shuffle.

The subjects' numbers are cut into ranges of 32,768, and each range in which the cohort has a subject is one bitmap. An event meets its
range's bitmap by broadcast and is tested for its bit. The size of the bitmaps follows from the count of ranges, and is checked: where
numbers lie too far apart for that, the cohort is joined as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.names import exactly, free_name
from cohortloom.operators.joins import cohort_events, restrict_to_cohort
from cohortloom.session import BROADCAST_BYTES, materialize

#: Bits of a bitmap, which Spark's bitmap functions fix, and bytes that one takes as an array of numbers of 16 bits.
BITS, BITMAP_BYTES = 32_768, 8_192 + 64


def cohort_bitmaps(members: DataFrame, on: str = "SUBJECT_ID") -> DataFrame:
    """``range_no, octets``: for each range of numbers with a member, its bitmap as an array of bytes, written out."""
    number = exactly(on)
    bitmaps = members.where(number.isNotNull()).groupBy(F.bitmap_bucket_number(number).alias("range_no")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )
    octet = lambda k: F.conv(F.hex(F.substring("bits", k, F.lit(1))), 16, 10).cast("smallint")
    octets = F.transform(F.sequence(F.lit(1), F.lit(BITS // 8)), octet)
    return materialize(bitmaps.select("range_no", octets.alias("octets")))


def in_cohort(events: DataFrame, bitmaps: DataFrame, on: str = "SUBJECT_ID") -> DataFrame:
    """Events of subjects whose bit is set; the bitmaps are broadcast, so they must be few (see ``small_enough``)."""
    no, octets = free_name(events.columns, "_range_no"), free_name(events.columns, "_octets")
    number = exactly(on)
    few = F.broadcast(bitmaps.select(F.col("range_no").alias(no), F.col("octets").alias(octets)))
    place = F.bitmap_bit_position(number)
    octet = F.get(F.col(octets), F.floor(place / 8).cast("int")).cast("bigint")
    bit = F.shiftright(octet, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 8).cast("int"))) != 0
    return events.join(few, (F.bitmap_bucket_number(number) == F.col(no)) & bit).drop(no, octets)


def small_enough(bitmaps: DataFrame) -> bool:
    return bitmaps.count() * BITMAP_BYTES <= BROADCAST_BYTES


def _dense(members: DataFrame, on: str) -> bool:
    """Whether the bitmaps of the cohort are few, by a count of its ranges before any bitmap is made."""
    if dict(members.dtypes)[on] not in ("tinyint", "smallint", "int", "bigint"):
        return False
    ranges = members.where(exactly(on).isNotNull()).agg(F.count_distinct(F.bitmap_bucket_number(exactly(on)))).first()[0]
    return ranges * BITMAP_BYTES <= BROADCAST_BYTES


def restrict_by_bitmap(events: DataFrame, members: DataFrame, on: str = "SUBJECT_ID") -> DataFrame:
    """Events of cohort subjects, each once, as ``restrict_to_cohort`` has them, without a shuffle of events.

    Keys that aren't whole numbers, and cohorts whose numbers lie too far apart, are joined instead.
    """
    members = materialize(members.select(on))
    if not _dense(members, on):
        return restrict_to_cohort(events, members.distinct(), on)
    return in_cohort(events, cohort_bitmaps(members, on), on)


def cohort_events_by_bitmap(events: DataFrame, members: DataFrame, on: str = "SUBJECT_ID") -> DataFrame:
    """As ``cohort_events``, with each subject's number of cohort rows: only events of the cohort are shuffled."""
    members = materialize(members)
    if not _dense(members, on):
        return cohort_events(events, members, on)
    return cohort_events(in_cohort(events, cohort_bitmaps(members, on), on), members, on)
