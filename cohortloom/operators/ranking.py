"""Places and running totals in a total order, over ranges of rows.

A window without a partition puts all rows into one task. Here rows are dealt out by ranges of the order and sorted in each; a row's
place is its place in its range plus the sizes of the ranges before. Only one number for each range (as many as there are shuffle
partitions) goes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.names import exactly, free_name
from cohortloom.session import broadcast_rows, materialize

Order = Sequence[Column | str]


def _in_ranges(df: DataFrame, order: Order) -> tuple[DataFrame, str, str]:
    """The rows with their range and place in it, written out, and the names of those two columns.

    Rows that the order doesn't tell apart share a range; add columns to the order where they may be many.
    """
    part, row = free_name(df.columns, "_range"), free_name(df.columns, "_row")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id holds the number of the partition above its low 33 bits, and the place in it below
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(dealt.withColumns({part: F.spark_partition_id(), row: place})), part, row


def _before(rows: DataFrame, part: str, sums: Mapping[str, Column]) -> DataFrame:
    """For each range, the sums over all ranges before it."""
    spark = rows.sparkSession
    found = rows.groupBy(part).agg(*[c.alias(n) for n, c in sums.items()]).orderBy(part).collect()
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.groupBy(part).agg(*[c.alias(n) for n, c in sums.items()]).dtypes)
    total, before = [0] * len(sums), []
    for row in found:
        before.append((row[0], *total))
        total = [a + (b or 0) for a, b in zip(total, row[1:])]
    return broadcast_rows(spark.createDataFrame(before, kinds), len(before))


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """All rows with their place in the order, from 0."""
    rows, part, row = _in_ranges(df, order)
    first = free_name(df.columns, "_first")
    placed = rows.join(_before(rows, part, {first: F.count(F.lit(1))}), part)
    return placed.select(*[exactly(c) for c in df.columns], (F.col(first) + F.col(row)).alias(name))


def running_totals(df: DataFrame, order: Order, totals: Mapping[str, str]) -> DataFrame:
    """All rows with the running total of each column that ``totals`` names (new name: column), its own row included.

    Whole numbers are added exactly, whatever the ranges; a null counts as nothing.
    """
    rows, part, row = _in_ranges(df, order)
    offsets = {name: free_name([*df.columns, *totals], f"_before_{k}") for k, name in enumerate(totals)}
    sums = {offsets[name]: F.coalesce(F.sum(exactly(column)), F.lit(0)) for name, column in totals.items()}
    upto = Window.partitionBy(part).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(_before(rows, part, sums), part)
    return rows.select(
        *[exactly(c) for c in df.columns],
        *[
            (F.coalesce(F.sum(exactly(column)).over(upto), F.lit(0)) + F.col(offsets[name])).alias(name)
            for name, column in totals.items()
        ],
    )
