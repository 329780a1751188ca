"""Tables bucketed and sorted by a key, so that joins and counts on it don't shuffle them.

A bucketed table has its layout (columns, key, bucket count) beside its data, so it is opened by its path alone, in any session. Each
bucket is one file. A key with very many rows would be one bucket's burden in every join: such keys, which are few as they are
heavy, are kept apart in plain files, and meet the few rows of the other table by broadcast.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.names import exactly
from cohortloom.session import broadcast_rows, materialize

#: A key is heavy if it has several rows, and more than this share of an average bucket.
HEAVY = 1.0


@dataclass(frozen=True)
class BucketedTable:
    """``rows`` is the bucketed part, ``heavy`` holds the rows of heavy keys (none: an empty table)."""

    rows: DataFrame
    heavy: DataFrame
    key: str
    buckets: int

    def all_rows(self) -> DataFrame:
        return self.rows.unionByName(self.heavy)


def _table(spark: SparkSession, path: str, ddl: str, key: str, buckets: int) -> str:
    """The name under which the session knows the files; they are outside the warehouse and stay if the name is dropped."""
    name = "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:32]
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    quoted = "`" + key.replace("`", "``") + "`"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet CLUSTERED BY ({quoted}) SORTED BY ({quoted}) "
        f"INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return name


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def append_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Add rows to the bucketed files at a path (made if there are none), one file per bucket."""
    spark = df.sparkSession
    name = _table(spark, path, _ddl(df), key, buckets)
    (
        df.repartition(buckets, exactly(key))
        .write.format("parquet")
        .mode("append")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(name)
    )
    spark.catalog.refreshTable(name)


def write_layout(spark: SparkSession, path: str, **layout) -> None:
    spark.range(1).coalesce(1).select(F.lit(json.dumps(layout)).alias("value")).write.text(path)


def read_layout(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, heavy: float = HEAVY) -> BucketedTable:
    """Write a table by buckets of its key. Rows without a key join nothing, but are kept."""
    counts = df.groupBy(exactly(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts)
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # as many rows as that can be had by fewer keys than there are buckets, over the share
    apart = materialize(counts.where((F.col("_n") > 1) & (F.col("_n") * buckets > heavy * total)).select("_key"))
    few = broadcast_rows(apart, apart.count())
    of_heavy = exactly(key).eqNullSafe(F.col("_key"))
    df.join(few, of_heavy, "left_semi").write.parquet(f"{path}/heavy")
    append_buckets(df.join(few, of_heavy, "left_anti"), f"{path}/buckets", key, buckets)
    write_layout(df.sparkSession, f"{path}/layout", ddl=_ddl(df), key=key, buckets=buckets)
    return read_bucketed(df.sparkSession, path)


def read_bucketed(spark: SparkSession, path: str) -> BucketedTable:
    """Open a table that ``write_bucketed`` has written, by this session or another one."""
    layout = read_layout(spark, f"{path}/layout")
    name = _table(spark, f"{path}/buckets", layout["ddl"], layout["key"], layout["buckets"])
    heavy = spark.read.schema(spark.table(name).schema).parquet(f"{path}/heavy")
    return BucketedTable(spark.table(name), heavy, layout["key"], layout["buckets"])


def join_bucketed(many: BucketedTable, one: BucketedTable, how: str = "inner") -> BucketedTable:
    """Join rows to a table with one row per key (``how``: inner, left or left_semi), both bucketed alike: no shuffle.

    The rows of heavy keys, which stay apart in the result, meet the rows that the other table has for them, one for each, by
    broadcast.
    """
    if (many.key, many.buckets) != (one.key, one.buckets):
        raise ValueError("the tables differ in key or buckets")
    keys = materialize(many.heavy.select(exactly(many.key)).distinct())
    found = one.all_rows().join(F.broadcast(keys), many.key, "left_semi")
    heavy = many.heavy.join(broadcast_rows(found, keys.count()), many.key, how)
    return BucketedTable(many.rows.join(one.rows, many.key, how), heavy, many.key, many.buckets)


def aggregate_bucketed(table: BucketedTable, *aggregates: Column) -> DataFrame:
    """One row per key: by buckets without a shuffle, and for the few heavy keys from partial results."""
    parts = [part.groupBy(exactly(table.key)).agg(*aggregates) for part in (table.rows, table.heavy)]
    return parts[0].unionByName(parts[1])
