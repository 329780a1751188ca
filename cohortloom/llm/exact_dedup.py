"""Exact deduplication against a persistent digest index.

The index is a Parquet table of one row per distinct text, bucketed and sorted by SHA-256 digest; its count of buckets is kept with
it, so it is opened by its path alone, whatever the settings of the session. A batch of documents is
reduced to one row per digest (partial aggregation before the shuffle), sort-merge anti-joined with the index, and what is
new is appended. The decisions follow from the index after the append, so a batch that is run again under the same name
(after a crash) gives the same decisions and appends nothing twice.

Defined results: a null text counts as empty; of equal texts in a batch the row with the largest doc_id stays (null is the
smallest), of repeated rows with that doc_id exactly one; texts indexed by an earlier batch are dropped; an empty batch
appends nothing; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.names import exactly, free_name
from cohortloom.llm.common import text_or_empty, written
from cohortloom.session import broadcast_rows
from cohortloom.sources.buckets import exists, read_layout, write_layout

#: A digest that at least one in so many rows share is matched by broadcast; there are at most so many of them.
HOT_PARTS = 1000


def digest(column: str = "text") -> Column:
    """SHA-256 of the UTF-8 text, 32 bytes."""
    return F.unhex(F.sha2(text_or_empty(column), 256))


@dataclass(frozen=True)
class DigestIndex:
    """The digests of all texts seen so far; ``path`` is in storage that every executor reaches.

    ``new_buckets`` is the count of buckets of an index that is not there yet (by default the session's shuffle partitions); one that
    is there keeps its own.
    """

    spark: SparkSession
    path: str
    new_buckets: int | None = None

    @property
    def table(self) -> str:
        return "digest_index_" + hashlib.sha256(self.location.encode()).hexdigest()[:32]

    @property
    def location(self) -> str:
        return f"{self.path}/buckets"

    @property
    def buckets(self) -> int:
        layout = f"{self.path}/layout"
        if not exists(self.spark, layout):
            wanted = self.new_buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            write_layout(self.spark, layout, buckets=wanted)
        return read_layout(self.spark, layout)["buckets"]

    def read(self) -> DataFrame:
        """Columns digest, keep_id, batch; registered with its buckets, so that joins on the digest don't shuffle it."""
        quoted = self.location.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{quoted}'"
        )
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def _append(self, rows: DataFrame) -> None:
        buckets = self.buckets
        (
            rows.repartition(buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(buckets, "digest")
            .sortBy("digest")
            .option("path", self.location)
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Index a batch; returns ``doc_id, keep_id, group_size, kept, digest`` for each of its rows.

        ``group_size`` counts the rows of the batch with this text, ``keep_id`` names the document that stays, of this or
        an earlier batch.
        """
        batch = batch or uuid.uuid4().hex
        slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest().alias("digest"))
        slim = written(slim.withColumn("row_no", F.monotonically_increasing_id()), "digests")
        groups = slim.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row_no")).alias("last"), F.count(F.lit(1)).alias("group_size")
        )
        groups = written(groups.select("digest", "last.doc_id", F.col("last.row_no").alias("keep_row"), "group_size"), "groups")
        fresh = groups.join(self.read().hint("merge"), "digest", "left_anti")
        self._append(fresh.select("digest", F.col("doc_id").alias("keep_id"), F.lit(batch).alias("batch")))
        known = groups.drop("doc_id").join(self.read().hint("merge"), "digest")
        known = known.withColumn("keep_row", F.when(F.col("batch") == batch, F.col("keep_row"))).drop("batch")
        return self._decide(slim, known)

    def _decide(self, slim: DataFrame, known: DataFrame) -> DataFrame:
        """Each row with its group; rows of hot digests meet their few groups by broadcast, unshuffled."""
        known = written(known, "known")
        total = slim.count()
        hot = F.col("group_size") * HOT_PARTS >= total
        few = F.broadcast(known.filter(hot))
        rows = slim.join(few, "digest").unionByName(
            slim.join(few.select("digest"), "digest", "left_anti").join(known.filter(~hot), "digest")
        )
        return rows.select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"),
            "digest",
        )


def drop_exact_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows with the same doc_id and text, one.

    Texts are shuffled once, to meet what stays of them. Rows that are repeated with their doc_id are known from the digests; only those
    few are looked at again to leave one of each.
    """
    own, mark, of = (free_name(docs.columns, n) for n in ("digest", "kept_digest", "kept_id"))
    kept = written(index.add(docs, batch).select(F.col("doc_id").alias(of), F.col("digest").alias(mark), "kept"), "decided")
    counted = kept.groupBy(of, mark).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("kept")
    counted = written(counted, "kept")
    rows = docs.withColumn(own, digest())
    same = exactly("doc_id").cast("bigint").eqNullSafe(F.col(of)) & (F.col(own) == F.col(mark))
    once = rows.join(counted.filter("n = 1").select(of, mark), same, "left_semi")
    repeated = counted.filter("n > 1").select(of, mark)
    n = repeated.count()
    if n:
        again = rows.join(broadcast_rows(repeated, n, cell_bytes=64), same, "left_semi")
        once = once.unionByName(again.dropDuplicates(["doc_id", own]))
    return once.drop(own)
