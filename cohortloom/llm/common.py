"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import scratch_path

#: Rows that a Python task holds as Python objects at a time, and bytes of their texts (one text may be longer).
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as a Parquet copy in the shared folder: computed once, safe from lost executors, read back pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Small pieces of the batches, so that few texts are Python objects at once."""
    for batch in batches:
        upto, start = None, 0
        if "text" in batch.schema.names:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        while start < batch.num_rows:
            n = rows
            if upto is not None:
                before = upto[start - 1] if start else 0
                n = max(1, min(rows, int(np.searchsorted(upto, before + most, "right")) - start))
            yield batch.slice(start, n)
            start += n


def map_texts(
    docs: DataFrame, per_text: Callable[[], Callable[[list[str]], list[pa.Array]]], schema: str
) -> DataFrame:
    """One row per document: ``doc_id`` and what ``per_text()`` makes of its whole text (null: empty).

    ``per_text`` is called once per task and returns a function from texts to one array for each further column.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    names = [part.split()[0] for part in schema.split(",")]
    full = f"doc_id {dict(rows.dtypes)['doc_id']}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = per_text()
        for piece in slices(batches):
            arrays = work(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *arrays], ["doc_id", *names])

    return rows.mapInArrow(run, full)
