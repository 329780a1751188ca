"""Compare a registered query with its SQL twin on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _rows(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    values = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in columns]
    return sorted(zip(*values), key=lambda row: tuple((v is not None, str(v)) for v in row))


def compare(spark_frame, sql_frame) -> str | None:
    """None where both hold the same rows, else what differs first."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(sql_frame.columns)}"
    types = [(c, str(spark_frame[c].dtype), str(sql_frame[c].dtype)) for c in spark_frame.columns]
    # whole numbers with gaps are float64 on one side and Int64 on the other
    gaps = {"float64", "Int64"}
    mixed = [t for t in types if t[1].split("[")[0] != t[2].split("[")[0] and {t[1], t[2]} != gaps]
    for c in [t[0] for t in types if {t[1], t[2]} == gaps]:
        spark_frame, sql_frame = (f.assign(**{c: f[c].astype("Int64")}) for f in (spark_frame, sql_frame))
    if mixed:
        return f"types {mixed}"
    ours, theirs = _rows(spark_frame), _rows(sql_frame)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} against {b}"
    return None
