"""Typed table schemas and file readers and writers."""

from cohortloom.sources.buckets import read_bucketed, write_bucketed
from cohortloom.sources.files import (
    by_position,
    drop_header_rows,
    footer_counts,
    footer_extremes,
    ingest_entity,
    read_csv,
    read_entity,
    read_parquet,
    write_csv,
    write_parquet,
)
from cohortloom.sources.schemas import ENTITIES, entity_schema

__all__ = [
    "ENTITIES",
    "by_position",
    "drop_header_rows",
    "entity_schema",
    "footer_counts",
    "footer_extremes",
    "ingest_entity",
    "read_bucketed",
    "write_bucketed",
    "read_csv",
    "read_entity",
    "read_parquet",
    "write_csv",
    "write_parquet",
]
