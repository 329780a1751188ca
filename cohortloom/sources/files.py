"""CSV and Parquet readers and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.names import exactly
from cohortloom.sources.schemas import ENTITIES, entity_schema


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    header: bool = True,
    multi_line: bool = False,
    null: str | None = None,
    mode: str = "PERMISSIVE",
    corrupt: str | None = None,
) -> DataFrame:
    """Read CSV by a declared schema, by position; without one, every column is a string, named by the header or ``_cN``.

    A quote inside a quoted text is written twice. Quoted line breaks are kept with ``multi_line``; a file is then read by
    one task, so it is off unless asked for. ``null`` is the mark of a missing value (without it, an empty field). In mode
    PERMISSIVE a value that does not fit its type becomes null; ``corrupt`` names a text column that then holds the line of
    every row that did not fit. DROPMALFORMED leaves such rows out, FAILFAST stops at the first.
    """
    options = {"header": header, "escape": '"', "multiLine": multi_line, "mode": mode, "nullValue": null}
    if corrupt is not None:
        if schema is None:
            raise ValueError("a column for corrupt lines needs a declared schema")
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        options["columnNameOfCorruptRecord"] = corrupt
    reader = spark.read.options(**{k: v for k, v in options.items() if v is not None})
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_entity(spark: SparkSession, entity: str, path: str, header: bool = True) -> DataFrame:
    """Read one hospital table from CSV with its named and typed columns only."""
    named = [name for name, _ in ENTITIES[entity].values()]
    return read_csv(spark, path, entity_schema(entity), header).select(*named)


def ingest_entity(
    spark: SparkSession, entity: str, path: str, out: str, header: bool = True
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Read one hospital table from CSV once, write it typed, and account for what did not fit.

    Returns the typed rows, read from ``out``, with the columns ``source_file`` and ``rejected`` (names of the columns whose text did
    not fit their type and is null); the account ``source_file, column_name, n_rejected``, from these two columns only; and the totals
    that were observed while the files were read: rows, rows with a rejected value, and rejected values by column.
    """
    columns = ENTITIES[entity]
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in entity_schema(entity)])
    # a session of its own: models fitted in a session that has observed something hold it, and can't be sent to executors
    apart = spark.newSession()
    apart.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    lines = read_csv(apart, path, texts, header).select(
        *[name for name, _ in columns.values()], F.col("_metadata.file_path").alias("source_file")
    )
    typed = {name: F.col(name).try_cast(kind) for name, kind in columns.values()}
    misfits = [
        F.when(F.col(name).isNotNull() & typed[name].isNull(), F.lit(name))
        for name, kind in columns.values()
        if kind != T.StringType()
    ]
    misfit = F.array_compact(F.array(*misfits)) if misfits else F.array().cast("array<string>")
    rows = lines.select(*[c.alias(name) for name, c in typed.items()], "source_file", misfit.alias("rejected"))
    seen = Observation()
    totals = {"n_rows": F.count(F.lit(1)), "n_rejected_rows": F.count_if(F.size("rejected") > 0)}
    totals |= {name: F.count_if(F.array_contains("rejected", name)) for name, kind in columns.values() if kind != T.StringType()}
    rows.observe(seen, *[c.alias(name) for name, c in totals.items()]).write.parquet(out)
    stored = spark.read.schema(rows.schema).parquet(out)
    account = stored.select("source_file", F.explode("rejected").alias("column_name"))
    account = account.groupBy("source_file", "column_name").agg(F.count(F.lit(1)).alias("n_rejected"))
    return stored, account, seen.get


def by_position(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Name the columns of a header-less table: ``{1: "SUBJECT_ID"}`` selects ``_c1 AS SUBJECT_ID``."""
    return df.select(*[F.col(f"_c{position}").alias(name) for position, name in names.items()])


def drop_header_rows(df: DataFrame, key: str, title: str | None = None) -> DataFrame:
    """Drop header lines that were read as data, in files joined end to end (rows with a null key go too)."""
    return df.where(F.col(key) != F.lit(title or key))


def write_csv(
    df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True, null: str | None = None
) -> None:
    """Write CSV as a folder of part files; blanks at either end of a text are kept, quotes are doubled.

    With a mark for ``null``, empty texts and missing values stay apart (read with the same mark).
    """
    options = {"header": header, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if null is not None:
        options["nullValue"] = null
    df.write.mode(mode).options(**options).csv(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read Parquet; a known schema spares the job that looks it up in the files."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "snappy") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that answers counts and extremes of Parquet tables from the footers of their files."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    kept = [s for s in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if s != "parquet"]
    session.conf.set("spark.sql.sources.useV1SourceList", ",".join(kept))
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def footer_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``table_name, n`` of Parquet tables; no row is read."""
    session = footer_session(spark)
    counted = [
        session.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def footer_extremes(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """``column_name, n, min, max`` (as numbers) of whole-number and floating columns of a Parquet table; no row is read.

    ``n`` counts what is not null. Footers keep no extremes of texts and times that could be relied on.
    """
    table = footer_session(spark).read.parquet(path)
    stats = {"n": F.count, "min": F.min, "max": F.max}
    wide = table.agg(*[f(exactly(c)).alias(f"{s}_{k}") for k, c in enumerate(columns) for s, f in stats.items()])
    rows = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{s}_{k}").cast("bigint" if s == "n" else "double").alias(s) for s in stats])
        for k, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))
