"""Counts, contingency tables, subtotals, code strings and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The widest dense table, the limit Spark itself sets for a pivot; wider ones belong in sparse vectors.
MAX_COLUMNS = 10_000
#: Up to this width a dense table is counted in one aggregation; beyond it, by pair and then by a pivot.
_ONE_PASS_COLUMNS = 100


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def table_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def top_k_counts(df: DataFrame, key: str, k: int, name: str = "n") -> DataFrame:
    """The k most frequent keys; equal counts are ordered by key."""
    return count_by(df, key, name=name).orderBy(F.desc(name), key).limit(k)


def sort_by_key(df: DataFrame, *keys: str, ascending: bool = True) -> DataFrame:
    """Total order by the keys, nulls first ascending and last descending."""
    return df.orderBy(*keys, ascending=ascending)


def cube_counts(df: DataFrame, a: str, b: str, name: str = "n", first_key_only: bool = False) -> DataFrame:
    """Counts by (a, b), a, b and in total.

    Pairs are counted first, so the cube expands pairs instead of rows. ``first_key_only`` keeps rows whose ``a``
    is not null; a subtotal over ``b`` then looks like a real null in ``b`` (see :func:`rollup_counts`).
    """
    cube = count_by(df, a, b, name="_n").cube(a, b).agg(F.sum("_n").alias(name))
    return cube.where(F.col(a).isNotNull()) if first_key_only else cube


def rollup_counts(df: DataFrame, a: str, b: str, name: str = "n", level: str = "level") -> DataFrame:
    """Counts by (a, b) with level 0 and by a with level 1; the level tells subtotals from real nulls."""
    return (
        count_by(df, a, b, name="_n")
        .rollup(a, b)
        .agg(F.sum("_n").alias(name), F.grouping_id().alias(level))
        .where(F.col(level) < 3)
    )


def distinct_values(df: DataFrame, column: str, limit: int = MAX_COLUMNS) -> list[str]:
    """Sorted distinct values of a column as text, at most ``limit`` of them (more raise an error)."""
    values = [r[0] for r in df.select(F.col(column).cast("string")).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has over {limit} values; use code_vectors instead of one column per value")
    return sorted(v for v in values if v is not None)


def distinct_values_by_column(df: DataFrame, columns: Sequence[str], limit: int = MAX_COLUMNS) -> dict[str, list[str]]:
    """``distinct_values`` of several columns, in one pass over the rows."""
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    pairs = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for name, value in pairs.limit(limit * len(columns) + 1).collect():
        found[name].append(value)
    for name, values in found.items():
        if len(values) > limit:
            raise ValueError(f"{name} has over {limit} values; use code_vectors instead of one column per value")
    return {name: sorted(values) for name, values in found.items()}


def _count_of(column: Column, value) -> Column:
    return F.count(F.when(column == F.lit(value), 1))


def count_matrix(df: DataFrame, key: str, code: str, codes: Sequence[str], prefix: str = "") -> DataFrame:
    """One row per key with a count for every listed code; a code that never occurs is a column of zeros."""
    text = F.col(code).cast("string")
    if len(codes) <= _ONE_PASS_COLUMNS:
        return df.groupBy(key).agg(*[_count_of(text, c).alias(f"{prefix}{c}") for c in codes])
    pairs = df.select(key, text.alias(code))
    wide = pairs.groupBy(key).pivot(code, list(codes)).count()
    return wide.select(key, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"{prefix}{c}") for c in codes])


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """Contingency table with the layout of ``DataFrame.crosstab``: first column ``row_column`` as text, then one
    count per value of ``column``, with nulls on either side counted under the text 'null'.

    Values are looked up unless given; over ``MAX_COLUMNS`` of them are an error, as they would be columns. ``contingency``
    has no such limit.
    """
    name = f"{row}_{column}"
    pairs = df.select(
        F.coalesce(F.col(row).cast("string"), F.lit("null")).alias(name),
        F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("_value"),
    )
    if values is None:
        values = distinct_values(pairs, "_value")
    return count_matrix(pairs, name, "_value", values)


def contingency(df: DataFrame, row: str, column: str, name: str = "n") -> DataFrame:
    """Counts of each pair of values in long form, nulls under the text 'null': a contingency table without a limit."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in (row, column)]
    return df.select(*texts).groupBy(row, column).agg(F.count(F.lit(1)).alias(name))


def one_hot_counts(
    df: DataFrame,
    key: str,
    categories: Mapping[str, Sequence[str]],
    prefix: bool = True,
    total: str | None = None,
) -> DataFrame:
    """Counts per key of the listed values of several columns, in one pass over the rows.

    Columns are named ``column_value``, or ``value`` without the prefix; ``total`` names one more for all rows.
    """
    names = [
        (column, value, f"{place}:{value}", f"{column}_{value}" if prefix else str(value))
        for place, (column, values) in enumerate(categories.items())
        for value in values
    ]
    shown_names = [shown for *_, shown in names] + ([] if total is None else [total])
    if len(set(shown_names)) < len(shown_names):
        raise ValueError(f"two columns of the same name: {sorted({n for n in shown_names if shown_names.count(n) > 1})}")
    if len(names) <= _ONE_PASS_COLUMNS:
        cells = [_count_of(F.col(column), value).alias(shown) for column, value, _, shown in names]
        if total is not None:
            cells.append(F.count(F.lit(1)).alias(total))
        return df.groupBy(key).agg(*cells)
    # too many columns to test on every row: each row names its own cells, and the named cells are counted
    own = [F.concat(F.lit(f"{place}:"), F.col(column).cast("string")) for place, column in enumerate(categories)]
    wanted = [cell for _, _, cell, _ in names]
    if total is not None:
        own.append(F.lit(total))
        wanted.append(total)
    wide = count_matrix(df.select(key, F.explode(F.array(*own)).alias("_cell")), key, "_cell", wanted)
    shown = [F.col(f"`{cell}`").alias(name) for _, _, cell, name in names]
    return wide.select(key, *shown, *([] if total is None else [total]))


def matrix_means(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each column over all rows, in one row."""
    return matrix.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in columns])


def codes_per_subject(
    df: DataFrame, key: str, code: str, name: str = "codes", part: str = "part", max_codes: int = 1_000_000
) -> DataFrame:
    """All codes of a key in one text, sorted and with repeats, separated by blanks.

    A text holds at most ``max_codes`` codes. A key with more of them goes on in further rows, numbered by
    ``part`` from 0, so that no single value or task has to hold an unbounded group: the parts in order, joined by
    blanks, are the whole text. Repeats travel as counts until a part is built, so a heavy key moves one short row
    per distinct code and part.
    """
    counted = df.groupBy(key, code).agg(F.count(code).alias("n"))
    before = Window.partitionBy(key).orderBy(code).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    last = F.greatest(F.col("first"), F.col("first") + F.col("n") - 1)
    runs = counted.withColumn("first", first).withColumn(
        part,
        F.explode(F.sequence(F.floor(F.col("first") / max_codes), F.floor(last / max_codes))),
    )
    inside = F.least(F.col("first") + F.col("n"), (F.col(part) + 1) * max_codes) - F.greatest(
        F.col("first"), F.col(part) * max_codes
    )
    pieces = runs.select(key, part, code, inside.cast("int").alias("n")).repartition(key, part)
    ordered = F.array_sort(F.collect_list(F.struct(code, "n")))
    spelled = F.flatten(F.transform(ordered, lambda run: F.array_repeat(run[code], run["n"])))
    return pieces.groupBy(key, part).agg(F.array_join(spelled, " ").alias(name))


def union_codes(sources: Mapping[str, DataFrame], code: str = "XCODE", prefix: bool = True) -> DataFrame:
    """Bag union of code tables of the same columns; codes are marked with their source (``lab:50813``), so that
    equal codes of two sources stay apart."""
    total = None
    for source, codes in sources.items():
        text = F.col(code).cast("string")
        marked = codes.withColumn(code, F.concat(F.lit(f"{source}:"), text) if prefix else text)
        total = marked if total is None else total.unionByName(marked)
    return total


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum, one row per column, in a single pass.

    ``n`` counts what is not null. Of a text column, the other figures are over the texts that are numbers.
    """
    stats = {"n": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    texts = {c for c, kind in df.dtypes if kind == "string"}
    wide = df.agg(
        *[
            f(F.col(c).try_cast("double") if c in texts and s != "n" else F.col(c)).alias(f"{c}_{s}")
            for c in columns
            for s, f in stats.items()
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"{c}_{s}").cast("bigint" if s == "n" else "double").alias(s) for s in stats],
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))
