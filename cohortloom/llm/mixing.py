"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its share of the target weights times the wanted total, over what it holds. A document's
number of copies is the inverse of the Poisson distribution with that mean at a uniform number hashed from seed and doc_id,
so it depends on nothing else. Copies are dealt out by a hash of seed, doc_id and copy and sorted by it: a shuffle of the
whole mix in one exchange, evenly spread whatever the sources look like.

Defined results: a null source is a source of its own; an empty or null text counts as one character; sources without a
positive weight leave the mix; repeated rows get the same number of copies each; an empty table gives an empty mix. Columns of
``docs`` named like an added one (copy, copies, shuffle_key) are replaced, all others come back as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.names import exactly, free_name
from cohortloom.llm.common import text_or_empty, written
from cohortloom.session import BROADCAST_BYTES, BROADCAST_ROWS

ADDED = ("copy", "copies", "shuffle_key")


def _hashed(*parts: Column, digits: int) -> Column:
    """The first hexadecimal digits of the MD5 of the parts, as a whole number."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, digits), 16, 10).cast("bigint")


def source_sizes(docs: DataFrame) -> DataFrame:
    """Characters by source; every document counts as one at least."""
    size = F.greatest(F.char_length(text_or_empty()), F.lit(1))
    return docs.groupBy("source").agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n_docs"))


def tempered_weights(sizes: DataFrame, power: float = 0.5) -> DataFrame:
    """Target weights in proportion to a power of the sources' sizes: below 1, small sources are raised."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(power)).alias("weight"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """``source, rate``: mean copies of each document. ``total`` is the wanted size of the mix, by default as before."""
    target = weights.filter("weight > 0").select(F.col("source").alias("_source"), "weight")
    both = sizes.join(target, F.col("source").eqNullSafe(F.col("_source")), "left")
    sums = both.agg(F.sum("weight").alias("weights"), F.sum("size").cast("double").alias("size")).first()
    if not sums["weights"]:
        return both.select("source", F.lit(0.0).alias("rate")).limit(0)
    scale = F.lit(sums["size"] if total is None else float(total)) / F.lit(sums["weights"])
    return both.filter("weight IS NOT NULL").select("source", (F.col("weight") * scale / F.col("size")).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``source, steps``: the Poisson distribution function at 0, 1, 2, ... until it is 1 within 1e-15."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    k = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.when(F.col("k") > 0, F.ln(F.col("k").cast("double"))).otherwise(0.0)).over(up_to)
    k = k.withColumn("p", F.exp(-F.col("rate") + F.col("k") * F.ln("rate") - log_factorial))
    k = k.withColumn("cdf", F.sum("p").over(up_to))
    return k.groupBy("source").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda s: s["cdf"]).alias("steps")
    )


def _few(steps: DataFrame) -> DataFrame:
    """The table of steps, for a broadcast where its counted rows and the summed length of its arrays are small."""
    rows, numbers = steps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("steps").cast("bigint")), F.lit(0))).first()
    return F.broadcast(steps) if rows <= BROADCAST_ROWS and 8 * numbers + 64 * rows <= BROADCAST_BYTES else steps


def poisson_mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    total: float | None = None,
    seed: int = 7,
    added: tuple[str, str, str] = ADDED,
) -> DataFrame:
    """The mix: all columns of ``docs`` plus ``copy`` (from 1), ``copies`` and ``shuffle_key``, globally shuffled.

    ``weights`` has ``source, weight``; without it, sizes to the power of a half. Its table of rates is broadcast where it is small,
    arrays included; beyond that Spark joins, and splits hot sources, by itself. ``added`` renames the added columns.
    """
    copy, copies, shuffle_key = added
    sizes = written(source_sizes(docs), "source-sizes")
    steps = written(poisson_steps(repetition_rates(sizes, tempered_weights(sizes) if weights is None else weights, total)), "poisson")
    kept = [c for c in docs.columns if c not in added]
    of, held, level = (free_name([*kept, *added], n) for n in ("of_source", "steps", "level"))
    steps = _few(steps).select(F.col("source").alias(of), F.col("steps").alias(held))
    number = _hashed(F.lit(seed), F.col("doc_id"), digits=13) / F.lit(float(1 << 52))
    counted = docs.select(*[exactly(c) for c in kept], number.alias(level)).join(steps, F.col("source").eqNullSafe(F.col(of)))
    counted = counted.withColumn(copies, F.size(F.filter(held, lambda s: s <= F.col(level)))).filter(exactly(copies) > 0)
    mixed = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), exactly(copies))))
    key = _hashed(F.lit(seed), F.col("doc_id"), exactly(copy), F.lit("order"), digits=15)
    mixed = mixed.select(*[exactly(c) for c in kept], exactly(copy), exactly(copies), key.alias(shuffle_key))
    return mixed.repartition(exactly(shuffle_key)).sortWithinPartitions(exactly(shuffle_key))
