import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from cohortloom.llm import mixing
from cohortloom.llm.mixing import poisson_mix, repetition_rates, source_sizes


def copies(doc_id, rate, seed=7):
    level = int(hashlib.md5(f"{seed}:{doc_id if doc_id is not None else 'null'}".encode()).hexdigest()[:13], 16) / 2**52
    n, upto = 0, 0.0
    while n < rate + 12 * math.sqrt(rate) + 30:
        upto += math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1))
        if upto > level:
            break
        n += 1
    return n


def test_counts_are_inverse_poisson(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "repeat('x', int(id % 50)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE concat('s', id % 7) END AS source"
    )
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += max(len(r["text"]), 1)
    root = sum(math.sqrt(v) for v in size.values())
    rate = {s: math.sqrt(v) / root * sum(size.values()) / v for s, v in size.items()}
    found = Counter(r["doc_id"] for r in poisson_mix(docs).select("doc_id").collect())
    assert found == Counter({r["doc_id"]: n for r in rows if (n := copies(r["doc_id"], rate[r["source"]]))})


def test_target_weights_are_met(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'abcd' AS text", "if(id % 4 = 0, 'b', 'a') AS source")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("unknown", 0.0)], "source string, weight double")
    mixed = Counter(r["source"] for r in poisson_mix(docs, weights, total=160_000).collect())
    assert abs(mixed["a"] - 10_000) < 400 and abs(mixed["b"] - 30_000) < 700


def test_high_rates(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "'a' AS text", "'s' AS source")
    mixed = Counter(r["doc_id"] for r in poisson_mix(docs, total=40 * 2000.0).collect())
    assert all(1700 < n < 2300 for n in mixed.values()) and len(mixed) == 40
    assert mixed == Counter({i: copies(i, 2000.0) for i in range(40)})


def test_awkward_rows_and_columns(spark, awkward, nothing):
    mixed = poisson_mix(awkward, total=3e6)
    assert mixed.columns == [c for c in awkward.columns if c != "copy"] + ["copy", "copies", "shuffle_key"]
    rows = mixed.collect()
    assert {r["source"] for r in rows} >= {"a", "b", None}
    assert poisson_mix(nothing).count() == 0
    gone = spark.createDataFrame([], "source string, weight double")
    assert poisson_mix(awkward, gone).count() == 0


def test_copies_are_spread_evenly(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'abcd' AS text", "if(id % 3 = 0, 'hot', 'cold') AS source")
    parts = poisson_mix(docs).selectExpr("spark_partition_id() AS p", "shuffle_key", "source").toPandas()
    for _, part in parts.groupby("p"):
        assert part.shuffle_key.is_monotonic_increasing
    rates = repetition_rates(source_sizes(docs), spark.createDataFrame([("hot", 1.0)], "source string, weight double")).collect()
    assert [r["source"] for r in rates] == ["hot"]


def test_a_wide_table_of_rates_is_not_broadcast(spark):
    """What counts is the length of the arrays, not the number of sources."""
    rates = spark.createDataFrame([(f"s{k}", 40_000.0) for k in range(300)], "source string, rate double")
    steps = mixing.poisson_steps(rates)
    assert "ResolvedHint" not in mixing._few(steps)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in mixing._few(steps.limit(3))._jdf.queryExecution().analyzed().toString()


def test_thousands_of_tiny_sources(spark):
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    big = spark.range(50).select((F.col("id") + 20_000).alias("doc_id"), F.repeat(F.lit("long "), F.lit(20_000)).alias("text"), F.lit("big").alias("source"))
    out = mixing.poisson_mix(docs.unionByName(big))
    assert abs(out.agg(F.sum(F.length("text"))).first()[0] / 5_010_000 - 1) < 0.05
