r"""Importance resampling towards a target distribution.

Features (runs of words) are hashed into buckets. A bucket's gain is the log ratio of its share in the target texts and in all
documents, in whole thousandths; a document's weight is the sum of the gains of its features, looked up in an array. With Gumbel noise
from a hash of its identity, the documents with the highest scores are a draw without replacement in proportion to the weights' exponentials.

The cutoff is found by bisection over numbers: jobs that count the written scores above some thresholds narrow it down, then the same
over the doc_ids of documents tied at it, and over row numbers where rows are repeated. So exactly as many rows are drawn as wanted, and
no row is sorted to find them. Only the drawn rows are dealt out by ranges of the order, for their ranks.

Defined results: a null text counts as empty; a document without features has weight 0; a null doc_id hashes as an empty one and comes
last among ties; repeated rows are drawn one by one; an empty target or an empty table is no error (the gains then favour what is
rare); columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import text_or_empty, written
from cohortloom.llm.license_join import words_of
from cohortloom.operators.ranking import numbered

#: Buckets, longest run of words, least words of a document that may be drawn, share that is drawn in percent, seed of the noise.
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Thresholds that one job counts at.
WAYS = 16
_LOWEST = -(1 << 63)


def feature_runs(words: Column, longest: int) -> Column:
    """All runs of one to so many consecutive words, joined by blanks."""
    def of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda at: at <= F.size(words) - n)
        return F.transform(starts, lambda at: F.concat_ws(" ", *[F.get(words, at + k) for k in range(n)]))

    return F.concat(words, *[of(n) for n in range(2, longest + 1)]) if longest > 1 else words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = RUN) -> list[int]:
    """Features in each bucket over all texts: as many numbers as there are buckets."""
    words = texts.select(words_of(text_or_empty()).alias("words"))
    found = words.select(F.explode(feature_runs(F.col("words"), longest)).alias("feature"))
    counts = found.groupBy((F.crc32("feature") % buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    held = dict(tuple(r) for r in counts.collect())
    return [held.get(k, 0) for k in range(buckets)]


def gains(spark: SparkSession, source: list[int], target: list[int]) -> list[int]:
    """Each bucket's gain, in thousandths of the natural logarithm, rounded down."""
    buckets, s_all, t_all = len(source), sum(source), sum(target)
    rows = spark.createDataFrame([(k, float(s), float(t)) for k, (s, t) in enumerate(zip(source, target))], "k int, s double, t double")
    ratio = (F.col("t") + 1) * F.lit(float(s_all + buckets)) / ((F.col("s") + 1) * F.lit(float(t_all + buckets)))
    return [r[0] for r in rows.orderBy("k").select(F.floor(1000 * F.log(ratio))).collect()]


def scores(docs: DataFrame, bucket_gains: list[int], longest: int = RUN, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each document."""
    # one literal array, which is parsed when the query is planned
    table = F.split(F.lit(",".join(map(str, bucket_gains))), ",").cast("array<bigint>")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(text_or_empty()).alias("words"))
    rows = rows.withColumn("features", feature_runs(F.col("words"), longest))
    gain = F.aggregate(
        "features", F.lit(0).cast("bigint"), lambda a, f: a + F.get(table, (F.crc32(f) % len(bucket_gains)).cast("int"))
    )
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint") + 0.5) / 4294967296
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    sizes = [F.size(c).cast("bigint").alias(n) for c, n in (("words", "n_words"), ("features", "n_features"))]
    rows = rows.select("doc_id", *sizes, gain.alias("weight"), noise.alias("noise"))
    return rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def cutoff(rows: DataFrame, key: Column, wanted: int) -> tuple[int, int, int]:
    """The largest number that at least ``wanted`` rows (1 or more, and no more than there are) reach by their whole-number key, how
    many reach it, and how many are above it."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    at_low = None
    while low < high:
        step = max(1, -(-(high - low) // WAYS))
        points = list(range(low + step, high + 1, step)) if low + step <= high else [high]
        counts = rows.agg(*[F.count_if(key >= F.lit(p)) for p in points]).first()
        reached = [(p, n) for p, n in zip(points, counts) if n >= wanted]
        beyond = [p for p, n in zip(points, counts) if n < wanted]
        if reached:
            low, at_low = reached[-1]
        if beyond:
            high = beyond[0] - 1
        if at_low == wanted:
            break
    reach, above = rows.agg(F.count_if(key >= F.lit(low)), F.count_if(key > F.lit(low))).first()
    return low, reach, above


def highest(rows: DataFrame, keys: list[Column], wanted: int) -> Column:
    """The condition that holds for exactly the ``wanted`` rows with the highest keys, of which the last must be unique."""
    if wanted <= 0:
        return F.lit(False)
    key, rest = keys[0], keys[1:]
    bound, reach, above = cutoff(rows, key, wanted)
    if reach == wanted or not rest:
        return key >= F.lit(bound)
    return (key > F.lit(bound)) | ((key == F.lit(bound)) & highest(rows.filter(key == F.lit(bound)), rest, wanted - above))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = RUN,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; the rank, from 1, of those drawn.

    Of the documents with enough words, so many percent (rounded down) with the highest scores are drawn; ties go to the smaller doc_id.
    """
    gained = gains(docs.sparkSession, bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = scores(docs, gained, longest, seed).withColumn("row_no", F.monotonically_increasing_id())
    rows = written(rows, "importance-scores")
    able = rows.filter(F.col("n_words") >= least_words)
    # turned bits turn the order, without an overflow
    keys = [F.col("score"), F.coalesce(F.bitwise_not("doc_id"), F.lit(_LOWEST)), F.bitwise_not("row_no")]
    drawn = (F.col("n_words") >= least_words) & highest(able, keys, able.count() * percent // 100)
    ranked = numbered(rows.filter(drawn), F.desc("score"), F.asc_nulls_last("doc_id"), "row_no", name="place")
    ranked = ranked.withColumn("rank", F.col("place") + 1).drop("place")
    others = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(others).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def crc32_sql(words: str) -> str:
    """DuckDB CTEs for ``crcs(word, crc)``, the CRC-32 of the UTF-8 bytes of the words that a query gives."""
    return f"""steps AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) AS t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), octets AS (
  SELECT i, v FROM steps WHERE k = 8
), walk AS (
  SELECT word, hex(encode(word)) AS hexed, 0 AS k, 4294967295::BIGINT AS c FROM ({words})
  UNION ALL
  SELECT w.word, w.hexed, w.k + 1, xor(w.c >> 8, o.v)
  FROM walk w JOIN octets o ON o.i = (xor(w.c, ('0x' || substr(w.hexed, 2 * w.k + 1, 2))::BIGINT) & 255) WHERE 2 * w.k < length(w.hexed)
), crcs AS (
  SELECT word, xor(c, 4294967295) AS crc FROM walk WHERE 2 * k = length(hexed)
)"""


def resample_sql() -> str:
    """DuckDB SQL for the rows of ``resample`` on documents, with the table benchmark as target and runs of one word."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents
), wanted AS (
  SELECT {words} AS words FROM benchmark
), features AS (
  SELECT r, unnest(words) AS word FROM docs
), goals AS (
  SELECT unnest(words) AS word FROM wanted
), {crc32_sql("SELECT word FROM features UNION SELECT word FROM goals")}, buckets AS (
  SELECT word, crc % {BUCKETS} AS bucket FROM crcs
), held AS (
  SELECT bucket, count(*) AS s FROM features JOIN buckets USING (word) GROUP BY bucket
), sought AS (
  SELECT bucket, count(*) AS t FROM goals JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM features) + {BUCKETS})::DOUBLE
    / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM goals) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) AS b(bucket) LEFT JOIN held USING (bucket) LEFT JOIN sought USING (bucket)
), weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM features JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT
    AS score
  FROM docs LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {LEAST_WORDS} AND place <= n * {PERCENT} // 100 THEN place END AS rank
FROM ranked
"""
