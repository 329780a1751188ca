"""Registered queries of the corpus operators, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import (
    exact_dedup,
    golay_dedup,
    language_id,
    license_join,
    mixing,
    piece_codec,
    piecewise_hash,
    prefix_trie,
    quality_rules,
    target_resampling,
    token_counts,
    toxicity,
    url_lists,
)
from cohortloom.session import scratch_path

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[query.__name__] = query
    return query


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and every page (one of doc_id and page_id is set)."""
    docs = documents(spark, sf_dir)
    pages = language_id.page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = language_id.document_rows(docs).unionByName(pages, allowMissingColumns=True)
    found = language_id.identify(rows, language_id.train(docs))
    return found.select("doc_id", "page_id", "host", "declared", "lang", "confidence", "text_lang")


@register
def op2_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    return piecewise_hash.compare_with_next(documents(spark, sf_dir))


@register
def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, sources weighted by the square root of their characters, of the size of the corpus."""
    return mixing.poisson_mix(documents(spark, sf_dir))


ORACLE["op3_poisson_mixing"] = """
WITH sizes AS (
  SELECT source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, sqrt(size) * ((SELECT sum(size) FROM sizes) / (SELECT sum(sqrt(size)) FROM sizes)) / size AS rate FROM sizes
), ks AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates
), steps AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lf)) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS lf FROM ks)
), arrays AS (
  SELECT source, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY source
), counted AS (
  SELECT d.*, len(list_filter(a.cdf, lambda c: c <= ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
      / 4503599627370496.0))::INT AS copies
  FROM documents d JOIN arrays a ON d.source IS NOT DISTINCT FROM a.source
), copied AS (
  SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM counted
)
SELECT *, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy || ':order'), 1, 15))::BIGINT AS shuffle_key
FROM copied
"""


@register
def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by pieces with their spans, and decoded again."""
    columns = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    return piece_codec.encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), columns)


def _draw(text: Column, n: int) -> Column:
    """A whole number under n that follows from the text."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def _first_day() -> Column:
    return F.lit("2020-01-01").cast("date")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures; the day of the fetch, which the table lacks, follows from the page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    day = F.date_add(_first_day(), _draw(F.concat(F.lit("fetch:"), F.col("page_id").cast("string")), 1461))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def list_history(pages: DataFrame) -> DataFrame:
    """A list's history over the hosts of the pages: some hosts and domains are blocked, removed and blocked again, some
    starts of paths are allowed."""
    host, path = url_lists.host_of(F.col("url")), url_lists.path_of(F.col("url"))
    hosts = pages.select(host.alias("host"), F.split(path, "/")[1].alias("step")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    domain = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3))

    def entries(key: Column, share: int, rest: int, days: list[tuple[int, str]]) -> DataFrame:
        listed = hosts.select(key.alias("key")).distinct().filter("key IS NOT NULL").filter(_draw(F.col("key"), share) == rest)
        start = _draw(F.concat(F.lit("listed:"), F.col("key")), 900)
        steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(a).alias("action")) for d, a in days])
        listed = listed.withColumn("e", F.explode(steps))
        return listed.select("key", F.date_add(_first_day(), start + F.col("e.d")).alias("listed_on"), "e.action")

    blocked = [(0, "block"), (200, "remove"), (450, "block")]
    start = F.when(F.col("step") != "", F.concat_ws("/", "host", "step"))
    return (
        entries(F.col("host"), 3, 0, blocked)
        .unionByName(entries(domain, 5, 1, blocked))
        .unionByName(entries(start, 4, 2, [(100, "allow"), (700, "remove")]))
    )


@register
def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page held against the entries that were valid on the day of its fetch."""
    decided = url_lists.decide(captures(spark, sf_dir), list_history(captures(spark, sf_dir)))
    return decided.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "valid_from")})


ORACLE["op5_url_lists"] = r"""
WITH captures AS (
  SELECT page_id, url,
    (DATE '2020-01-01' + (('0x' || substr(md5('fetch:' || page_id), 1, 8))::BIGINT % 1461)::INT)::DATE AS fetched_on,
    lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?(/[^?#]*)?', 1), '')) AS host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?(/[^?#]*)?', 2), '') AS path
  FROM pages
), keys AS (
  SELECT DISTINCT host AS key, 3 AS share, 0 AS rest, 'b' AS kind FROM captures WHERE host <> ''
  UNION SELECT regexp_extract(host, '([^.]*\.)?([^.]*\.)?[^.]*$'), 5, 1, 'b' FROM captures WHERE host <> ''
  UNION SELECT host || '/' || split_part(path, '/', 2), 4, 2, 'a' FROM captures WHERE host <> '' AND split_part(path, '/', 2) <> ''
), days AS (
  SELECT * FROM (VALUES ('b', 0, 'block'), ('b', 200, 'remove'), ('b', 450, 'block'), ('a', 100, 'allow'), ('a', 700, 'remove'))
    AS t(kind, d, action)
), history AS (
  SELECT key, action,
    (DATE '2020-01-01' + (('0x' || substr(md5('listed:' || key), 1, 8))::BIGINT % 900)::INT + d)::DATE AS listed_on
  FROM keys JOIN days USING (kind) WHERE ('0x' || substr(md5(key), 1, 8))::BIGINT % share = rest
), daily AS (
  SELECT key, listed_on, max(action) AS action FROM history GROUP BY key, listed_on
), ranges AS (
  SELECT key, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY key ORDER BY listed_on) AS valid_until FROM daily
), candidates AS (
  SELECT DISTINCT page_id, url, fetched_on, unnest(list_concat(
    list_transform(range(1, len(split(host, '.')) + 1), lambda k: array_to_string(split(host, '.')[k:], '.')),
    list_transform(range(1, len(list_filter(split(path, '/'), lambda s: s <> '')) + 1),
      lambda k: host || '/' || array_to_string(list_filter(split(path, '/'), lambda s: s <> '')[1:k], '/'))
  )) AS key FROM captures WHERE host <> ''
), active AS (
  SELECT c.page_id, c.url, c.fetched_on, count(*) AS n_active, arg_max(r.key, length(r.key)) AS decided_by,
    arg_max(r.valid_from, length(r.key)) AS valid_from, arg_max(r.action, length(r.key)) AS action
  FROM candidates c JOIN ranges r ON c.key = r.key AND r.action <> 'remove' AND c.fetched_on >= r.valid_from
    AND (r.valid_until IS NULL OR c.fetched_on < r.valid_until)
  GROUP BY ALL
)
SELECT c.page_id, c.url, c.fetched_on::VARCHAR AS fetched_on, c.host, coalesce(a.n_active, 0) AS n_active, a.decided_by,
  a.valid_from::VARCHAR AS valid_from, a.action,
  coalesce(a.action = 'block', false) AS blocked
FROM captures c LEFT JOIN active a USING (page_id, url, fetched_on)
"""


@register
def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates in every whole text."""
    return license_join.scan_licenses(documents(spark, sf_dir))


ORACLE["op6_license_join"] = license_join.brute_force_sql()


@register
def op7_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = golay_dedup.near_components(documents(spark, sf_dir))
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


@register
def op8_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents added to a new digest index."""
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index"))
    decided = index.add(documents(spark, sf_dir))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op8_digest_index"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels outside the held-out part."""
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@register
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text judged by the base rules and by its divergence from its language."""
    return quality_rules.judge(documents(spark, sf_dir))


ORACLE["op11_quality_rules"] = quality_rules.judge_sql()


@register
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE["op12_prefix_trie"] = prefix_trie.prefix_trie_sql()


@register
def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark's words, and the ranks of those drawn."""
    drawn = target_resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE["op13_target_resampling"] = target_resampling.resample_sql()
