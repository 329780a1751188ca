"""Language identification by Bayesian evidence fusion.

The text gives a likelihood by hashed byte trigrams, from tables trained on a bounded sample of the documents of each language.
Every language that any document is labelled with can be the answer, however rare it is. Soft counts
of the languages that texts show are summed up by host, domain, address suffix and over all rows (grouped aggregation with
partial sums), and each level is smoothed towards the one above it: that is the prior of a host, less the row's own part. The
language that the markup declares is held against how often rows of each language declare it, by soft counts too. The
posterior is the product.

Defined results: a null or empty text, or one under three bytes, tells nothing, so the other evidence decides; a missing
declaration tells nothing; rows without a host share one; equal posteriors go to the first language by name; rows without any
labelled document to train on get no language and confidence 0; repeated rows are rows of their own; other columns come back as
they are, whatever their names, but for ones named like a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.names import exactly
from cohortloom.llm.common import SLICE_ROWS, slices, text_or_empty, written

#: Buckets of trigrams (a power of two); documents of the training sample, about, of each language (all, where it has fewer).
BITS, SAMPLE_DOCS = 15, 6_000
#: Languages whose trigrams a task counts before it passes the counts on.
COUNTED = 64
#: Pseudo-counts: of a trigram, of a level's parent, of the belief that a declaration is right; that belief.
TRIGRAM, PARENT, DECLARED, RIGHT = 0.5, 8.0, 20.0, 0.9
#: A trigram's weight: neighbours overlap and depend on each other.
WEIGHT = 1 / 6
LEVELS = ("suffix", "domain", "host")
ADDED = ("lang", "confidence", "text_lang")
_PART = 1 << 18


def trigrams(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    mixed = (codes[:-2] << np.uint32(16) | codes[1:-1] << np.uint32(8) | codes[2:]) * np.uint32(2654435761)
    return mixed >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class LanguageModel:
    """Log-likelihoods of trigram buckets (rows) in languages (columns, by name)."""

    languages: list[str]
    table: np.ndarray

    def likelihoods(self, text: str) -> np.ndarray:
        """The weighted log-likelihood of the whole text in each language."""
        found, total = trigrams(text) if text else np.zeros(0, np.uint32), np.zeros(len(self.languages))
        for at in range(0, len(found), _PART):
            total += self.table[found[at : at + _PART]].sum(axis=0, dtype=np.float64)
        return total * WEIGHT


def training_sample(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """All languages of the labelled documents, by name, and ``lang, text`` of about ``SAMPLE_DOCS`` documents of each.

    The languages come from a grouped count. A language's documents are taken up to a bound of their hash that follows from its
    count, and never under its least hash, so none is without a document.
    """
    labelled = docs.filter("lang IS NOT NULL").select("lang", "text", F.xxhash64("doc_id").alias("_hash"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_hash").alias("least")).collect()
    bounds = [(r["lang"], max(r["least"], min((SAMPLE_DOCS << 64) // r["n"], 1 << 64) - (1 << 63) - 1)) for r in sizes]
    upto = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, _bound bigint"))
    sample = labelled.join(upto, "lang").filter("_hash <= _bound")
    return sorted(r["lang"] for r in sizes), sample.select("lang", text_or_empty().alias("text"))


def train(docs: DataFrame) -> LanguageModel:
    """Tables from the training sample.

    Trigrams are counted in each task and summed up by language and bucket; a language's sums, at most one for each bucket, are
    made into its column, and the driver gets one column after the other.
    """
    languages, sample = training_sample(docs)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32))

    def passed_on(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            used = np.flatnonzero(own)
            columns = [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(own[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])
        counts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for piece in slices(batches):
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                if lang not in counts and len(counts) >= COUNTED:
                    yield from passed_on(counts)
                own = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                if text:
                    own += np.bincount(trigrams(text), minlength=1 << BITS)
        yield from passed_on(counts)

    def column(sums: pa.Table) -> pa.Table:
        own = np.full(1 << BITS, TRIGRAM)
        own[sums["bucket"].to_numpy()] += sums["n"].to_numpy()
        logs = np.log(own / own.sum()).astype(np.float32)
        return pa.table([sums["lang"].slice(0, 1), pa.array([logs.tobytes()], pa.binary())], ["lang", "logs"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n bigint")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    columns = summed.groupBy("lang").applyInArrow(column, "lang string, logs binary")
    table = np.full((1 << BITS, len(languages)), -np.log(1 << BITS), np.float32)
    place = {lang: k for k, lang in enumerate(languages)}
    for row in columns.toLocalIterator():
        table[:, place[row["lang"]]] = np.frombuffer(row["logs"], np.float32)
    return LanguageModel(languages, table)


def likelihoods(rows: DataFrame, model: LanguageModel, column: str = "text") -> Column:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            found = []
            for at in range(0, len(batch), SLICE_ROWS):
                found += [known.likelihoods(t) for t in batch.slice(at, SLICE_ROWS).to_pylist()]
            yield pa.array(found, pa.list_(pa.float64()))

    return score(text_or_empty(column))


def _with(values: Column, one: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Each value with the one number, which is computed once; inside a lambda it would be for each value again."""
    return F.zip_with(values, F.array_repeat(one, F.size(values)), f)


def _shares(logs: Column) -> Column:
    """Probabilities in proportion to the exponentials."""
    weights = _with(logs, F.array_max(logs), lambda x, top: F.exp(x - top))
    return _with(weights, F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), lambda x, total: x / total)


def _sums(rows: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """Soft counts by key: one number for each language."""
    summed = rows.groupBy(*keys).agg(*[F.sum(F.col("shown")[k]).alias(f"_{k}") for k in range(n)])
    return summed.select(*keys, F.array(*[f"_{k}" for k in range(n)]).alias(name))


def _smoothed(own: Column, less: Column, parent: Column) -> Column:
    """Shares of a level's counts without the row's own part, smoothed towards its parent's."""
    rest = F.zip_with(own, less, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    total = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) + PARENT
    return _with(F.zip_with(rest, parent, lambda a, p: a + PARENT * p), total, lambda x, t: x / t)


def identify(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns but the text, with ``lang, confidence, text_lang`` (in place of columns of these names).

    ``rows`` has ``text, declared, suffix, domain, host`` (the last three from wide to narrow; null ones count as empty).
    """
    n = len(model.languages)
    kept = [c for c in rows.columns if c not in ("text", *ADDED)]
    if not n:
        none = F.lit(None).cast("string")
        return rows.select(*[exactly(c) for c in kept], none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"))
    # the caller's columns are one struct on the way, so that none of them meets a name used here
    own = F.struct(*[exactly(c) for c in kept]).alias("own")
    filled = rows.select(own, "text", "declared", *[F.coalesce(c, F.lit("")).alias(c) for c in LEVELS])
    scored = filled.withColumn("logs", likelihoods(filled, model)).drop("text")
    scored = written(scored.withColumn("shown", _shares(F.col("logs"))), "language-evidence")

    by_host = written(_sums(scored, list(LEVELS), "of_host", n).withColumnRenamed("of_host", "shown"), "language-hosts")
    hosts = by_host.withColumnRenamed("shown", "of_host")
    # sums are written, so that these joins have a shuffle on both sides and can split a domain or suffix with very many hosts
    hosts = hosts.join(written(_sums(by_host, ["suffix", "domain"], "of_domain", n), "language-domains"), ["suffix", "domain"])
    hosts = hosts.join(written(_sums(by_host, ["suffix"], "of_suffix", n), "language-suffixes"), "suffix")
    hosts = written(hosts, "language-levels")
    world = by_host.agg(*[F.coalesce(F.sum(F.col("shown")[k]), F.lit(0.0)).alias(f"_{k}") for k in range(n)]).first()
    everywhere = F.array(*[F.lit(float(x + 1)) for x in world])
    declared = scored.filter("declared IS NOT NULL")
    known = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in model.languages], "declared string"))
    said = _sums(declared.join(known, "declared", "left_semi"), ["declared"], "of_declared", n).collect()

    fused = scored.join(hosts, list(LEVELS))
    prior = _smoothed(everywhere, F.col("shown"), F.array(*[F.lit(1 / n)] * n))
    for level in LEVELS:
        prior = _smoothed(F.col(f"of_{level}"), F.col("shown"), prior)
    fused = fused.withColumn("prior", prior)
    evidence = F.zip_with("logs", "prior", lambda a, p: a + F.log(p))
    told = _told(model.languages, {r["declared"]: r["of_declared"] for r in said}, world)
    told = rows.sparkSession.createDataFrame(told, "declared string, told array<double>")
    fused = fused.join(F.broadcast(told), "declared", "left")
    evidence = F.when(F.col("told").isNotNull(), F.zip_with(evidence, F.col("told"), lambda a, b: a + b)).otherwise(evidence)
    fused = fused.withColumn("posterior", _shares(evidence))
    names = F.array(*[F.lit(x) for x in model.languages])

    def best(shares: str) -> Column:
        return F.element_at(names, F.array_position(shares, F.array_max(shares)).cast("int"))

    return fused.select(
        "own.*", best("posterior").alias("lang"), F.array_max("posterior").alias("confidence"), best("shown").alias("text_lang")
    )


def _told(languages: list[str], counts: dict[str, list[float]], world: tuple) -> list[tuple[str, list[float]]]:
    """For each language that any row declares, the log-likelihood of that declaration in each language."""
    n, total = len(languages), np.array(world) + DECLARED
    told = []
    for k, name in enumerate(languages):
        if name in counts:
            belief = np.full(n, (1 - RIGHT) / max(n - 1, 1))
            belief[k] = RIGHT
            told.append((name, np.log((np.array(counts[name]) + DECLARED * belief) / total).tolist()))
    return told


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows to identify: visible text, declared language, and the levels of the address."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    labels = F.split(host, r"\.")
    html = F.coalesce("html", F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return pages.select(
        "page_id",
        F.nullif(declared, F.lit("")).alias("declared"),
        F.element_at(labels, -1).alias("suffix"),
        F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3)).alias("domain"),
        host.alias("host"),
        F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows to identify: a source is their host, and nothing is declared."""
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id",
        none.alias("declared"),
        F.lit("").alias("suffix"),
        F.lit("").alias("domain"),
        F.col("source").cast("string").alias("host"),
        text_or_empty().alias("text"),
    )
