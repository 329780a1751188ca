"""The corpus pipeline: each stage works on all that the one before it kept.

Defined results: a null text counts as empty in every stage; of rows that are repeated with their doc_id and text one stays, and rows
that share only a doc_id stay or go together as near copies; an empty table goes through to an empty result; further columns of the
documents, whatever their names, come out of every stage but the last, which returns the doc_id and the encoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortloom.functions.names import exactly, free_name
from cohortloom.llm import exact_dedup, golay_dedup, mixing, piece_codec, toxicity
from cohortloom.session import scratch_path


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.drop_exact_copies(docs, exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return golay_dedup.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights, in random order."""
    added = tuple(free_name(docs.columns, name) for name in mixing.ADDED)
    return mixing.poisson_mix(docs, added=added).select(*[exactly(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document of the mix, with digests of ids and decoded text."""
    columns = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return piece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), columns)


STAGES = [
    ("toxicity", toxic_documents),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding and decoding", encoded),
]
#: Trained models and tokenizers can't be put into SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
