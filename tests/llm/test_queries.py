"""The registered queries keep to their columns, and the pipeline's stages to brute force on what they are given."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from cohortloom.llm import toxicity
from cohortloom.llm.golay_dedup import simhash
from cohortloom.llm.mixing import source_sizes, tempered_weights
from tests.llm.test_golay_dedup import roots
from tests.llm.test_mixing import copies

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_piecewise_hash": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_piece_codec": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_license_join": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op7_golay_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_digest_index": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op11_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op13_target_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, texts, name):
    found = driver.queries()[name](spark, SMALL)
    wanted = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    assert found.dtypes[: len(wanted)] == wanted
    assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == sorted(texts)


def test_every_number_has_one_query():
    names = [q for q in driver.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in driver.queries()


def test_whole_texts_as_the_libraries_have_them(spark, texts):
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = {r["doc_id"]: r for r in driver.queries()["op4_piece_codec"](spark, SMALL).collect()}
    counted = {r["doc_id"]: r for r in driver.queries()["op10_token_counts"](spark, SMALL).collect()}
    for doc_id, text in texts.items():
        ids = pieces.encode(text or "")
        row = encoded[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()
        row, n = counted[doc_id], len(words.encode(text or "", add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len((text or "").encode()), n, n > 2048)


def near_roots(texts):
    marks = {i: simhash(t or "") for i, t in texts.items()}
    ids = sorted(marks)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (marks[a] ^ marks[b]).bit_count() <= 4]
    return roots(ids, linked)


def test_components_of_all_documents(spark, texts):
    found = {r["doc_id"]: r for r in driver.queries()["op7_golay_dedup"](spark, SMALL).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == near_roots(texts)
    assert all(int(r["fingerprint"], 16) == simhash(texts[i] or "") for i, r in found.items())


def test_languages_of_documents_and_pages(spark, docs):
    found = driver.queries()["op1_language_id"](spark, SMALL)
    right = found.join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").selectExpr("avg(int(lang = truth))").first()[0]
    assert right > 0.97
    assert found.filter("page_id IS NOT NULL").count() == spark.read.parquet(f"{SMALL}/pages.parquet").count()


def test_stages_against_brute_force(spark, docs, tmp_path):
    """Each stage is held against plain code on its own input."""
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding",
    ]
    inputs, given = [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, SMALL).write.parquet(str(tmp_path / str(k)))
        given = spark.read.parquet(str(tmp_path / str(k)))
        inputs.append(given)
    assert all(x.columns == docs.columns for x in inputs[1:5])
    start, clean, distinct, apart, mixed, encoded = ([r.asDict() for r in x.collect()] for x in inputs)

    scorer = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    kept = [r["doc_id"] for r, s in zip(start, scorer([r["text"] or "" for r in start])) if s < toxicity.THRESHOLD]
    assert sorted(r["doc_id"] for r in clean) == sorted(kept) and len(kept) > len(start) / 2

    last = {}
    for r in sorted(clean, key=lambda r: r["doc_id"]):
        last[r["text"]] = r["doc_id"]
    assert sorted(r["doc_id"] for r in distinct) == sorted(last.values())

    assert sorted(r["doc_id"] for r in apart) == sorted(set(near_roots({r["doc_id"]: r["text"] for r in distinct}).values()))

    sizes = {r["source"]: r["size"] for r in source_sizes(inputs[3]).collect()}
    weights = {r["source"]: r["weight"] for r in tempered_weights(source_sizes(inputs[3])).collect()}
    rates = {s: weights[s] / sum(weights.values()) * sum(sizes.values()) / n for s, n in sizes.items()}
    wanted = Counter({r["doc_id"]: n for r in apart if (n := copies(r["doc_id"], rates[r["source"]]))})
    assert Counter(r["doc_id"] for r in mixed) == wanted

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    by_id = {r["doc_id"]: r["text"] for r in mixed}
    assert Counter(r["doc_id"] for r in encoded) == wanted
    assert all(r["ids"] == library.encode(by_id[r["doc_id"]] or "") for r in encoded)


def test_run_is_the_stages(spark, docs):
    rows = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "n_tokens", "ids"} <= set(rows.columns) and rows.count() > 0
