import random

import numpy as np

from cohortloom.llm import language_id
from cohortloom.llm.language_id import document_rows, identify, page_rows, train, training_sample, trigrams

SYLLABLES = {"aa": ["ka", "ro", "ti", "mu"], "bb": ["sch", "pf", "ung", "äh"], "cc": ["eau", "ois", "çon", "ré"]}


def invented(n, seed, least=10):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        lang = draw.choice(list(SYLLABLES))
        words = ["".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(draw.randint(least, 60))]
        rows.append((k, " ".join(words), lang, f"host-{lang}"))
    return rows


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_held_out_accuracy(spark):
    model = train(documents(spark, invented(400, 1)))
    assert model.languages == ["aa", "bb", "cc"]
    rows = invented(300, 2)
    found = identify(document_rows(documents(spark, rows)), model).toPandas().set_index("doc_id")
    assert np.mean([found.lang[k] == lang for k, _, lang, _ in rows]) > 0.99


def test_counts_by_hand(spark):
    rows = invented(60, 1)
    model = train(documents(spark, rows))
    counts = np.full((1 << 15, 3), 0.5)
    for _, text, lang, _ in rows:
        for bucket in trigrams(text):
            counts[bucket, model.languages.index(lang)] += 1
    assert np.allclose(model.table, np.log(counts / counts.sum(axis=0)), atol=1e-5)
    assert len(trigrams("ab")) == 0 and len(trigrams("abcd")) == 2


def test_host_decides_without_text(spark):
    model = train(documents(spark, invented(300, 1)))
    rows = invented(200, 3) + [(1000, None, None, "host-bb"), (1001, "", None, "host-cc"), (1002, "ka", None, "host-aa")]
    found = identify(document_rows(documents(spark, rows)), model).toPandas().set_index("doc_id")
    assert list(found.lang[[1000, 1001, 1002]]) == ["bb", "cc", "aa"]


def test_declaration_and_domain(spark):
    draw = random.Random(6)
    model = train(documents(spark, invented(300, 1)))
    pages = []
    for k, text, lang, _ in invented(200, 5):
        said = lang if draw.random() < 0.95 else draw.choice(list(SYLLABLES))
        pages.append((k, f"http://w{k}.{lang}site.example.org/x", f'<html lang="{said}"><style>schpfung</style><p>{text}</p></html>'))
    pages += [
        (900, "http://new.bbsite.example.org/", "<html><p></p></html>"),
        (901, "http://unknown.net/", "<html class=x lang='cc'><p>.</p>"),
        (902, None, None),
        (903, "not a url", '<html lang="zz">'),
    ]
    rows = page_rows(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    shown = {r["page_id"]: r for r in rows.collect()}
    assert "schpfung" not in shown[0]["text"] and shown[901]["declared"] == "cc" and shown[902]["declared"] is None
    found = identify(rows, model).toPandas().set_index("page_id")
    assert found.lang[900] == "bb" and found.lang[901] == "cc" and len(found) == 204
    assert found.confidence.between(1 / 3, 1.0000001).all()
    assert np.mean([found.lang[k] == lang for k, _, lang, _ in invented(200, 5)]) > 0.99


def test_awkward_rows(spark, awkward, nothing):
    model = train(documents(spark, invented(60, 1)))
    found = identify(document_rows(awkward), model)
    assert found.count() == 9 and found.filter("lang IS NULL").count() == 0
    assert identify(document_rows(nothing), model).count() == 0
    untrained = identify(document_rows(awkward), train(nothing)).collect()
    assert len(untrained) == 9 and all(r["lang"] is None and r["confidence"] == 0 for r in untrained)


def test_rare_languages_are_answers(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 40)
    rare = [(5000, "xoqu xiqua quoxa qixo " * 9, "dd", "rare"), (None, "bywy wyby ybyw wybwy " * 9, "ee", "rarer")]
    docs = documents(spark, invented(1500, 1) + rare)
    languages, sample = training_sample(docs)
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert languages == ["aa", "bb", "cc", "dd", "ee"] and sizes["dd"] == sizes["ee"] == 1
    assert all(10 < sizes[x] < 90 for x in SYLLABLES)
    model = train(docs)
    assert np.allclose(np.exp(model.table.astype(float)).sum(axis=0), 1, atol=1e-3)
    pages = [(1, "http://a.org/", "<html lang=dd>xiqua quoxa qixo xoqu xiqua"), (2, "http://b.org/", "<html lang=ee>"), (3, None, "wyby bywy ybyw wybwy")]
    found = identify(page_rows(spark.createDataFrame(pages, "page_id bigint, url string, html string")), model)
    assert {r["page_id"]: r["lang"] for r in found.collect()} == {1: "dd", 2: "ee", 3: "ee"}


def test_more_than_a_hundred_languages(spark):
    rows = [(k, f"{chr(0x4E00 + k) * 20} {chr(0x4E00 + k) * 20}", f"l{k:03}", f"host-{k}") for k in range(130)]
    model = train(documents(spark, rows))
    assert model.languages == [f"l{k:03}" for k in range(130)]
    found = identify(document_rows(documents(spark, rows)), model)
    assert {r["doc_id"]: r["lang"] for r in found.collect()} == {k: lang for k, _, lang, _ in rows}


def fused_by_hand(rows, model):
    """Language, confidence and language of the text of each row, with plain loops over all rows for each level."""
    n = len(model.languages)
    logs = [model.likelihoods(r["text"] or "") for r in rows]
    shown = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in logs]
    keys = [[tuple(r[c] or "" for c in language_id.LEVELS[: k + 1]) for k in range(3)] for r in rows]
    world = sum(shown)

    def smoothed(own, less, parent):
        rest = np.maximum(own - less, 0)
        return (rest + language_id.PARENT * parent) / (rest.sum() + language_id.PARENT)

    found = []
    for i, row in enumerate(rows):
        prior = smoothed(world + 1, shown[i], np.full(n, 1 / n))
        for k in range(3):
            prior = smoothed(sum(s for s, key in zip(shown, keys) if key[k] == keys[i][k]), shown[i], prior)
        evidence = logs[i] + np.log(prior)
        if row["declared"] in model.languages:
            said = sum(s for s, r in zip(shown, rows) if r["declared"] == row["declared"])
            belief = np.full(n, (1 - language_id.RIGHT) / (n - 1))
            belief[model.languages.index(row["declared"])] = language_id.RIGHT
            evidence = evidence + np.log((said + language_id.DECLARED * belief) / (world + language_id.DECLARED))
        posterior = np.exp(evidence - evidence.max()) / np.exp(evidence - evidence.max()).sum()
        found.append((model.languages[int(posterior.argmax())], posterior.max(), model.languages[int(shown[i].argmax())]))
    return found


def test_fusion_by_hand(spark):
    """Levels, smoothing, the row's own part, declarations and the posterior."""
    model = train(documents(spark, invented(200, 1)))
    draw, rows = np.random.default_rng(6), []
    for k, text, lang, _ in invented(150, 8):
        words = text.split()
        text = [" ".join(words[: draw.integers(0, 4)]), text, None][draw.integers(0, 3)]
        host = [None, "", *(f"h{j}.{lang}.org" for j in range(4))][draw.integers(0, 6)]
        declared = [None, lang, "aa", "zz"][draw.integers(0, 4)]
        rows.append({"id": k, "text": text, "declared": declared, "suffix": [None, "org", "net"][k % 3], "domain": f"d{k % 5}", "host": host})
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "id bigint, text string, declared string, suffix string, domain string, host string")
    found = {r["id"]: r for r in identify(frame.repartition(3), model).collect()}
    for row, (lang, confidence, text_lang) in zip(rows, fused_by_hand(rows, model)):
        got = found[row["id"]]
        assert np.isclose(got["confidence"], confidence, rtol=1e-6)
        assert got["text_lang"] == text_lang and (got["lang"] == lang or confidence < 0.51)


def test_a_hot_domain_is_split(spark):
    """No sum by level stands in the plan under the join with its hosts: both sides have a shuffle of their own."""
    model = train(documents(spark, invented(30, 1)))
    rows = documents(spark, invented(30, 2)).selectExpr("doc_id", "text", "null declared", "'o' suffix", "'d' domain", "cast(doc_id as string) host")
    plan = identify(rows.withColumn("declared", rows.declared.cast("string")), model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
