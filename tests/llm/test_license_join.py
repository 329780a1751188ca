import random
import re

import pytest

from cohortloom.llm.license_join import PHRASES, TEMPLATES, Template, scan_licenses


def brute(text, templates=TEMPLATES, threshold=0.8):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    base = [
        (i, label)
        for phrase, label in PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    best, n_blocks, more = 0.0, 0, set()
    for t in templates:
        wanted, stride = set(t.words), len(t.words)
        for start in range(0, len(words), stride):
            share = len(wanted & set(words[start : start + 2 * stride])) / len(wanted)
            if share >= threshold:
                best, n_blocks, more = max(best, share), n_blocks + 1, more | {t.label}
    places, labels = [i for i, _ in base], {label for _, label in base}
    return (
        len(words),
        len(base),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | more)),
        pytest.approx(1.0 if base else best),
        n_blocks,
    )


def check(spark, texts, **options):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, rank string, block int")
    rows = scan_licenses(docs, **options).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for row in rows:
        assert tuple(row)[1:] == brute(texts[row["doc_id"]], **options), texts[row["doc_id"]]
    return rows


def test_random_texts(spark):
    draw = random.Random(4)
    known = [w for t in TEMPLATES for w in t.words]
    texts = []
    for _ in range(150):
        words = []
        while len(words) < draw.randint(0, 150):
            kind = draw.random()
            template = draw.choice(TEMPLATES).words
            if kind < 0.3:
                words += [w for w in template if draw.random() < 0.9]
            elif kind < 0.4:
                words += draw.choice(list(PHRASES)).split()[: draw.randint(2, 5)]
            else:
                words += draw.choices(["The", "of", "tion", "é", *draw.choices(known, k=3)], k=8)
        texts.append("".join(w.title() + draw.choice([" ", ", ", "\n", "-"]) for w in words))
    rows = check(spark, texts)
    assert len({r["labels"] for r in rows}) > 8


def test_awkward_texts(spark):
    long = "of the " * 60_000 + "under the MIT License"
    texts = [None, "", "!?", "under the mit license under the mit license", "CC BY-NC", "cc by ncé", "KK under the MIT\x00license", long]
    rows = {r["doc_id"]: r for r in check(spark, texts)}
    assert rows[3]["n_base"] == 2 and rows[3]["last_word"] == 4 and rows[7]["first_word"] == 120_000 and rows[5]["n_base"] == 0


def test_few_templates(spark):
    texts = ["one two three four five six", "two one five four three", "one two", "six"]
    check(spark, texts, templates=(Template("n", "one two three four five"), Template("m", "one one two")), threshold=0.6)
    check(spark, texts, templates=(), threshold=0.8)


def test_awkward_rows(spark, awkward, nothing):
    rows = scan_licenses(awkward).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in rows) == sorted((str(r["doc_id"]), brute(r["text"])[0]) for r in awkward.collect())
    assert scan_licenses(nothing).count() == 0


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.8, 1.0])
def test_exact_at_every_threshold(spark, threshold):
    """Templates of a hundred words, and texts that share just enough of them, just too few, and in any order."""
    draw = random.Random(11)
    words = [f"t{k}" for k in range(100)]
    templates = (Template("long", " ".join(words)), Template("half", " ".join(words[::2] + ["x"] * 3)), Template("one", "solo"))
    texts = ["solo", "", None, "t1 " * 300]
    for shared in (54, 55, 56, 69, 70, 71, 79, 80, 81, 99, 100):
        for _ in range(3):
            own = draw.sample(words, shared) + [f"o{k}" for k in range(draw.randint(0, 60))]
            draw.shuffle(own)
            texts.append(" ".join([f"p{k}" for k in range(draw.randint(0, 130))] + own))
    check(spark, texts, templates=templates, threshold=threshold)
