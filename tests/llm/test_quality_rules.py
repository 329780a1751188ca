import random
import re
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import quality_rules as rules


def base(text):
    """The counts of a text, plainly."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + d for i, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    symbols = sum(c in rules.SYMBOLS for c in text or "")
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def classes(text):
    counts = [0] * (len(rules.CLASSES) + 1)
    for c in text:
        counts[next((k for k, p in enumerate(rules.CLASSES) if re.match(p, c)), len(rules.CLASSES))] += 1
    return counts


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def divergence(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += ((a * log2(a / m) if a else 0) + (b * log2(b / m) if b else 0)) / 2
    return total


def references(docs):
    """By language: shares of classes; common words and the shares of others and of each of them."""
    found = {}
    for lang in {d[2] for d in docs}:
        texts = [d[1] or "" for d in docs if d[2] == lang]
        weights = Counter()
        for t in texts:
            for w, n in Counter(own := words_of(t)).items():
                weights[w] += n * (rules.UNIT // len(own))
        top = sorted(weights.items(), key=lambda x: (-x[1], x[0].encode()))[: rules.COMMON]
        total = sum(weights.values())
        shares = [(total - sum(n for _, n in top)) / total, *[n / total for _, n in top]] if total else None
        shape = [sum(n * c for n, c in zip(weights.values(), column)) for column in zip(*map(classes, weights))]
        found[lang] = ([s / sum(shape) for s in shape] if sum(shape) else None, [w for w, _ in top], shares)
    return found


def brute(docs):
    known = references(docs)
    for doc_id, text, lang in docs:
        counts, (shape, common, shares) = base(text), known[lang]
        far, word_far = None, None
        joined = "".join(own := words_of(text))
        if len(joined) >= rules.LEAST_CHARS:
            far = divergence([c / len(joined) for c in classes(joined)], shape)
        if len(own) >= rules.LEAST_COMPARED and shares:
            n = Counter()
            for w, times in Counter(own).items():
                n[common.index(w) + 1 if w in common else 0] += times
            word_far = divergence([n[k] / len(own) for k in range(len(shares))], shares)
        bad = (far or 0) > rules.MOST_CLASS_DIVERGENCE or (word_far or 0) > rules.MOST_WORD_DIVERGENCE
        yield (doc_id, *counts, not counts[-1] and not bad), far, word_far


def check(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, lang string, total int, word string")
    found = sorted(rules.judge(df).collect(), key=lambda r: (r[0] is not None, r[0]))
    wanted = sorted(brute(docs), key=lambda r: (r[0][0] is not None, r[0][0]))
    assert len(found) == len(wanted)
    for row, (counts, far, word_far) in zip(found, wanted):
        assert tuple(row)[:8] == counts
        assert (row["class_divergence"], row["word_divergence"]) == (
            far if far is None else pytest.approx(far, abs=1e-6),
            word_far if word_far is None else pytest.approx(word_far, abs=1e-6),
        )
    return found


def test_random_texts(spark):
    draw = random.Random(3)
    vocabulary = ["a", "of", "The", "the", "été", "n1", "x#y", "$$", "日本", "end."]
    docs = []
    for k in range(120):
        size = draw.choice([0, 1, 2, 3, 5, 49, 50, 120, 400])
        words = [draw.choice(vocabulary) if draw.random() < 0.6 else f"w{draw.randint(0, 300)}" for _ in range(size)]
        text = "".join(w + draw.choice([" ", " ", "\n", "\t ", "\n\n", "\r\n"]) for w in words)
        docs.append((k, text, draw.choice(["en", "fr", None])))
    rows = check(spark, docs)
    assert {r["base_failed"] for r in rows} == {True, False}


def test_windows_that_overlap(spark):
    """Windows that cross, repeat over themselves and at the edges."""
    texts = ["a a a a a", "a b a b a b", "a b c d a b c", "a b c a b c a b c", "a b c", "a b", "", None, "x " * 500, "a b c a b c"]
    check(spark, [(k, t, "en") for k, t in enumerate(texts)])


def test_divergent_texts_go(spark):
    draw = random.Random(5)
    common = "the of and to in is that it was for".split()
    plain = lambda n: " ".join(draw.choice(common) if draw.random() < 0.5 else f"word{chr(97 + draw.randint(0, 25))}x" + "y" * draw.randint(0, 4) for _ in range(n))
    docs = [(k, plain(200), "en") for k in range(60)]
    docs += [(100, " ".join("#%&$" * 3 + w for w in plain(200).split()), "en")]
    docs += [(101, " ".join(f"rare{draw.randint(0, 10**6)}" for _ in range(200)), "en")]
    found = {r["doc_id"]: r for r in check(spark, docs)}
    assert all(found[k]["kept"] for k in range(60))
    assert found[100]["class_divergence"] > rules.MOST_CLASS_DIVERGENCE and not found[100]["kept"]
    assert found[101]["word_divergence"] > rules.MOST_WORD_DIVERGENCE and not found[101]["kept"]


def test_awkward_rows(spark, awkward, nothing):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in awkward.collect()]
    found = rules.judge(awkward).collect()
    wanted = Counter(row[0] for row in brute(docs))
    assert Counter(tuple(r)[:8] for r in found) == wanted
    assert rules.judge(nothing).count() == 0


def test_best_words_are_picked_in_parts(spark, awkward):
    """No language's whole vocabulary goes through one task."""
    plan = rules.language_references(awkward)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_a_hash_that_two_windows_share_is_told_apart(spark, monkeypatch):
    """Windows are compared by their words, whatever their hashes."""
    monkeypatch.setattr(rules.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    check(spark, [(0, "a b c d e f a b c x y", "en"), (1, "p q r s t", "en")])
