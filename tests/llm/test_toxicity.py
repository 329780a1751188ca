import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import toxicity
from cohortloom.llm.toxicity import Bags, Scorer, ToxicityModel, drop_toxic, held_out, score_toxicity, words_of


def invented(n, seed, bad=("disgusting", "pathetic", "worthless"), spoilt=False):
    """Documents of invented words; a third holds one or two bad ones, misspelt if wanted."""
    draw = random.Random(seed)
    syllables = ["ta", "no", "re", "li", "mo", "st", "wo", "en", "up", "id"]
    rows = []
    for k in range(n):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(5, 150))]
        label = int(k % 3 == 0)
        for _ in range(label * draw.randint(1, 2)):
            word = draw.choice(bad)
            if spoilt:
                at = draw.randrange(1, len(word))
                word = word[:at] + word[at - 1] + word[at:]
            words.insert(draw.randrange(len(words)), word)
        rows.append((k, " ".join(words), label))
    return rows


def test_unseen_misspellings_are_found():
    model = ToxicityModel.fit((words_of(t), y, 1.0) for _, t, y in invented(900, 1))
    for spoilt in (False, True):
        rows = invented(600, 2, spoilt=spoilt)
        scores = Scorer(model)([t for _, t, _ in rows])
        labels = np.array([y for _, _, y in rows])
        caught = (scores >= toxicity.THRESHOLD)[labels == 1].mean()
        blamed = (scores >= toxicity.THRESHOLD)[labels == 0].mean()
        assert caught > (0.8 if spoilt else 0.95) and blamed < 0.05, (spoilt, caught, blamed)


def test_score_is_that_of_the_highest_window():
    model = ToxicityModel.fit((words_of(t), y, 1.0) for _, t, y in invented(300, 1))
    scorer = Scorer(model)
    text = invented(1, 9)[0][1]
    words = words_of(text)
    by_word = [float(Bags.of([w]).mean(model.buckets)[0]) for w in words]
    best = max(np.mean(by_word[k : k + toxicity.WINDOW]) for k in range(len(words) - toxicity.WINDOW + 1))
    assert np.isclose(scorer([text])[0], 1 / (1 + np.exp(-(best + model.intercept))))
    assert np.isclose(scorer([""])[0], 1 / (1 + np.exp(-model.intercept)))


def test_bags_hold_the_grams():
    bags = Bags.of(["ab", "ab", "abcdef", "é"])
    assert bags.sizes.tolist() == [1 + 2 + 1, 4, 1 + 6 + 5 + 4 + 3, 1 + 1]
    values = np.arange(1 << toxicity.BITS, dtype=float)
    means = bags.mean(values)
    assert means[0] == means[1] != means[2]
    assert np.isclose(bags.spread(np.ones(4)).sum(), 4)


def test_without_both_classes():
    for labels, score in (([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)):
        model = ToxicityModel.fit((["some", "words"], y, 1.0) for y in labels)
        assert np.allclose(Scorer(model)(["any text", ""]), score, atol=1e-5)


def test_documents(spark, awkward, nothing):
    rows = invented(600, 4)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = [(k, y) for k, _, y in rows] + [(5, None), (0, 0)]
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scored = score_toxicity(docs, labels).toPandas().set_index("doc_id")
    assert scored.index.is_unique and scored.score.between(0, 1).all()
    assert (scored.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in scored.index]).all()
    assert (scored.predicted == (scored.score >= toxicity.THRESHOLD)).all()
    unseen = scored[scored.held_out]
    truth = np.array([rows[k][2] for k in unseen.index])
    assert (unseen.predicted == truth).mean() > 0.9
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(scored.index[scored.predicted == 0])
    assert score_toxicity(awkward, labels).count() == awkward.count()
    assert score_toxicity(nothing, labels).count() == 0 and drop_toxic(nothing, labels).count() == 0


def test_held_out_labels_are_not_read(spark):
    rows = invented(300, 4)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(map(tuple, score_toxicity(docs, x).select("doc_id", "predicted").collect())) for x in (labels, turned))
    assert first == second


def test_a_long_document_leaves_words_to_the_others(monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 3000)
    rows = [(-1, " ".join(f"long{k}" for k in range(50_000)), 0)] + invented(60, 1)
    for order in (rows, rows[::-1]):
        columns = [pa.array([r[1] for r in order]), pa.array([r[2] for r in order]), pa.array([1.0] * len(order))]
        batch = pa.RecordBatch.from_arrays(columns, ["text", "toxic", "weight"])
        kept = list(toxicity._words_and_labels(iter([batch])))
        assert [label for _, label, _ in kept] == [r[2] for r in order] and {label for _, label, _ in kept} == {0, 1}
        sizes, most = [len(words) for words, _, _ in kept], max(len(words) for words, _, _ in kept)
        assert sum(sizes) <= 3000 < sum(min(len(words_of(r[1])), most + 1) for r in order)
        assert sizes == [min(len(words_of(r[1])), most) for r in order]
        assert all(" ".join(words) in r[1] for (words, _, _), r in zip(kept, order))
        found = {r[0]: words for (words, _, _), r in zip(kept, order)}
        assert order is rows or found == first
        first = found
    assert toxicity._level([], 5) == 1 and toxicity._level([3, 9], 12) == 9 and toxicity._level([9, 3, 9], 12) == 4


@pytest.mark.parametrize("steps", [(1, 0), (0, 1)])
def test_the_gradient_is_that_of_the_loss(monkeypatch, steps):
    """Vectors, softmax weights and bias move by the slopes of the weighted loss, over all windows and over the highest ones."""
    seen = []
    monkeypatch.setattr(toxicity, "WINDOW_STEPS", steps[0])
    monkeypatch.setattr(toxicity, "DOCUMENT_STEPS", steps[1])
    monkeypatch.setattr(toxicity._Adam, "step", lambda self, gradient: seen.append((self.parameter.astype(float), gradient.astype(float))))
    sample = [(words_of(t)[:20] if k else ["one", "two"], y, 1.0 + k % 3) for k, (_, t, y) in enumerate(invented(12, 4))]
    ToxicityModel.fit(sample)
    (vectors, by_vector), (weights, by_weight), (bias, by_bias) = seen
    bags = {w: np.flatnonzero(Bags.of([w]).spread(np.ones(1))) for s, _, _ in sample for w in s}
    shares = {w: Bags.of([w]).spread(np.ones(1))[at] for w, at in bags.items()}
    n = [sum(y == label for _, y, _ in sample) for label in (0, 1)]

    def loss(vectors, weights, bias):
        total = 0.0
        for words, label, weight in sample:
            by_word = [shares[w] @ (vectors[bags[w]] @ (weights[1] - weights[0])) for w in words]
            width = min(len(words), toxicity.WINDOW)
            scores = [np.mean(by_word[k : k + width]) for k in range(len(words) - width + 1)]
            scores, importance = (scores, 0.5 / n[label] / len(scores)) if steps[0] else ([max(scores)], weight / sum(s[2] for s in sample))
            for s in scores:
                chance = 1 / (1 + np.exp(-(s + bias[1] - bias[0])))
                total -= importance * np.log(chance if label else 1 - chance)
        return total

    def slope(parameter, at, step=1e-5):
        sides = []
        for sign in (1, -1):
            moved = [p.copy() for p in (vectors, weights, bias)]
            moved[parameter][at] += sign * step
            sides.append(loss(*moved))
        return (sides[0] - sides[1]) / (2 * step)

    for place in np.argsort(-np.abs(by_vector[:, 0]))[:4]:
        assert np.isclose(slope(0, (place, 0)), by_vector[place, 0] / len(sample), rtol=1e-3, atol=1e-7)
    for place in ((0, 0), (1, 0), (1, weights.shape[1] - 1)):
        assert np.isclose(slope(1, place), by_weight[place], rtol=1e-3, atol=1e-6)
    for place in (0, 1):
        assert np.isclose(slope(2, place), by_bias[place], rtol=1e-3, atol=1e-6)


def test_bags_by_parts_as_the_whole(monkeypatch):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcé", k=draw.randint(1, 9))) for _ in range(203)] + ["", "a"]
    whole = Bags.of(words)
    monkeypatch.setattr(toxicity, "_WORDS_AT_ONCE", 17)
    parts = Bags.of(words)
    for a, b in zip([*whole.buckets, *whole.words, whole.sizes], [*parts.buckets, *parts.words, parts.sizes]):
        assert np.array_equal(a, b)
