"""Toxicity by subword-bag embeddings in a linear softmax.

A word is the bag of its character n-grams (with word boundaries) and itself, hashed to buckets; the vectors of the bag are
averaged, vectors are averaged over a window of words, and a linear softmax scores the window. Vectors and softmax are trained
jointly in numpy, in one task, on a bounded sample of labelled documents, first with every window labelled like its document, then with the
window of the highest score standing for it. A document's score is that of its highest window, so long texts don't dilute a
passage, and an unseen misspelling shares the vectors of its n-grams.

Everything before the softmax is a mean, so a trained bucket is one number; the table of buckets has a fixed size and is
broadcast. Documents are scored where they are read.

Defined results: a null text counts as empty; a text without words scores like a window of unknown words (the intercept);
labels that are null are ignored, of several labels of a document the highest counts; without labels of both classes every
score is the share of toxic ones (0 without any); columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import SLICE_ROWS, slices, text_or_empty

#: Buckets (as a power of two), vector length, n-gram lengths, words of a window.
BITS, WIDTH, GRAMS, WINDOW = 18, 8, (3, 4, 5, 6), 5
#: The sample: toxic and other documents with labels, in an order by hash, and words, at most. Where the documents have more
#: words, the longest give a run of their words each, of the same length and at a place by hash, and the others all.
TOXIC_DOCS, OTHER_DOCS, TRAIN_WORDS = 2_000, 6_000, 6_000_000
#: Passes over the sample with window labels and with document labels; step size.
WINDOW_STEPS, DOCUMENT_STEPS, STEP = 25, 60, 0.08
#: Words that a worker remembers before it starts afresh.
CACHED = 300_000
THRESHOLD = 0.3
#: Words whose subwords are made at a time.
_WORDS_AT_ONCE = 1 << 16

_WORDS = re.compile(r"\w+(?:[@*$!#]\w+)*")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


@dataclass
class Bags:
    """The subwords of a list of words: for each n-gram length the buckets and the words they belong to."""

    buckets: list[np.ndarray]
    words: list[np.ndarray]
    sizes: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Bags:
        """The bags of all words, made part by part."""
        parts = [cls._of(words[at : at + _WORDS_AT_ONCE]) for at in range(0, max(len(words), 1), _WORDS_AT_ONCE)]
        if len(parts) == 1:
            return parts[0]
        starts = np.cumsum([0, *(len(p.sizes) for p in parts[:-1])])
        buckets = [np.concatenate([p.buckets[k] for p in parts]) for k in range(len(GRAMS) + 1)]
        owners = [np.concatenate([p.words[k] + np.int32(s) for p, s in zip(parts, starts)]) for k in range(len(GRAMS) + 1)]
        return cls(buckets, owners, np.concatenate([p.sizes for p in parts]))

    @classmethod
    def _of(cls, words: list[str]) -> Bags:
        marked = ["<" + w + ">" for w in words]
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([len(m) for m in marked], np.int64)
        stops = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        left = np.repeat(stops, lengths) - np.arange(len(codes))
        whole = np.array([zlib.crc32(w.encode()) for w in words], np.uint64) + np.uint64(1 << 40)
        buckets, owners = [_bucket(whole)], [np.arange(len(words), dtype=np.int32)]
        rolling = np.zeros(len(codes), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if n > len(codes):
                if n in GRAMS:
                    buckets.append(np.zeros(0, np.int32))
                    owners.append(np.zeros(0, np.int32))
                continue
            rolling = rolling[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                inside = left[: len(rolling)] >= n
                buckets.append(_bucket(rolling[inside]))
                owners.append(owner[: len(rolling)][inside])
        sizes = np.sum([np.bincount(o, minlength=len(words)) for o in owners], axis=0)
        return cls(buckets, owners, sizes)

    def mean(self, values: np.ndarray) -> np.ndarray:
        """The mean of a value by bucket over each word's bag."""
        total = np.zeros(len(self.sizes))
        for buckets, words in zip(self.buckets, self.words):
            total += np.bincount(words, weights=values[buckets], minlength=len(total))
        return total / self.sizes

    def spread(self, by_word: np.ndarray) -> np.ndarray:
        """The transpose of ``mean``: each word's value dealt to the buckets of its bag."""
        share = by_word / self.sizes
        total = np.zeros(1 << BITS)
        for buckets, words in zip(self.buckets, self.words):
            total += np.bincount(buckets, weights=share[words], minlength=len(total))
        return total


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)


def window_means(values: np.ndarray) -> np.ndarray:
    """Means over each run of ``WINDOW`` words; of all words where there are fewer."""
    if len(values) <= WINDOW:
        return values.mean(keepdims=True)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


class _Adam:
    """Moves a parameter in place, with step sizes by the running moments of its gradient."""

    def __init__(self, parameter: np.ndarray) -> None:
        self.parameter, self.n = parameter, 0
        self.first, self.second, self.spare = (np.zeros_like(parameter) for _ in range(3))

    def step(self, gradient: np.ndarray) -> None:
        self.n += 1
        np.square(gradient, out=self.spare)
        self.second *= 0.99
        self.second += np.multiply(self.spare, 0.01, out=self.spare)
        self.first *= 0.9
        self.first += np.multiply(gradient, 0.1, out=gradient)
        np.sqrt(self.second, out=self.spare)
        self.spare *= 1 / np.sqrt(1 - 0.99**self.n)
        self.spare += 1e-8
        np.divide(self.first, self.spare, out=self.spare)
        self.spare *= STEP / (1 - 0.9**self.n)
        self.parameter -= self.spare


@dataclass(frozen=True)
class ToxicityModel:
    """One number for each bucket and an intercept: the softmax margin of a window is the mean over its words' bags."""

    buckets: np.ndarray
    intercept: float

    @classmethod
    def fit(cls, sample: Iterable[tuple[list[str], int, float]], seed: int = 11) -> ToxicityModel:
        """Vectors and softmax weights trained together on (words, label, weight), which are read one by one."""
        vocabulary: dict[str, int] = {}
        docs, known, totals = [], [], [0.0, 0.0]
        for words, label, weight in sample:
            totals[label] += weight
            if words:
                docs.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
                known.append((label, weight))
        share = totals[1] / sum(totals) if sum(totals) else 0.0
        target, counts = np.array(known, np.float64).reshape(-1, 2).T
        if not 0 < target.sum() < len(target):
            return cls(np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
        n_vocabulary, bags = len(vocabulary), Bags.of(list(vocabulary))
        vocabulary.clear()
        n_windows = np.array([max(1, len(d) - WINDOW + 1) for d in docs])
        first = np.concatenate([[0], np.cumsum(n_windows)])
        width = np.minimum([len(d) for d in docs], WINDOW)
        flat = np.concatenate(docs)
        begins = np.concatenate([[0], np.cumsum([len(d) for d in docs])])[:-1]
        n_docs = len(docs)
        docs.clear()
        # the start of each window in the concatenated words
        at = np.concatenate([np.arange(b, b + n, dtype=np.int32) for b, n in zip(begins, n_windows)])
        owner = np.repeat(np.arange(n_docs, dtype=np.int32), n_windows)
        widths = width.astype(np.int32)[owner]
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
        weights = rng.normal(0, 0.5, (2, WIDTH)).astype(np.float32)
        bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
        steps = _Adam(vectors), _Adam(weights), _Adam(bias)
        gradient = np.empty_like(vectors)
        even = np.where(target == 1, 0.5 / target.sum(), 0.5 / (n_docs - target.sum()))
        for k in range(WINDOW_STEPS + DOCUMENT_STEPS):
            margin = weights[1] - weights[0]
            by_word = bags.mean(vectors @ margin)
            shown = _window_scores(by_word[flat], at, widths)
            if k < WINDOW_STEPS:
                doc, starts, wide, importance = owner, at, widths, (even / n_windows)[owner]
            else:
                chosen = _highest(shown, first)
                doc, starts, wide, shown, importance = owner[chosen], at[chosen], widths[chosen], shown[chosen], counts / counts.sum()
            error = 1 / (1 + np.exp(-(shown + bias[1] - bias[0])))
            error -= target[doc]
            error *= importance
            each = error / wide
            opened = np.bincount(starts, weights=each, minlength=len(flat) + 1)
            closed = np.bincount(starts + wide, weights=each, minlength=len(flat) + 1)
            by_place = np.cumsum(opened - closed)[:-1]
            by_vocabulary = np.bincount(flat, weights=by_place, minlength=n_vocabulary)
            dealt = bags.spread(by_vocabulary).astype(np.float32)
            slope = dealt @ vectors  # of the margin
            np.multiply(dealt[:, None] * np.float32(n_docs), margin, out=gradient)
            steps[0].step(gradient)
            steps[1].step(np.stack([-slope, slope]))
            steps[2].step(np.array([-error.sum(), error.sum()], np.float32))
        return cls((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]))


def _window_scores(by_place: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(by_place)])
    return (sums[at + width] - sums[at]) / width


def _highest(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The index of the highest score of each run (the first of equal ones)."""
    top = np.maximum.reduceat(scores, first[:-1])
    equal = np.flatnonzero(scores == np.repeat(top, np.diff(first)))
    return equal[np.searchsorted(equal, first[:-1])]


class Scorer:
    """Scores texts in a task, with a bounded memory of words."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.known = model, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHED:
            self.known.clear()
        split = [words_of(t) for t in texts]
        new = list({w for s in split for w in s if w not in self.known})
        if new:
            self.known.update(zip(new, Bags.of(new).mean(self.model.buckets).tolist()))
        margins = np.zeros(len(texts))
        for k, words in enumerate(split):
            if words:
                margins[k] = window_means(np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))).max()
        return 1 / (1 + np.exp(-(margins + self.model.intercept)))


def held_out() -> Column:
    """Rows that no training sees: CRC-32 of the doc_id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text, label and weight of at most ``TOXIC_DOCS`` toxic and ``OTHER_DOCS`` other documents outside the held-out part.

    The rare class is taken at a higher rate; a weight is the number of labelled documents that one of the sample stands for.
    """
    labelled = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {bool(r["toxic"]): r["n"] for r in labelled.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [
        labelled.filter((F.col("toxic") > 0) == toxic)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .select("doc_id", F.lit(int(toxic)).alias("toxic"), F.lit(max(1.0, totals.get(toxic, 0) / most)).alias("weight"))
        for toxic, most in ((True, TOXIC_DOCS), (False, OTHER_DOCS))
    ]
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    return rows.select("text", "toxic", "weight")


def _level(sizes: list[int], most: int) -> int:
    """The largest number of words of a document by which all together have at most ``most`` (1 at least)."""
    ordered = np.sort(np.array(sizes, np.int64))
    before = np.concatenate([[0], np.cumsum(ordered)])
    if before[-1] <= most:
        return int(ordered[-1]) if len(ordered) else 1
    left = np.arange(len(ordered), 0, -1)
    k = int(np.argmax(before[:-1] + ordered * left > most))  # the first document that is cut
    return max(1, int((most - before[k]) // left[k]))


class _Run:
    """A run of a document's words at a place by the text's hash; a shorter run is a part of every longer one."""

    def __init__(self, text: str, label: int, weight: float) -> None:
        self.words, self.label, self.weight = words_of(text), label, weight
        self.size, self.start, self.place = len(self.words), 0, zlib.crc32(text.encode())

    def cut(self, most: int) -> None:
        if len(self.words) > most:
            start = self.place * (self.size - most) >> 32
            self.words = self.words[start - self.start : start - self.start + most]
            self.start = start


def _words_and_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], int, float]]:
    """Every document of the sample, with all of its words or its share of ``TRAIN_WORDS``."""
    runs, held, most, same = [], 0, None, {}
    for piece in slices(batches):
        for text, label, weight in zip(*(piece.column(c).to_pylist() for c in ("text", "toxic", "weight"))):
            run = _Run(text, label, weight)
            run.cut(most or TRAIN_WORDS)
            run.words = [same.setdefault(w, w) for w in run.words]
            runs.append(run)
            held += len(run.words)
            if held > TRAIN_WORDS + TRAIN_WORDS // 4:
                most = _level([r.size for r in runs], TRAIN_WORDS)
                for r in runs:
                    r.cut(most)
                held = sum(len(r.words) for r in runs)
    most = _level([r.size for r in runs], TRAIN_WORDS)
    for run in runs:
        run.cut(most)
        yield run.words, run.label, run.weight


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = ToxicityModel.fit(_words_and_labels(batches))
    values = [pa.array([model.buckets.tobytes()], pa.binary()), pa.array([model.intercept], pa.float64())]
    yield pa.RecordBatch.from_arrays(values, ["buckets", "intercept"])


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the sample, trained in one task that reads no more than the sample; only the model goes to the driver."""
    row = training_sample(docs, labels).mapInArrow(_fit, "buckets binary, intercept double").first()
    if row is None:
        return ToxicityModel.fit([])
    return ToxicityModel(np.frombuffer(row["buckets"], np.float32), row["intercept"])


def toxicity(docs: DataFrame, model: ToxicityModel, column: str = "text") -> Column:
    """The score of each text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            parts = [scorer(batch.slice(k, SLICE_ROWS).to_pylist()) for k in range(0, len(batch), SLICE_ROWS)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score(text_or_empty(column))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, by a model of the labels outside the held-out part."""
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity(docs, train(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under the threshold, with all their columns."""
    return docs.filter(toxicity(docs, train(docs, labels)) < THRESHOLD)
