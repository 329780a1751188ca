import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import piecewise_hash
from cohortloom.llm.piecewise_hash import compare_with_next, fingerprint, likeness


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_likeness(a, b):
    def alike(x, y):
        return 1 - edit_distance(x, y) / max(len(x), len(y)) if x or y else 0.0

    (m, *x), (n, *y) = ((int(p[0]), p[1], p[2]) for p in (a.split(":"), b.split(":")))
    if a == b:
        return 1.0
    if m == n:
        return max(alike(x[0], y[0]), alike(x[1], y[1]))
    return alike(x[0], y[1]) if m == 2 * n else alike(x[1], y[0]) if n == 2 * m else 0.0


def brute_fingerprint(text):
    """The same signature byte by byte."""
    raw, mask = text.encode(), (1 << 64) - 1
    if not raw:
        return "3::"

    def mark(i):
        total = sum(raw[i - k] * (8 - k if k else 8) for k in range(min(7, i + 1)))
        shifted = 0
        for k in range(min(7, i + 1)):
            shifted ^= raw[i - k] << 5 * k & 0xFFFFFFFF
        return (total + shifted) & 0xFFFFFFFF

    marks = [mark(i) for i in range(len(raw))]
    base = 0x9E3779B97F4A7C15 | 1

    def signature(size):
        out, start = "", 0
        ends = [i + 1 for i, m in enumerate(marks) if m % size == size - 1][:63]
        for end in ends if ends and ends[-1] == len(raw) else [*ends, len(raw)]:
            chunk = sum((raw[i] + 1) * pow(base, i - start, 1 << 64) for i in range(start, end)) & mask
            out += chr(piecewise_hash.LETTERS[(chunk * 0xD6E8FEB86659FD93 & mask) >> 58])
            start = end
        return out

    block = 3
    while block * 64 < len(raw):
        block *= 2
    while block > 3 and sum(m % block == block - 1 for m in marks) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def texts(n, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghé日 \n", k=draw.randint(1, 9))) for _ in range(300)]
    return [" ".join(draw.choices(words, k=draw.choice([0, 1, 3, 20, 200]))) for _ in range(n)]


def test_fingerprint_by_hand():
    for text in [*texts(60, 1), "a", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40]:
        assert fingerprint(text) == brute_fingerprint(text)


def test_a_change_stays_local():
    text = texts(1, 7)[0] + " ".join(texts(40, 5))
    changed = text[:2000] + "something else" + text[2010:]
    assert brute_likeness(fingerprint(text), fingerprint(changed)) > 0.8


@pytest.mark.parametrize("parts", [1, 3])
def test_documents_against_one_pass(spark, parts, monkeypatch):
    own = texts(80, 2)
    rows = [(k * 7 % 80, t if k % 9 else None) for k, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(parts)
    found = {r["doc_id"]: r for r in compare_with_next(docs).collect()}
    ordered = sorted(((k, t or "") for k, t in rows), reverse=True)
    for (doc_id, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]]):
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        row = found.pop(doc_id)
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        marks = [fingerprint(t) for t in (text, changed, following)]
        assert [row["fingerprint"], row["edited_fingerprint"]] == marks[:2]
        assert row["near_edited"] == pytest.approx(brute_likeness(marks[0], marks[1]))
        assert row["near_next"] == pytest.approx(brute_likeness(marks[0], marks[2]))
    assert not found


def test_compatible_block_sizes(spark):
    pairs = [("3:abcd:ab", "6:abxx:zz"), ("6:abxx:zz", "3:abcd:ab"), ("3:a:b", "12:a:b"), ("3::", "3::"), ("3:abc:", "3:abd:")]
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", likeness("a", "b").alias("x"))
    for row in frame.collect():
        assert row["x"] == pytest.approx(brute_likeness(row["a"], row["b"]))


def test_awkward_rows(spark, awkward, nothing):
    rows = compare_with_next(awkward).collect()
    assert len(rows) == 9
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and sum(r["fingerprint"] == "3::" for r in rows) == 2
    one = spark.createDataFrame([(1, "only one text")], "doc_id bigint, text string")
    row = compare_with_next(one).first()
    assert row["near_next"] == 1.0
    assert compare_with_next(nothing).count() == 0
    assert compare_with_next(awkward.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == 9


def test_parts_as_the_whole(monkeypatch):
    """A long text, hashed part by part, has the fingerprint that it has in one piece."""
    draw = random.Random(9)
    texts = ["".join(draw.choice("abcdefgh é\n") for _ in range(draw.randint(900, 9000))) for _ in range(40)]
    texts += ["a" * 5000, "ab" * 3000, "x" * 1000 + "".join(draw.choice("abc") for _ in range(3000))]
    whole = [fingerprint(t) for t in texts]
    monkeypatch.setattr(piecewise_hash, "_PART", 128)
    assert [fingerprint(t) for t in texts] == whole


def test_memory_of_a_very_long_text():
    """Memory follows the part, not the text."""
    import tracemalloc

    text = "some words of a long text " * 1_000_000
    tracemalloc.start()
    fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(text) + (64 << 20)
