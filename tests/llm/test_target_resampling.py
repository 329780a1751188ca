import hashlib
import random
import re
from math import floor, log
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import target_resampling as tr


def runs(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, targets, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for texts, counts in ((docs, s), (targets, t)):
        for _, text in texts:
            for f in runs(text, longest)[1]:
                counts[crc32(f.encode()) % buckets] += 1
    gain = [floor(1000 * log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        words, features = runs(text, longest)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), len(features), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, row in enumerate(able[: len(able) * percent // 100]):
        row[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def check(spark, docs, targets, **options):
    frame = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id bigint, text string, score string, row_no int").repartition(4)
    goals = spark.createDataFrame(targets, "item_id bigint, text string")
    names = {"percent": "percent", "least": "least_words", "buckets": "buckets", "longest": "longest", "seed": "seed"}
    found = tr.resample(frame, goals, **{names[k]: v for k, v in options.items()}).collect()
    wanted = brute(docs, targets, **options)
    assert sorted(map(tuple, found), key=str) == wanted
    return found


def test_random_texts(spark):
    draw = random.Random(8)
    words = ["Alpha", "beta", "été", "x1", "日本", "gamma", "delta"] + [f"w{k}" for k in range(60)]
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.choice([0, 5, 19, 20, 21, 60])))
    docs = [(k, text()) for k in range(300)] + [(k, None) for k in (900, 901)]
    targets = [(k, "alpha beta w1 w2 " * 5) for k in range(3)] + [(9, None)]
    check(spark, docs, targets)
    check(spark, docs, targets, percent=37, least=5, buckets=50, longest=3, seed=1)
    check(spark, docs, targets, percent=100, least=0)


def test_ties_and_repeated_rows(spark):
    """Equal scores go by doc_id, and of repeated rows as many are drawn as there is room for."""
    docs = [(1, "same words here")] * 30 + [(None, "same words here")] * 4
    found = check(spark, docs, [(0, "words")], percent=50, least=1)
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 18))
    by_id = spark.range(400).select((F.col("id") % 100).alias("doc_id"), F.lit("a b").alias("text"))
    drawn = tr.resample(by_id, by_id, percent=13, least_words=0).filter("rank IS NOT NULL")
    assert drawn.count() == 52 and drawn.select("rank").distinct().count() == 52


@pytest.mark.parametrize("wanted", [1, 2, 17, 399, 400])
def test_the_cutoff_is_exact(spark, wanted):
    values = [random.Random(k).randint(-(2**62), 2**62) // 10 ** random.Random(-k).randint(0, 18) for k in range(400)]
    rows = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v bigint, k bigint")
    ordered = sorted(((v, -k) for k, v in enumerate(values)), reverse=True)
    chosen = rows.filter(tr.highest(rows, [F.col("v"), F.bitwise_not("k")], wanted)).collect()
    assert sorted(((r["v"], -r["k"]) for r in chosen), reverse=True) == ordered[:wanted]


def test_awkward_rows(spark, awkward, nothing):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    found = tr.resample(awkward, awkward, percent=60, least_words=2).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, docs, percent=60, least=2)
    assert tr.resample(nothing, awkward).count() == 0
    assert tr.resample(awkward, nothing).count() == len(docs)
