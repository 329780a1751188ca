"""Hashed features, exact splits, summaries of vectors, ROC curves, footers and accounted scans."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortloom.operators import features, models
from cohortloom.session import scratch_path
from cohortloom.sources import footer_counts, footer_extremes, ingest_entity


def sixty_bits(key):
    return int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16)


def test_hashed_vectors(spark):
    draw = random.Random(1)
    events = [(k % 7, draw.choice([None, "", "a b", "é", *map(str, range(40))])) for k in range(600)]
    found = features.hashed_vectors(spark.createDataFrame(events, "s int, code string"), "s", "code", 16)
    wanted = {s: np.zeros(16) for s, _ in events}
    for s, code in events:
        if code is not None:
            digits = hashlib.md5(code.encode()).hexdigest()
            wanted[s][int(digits[:15], 16) % 16] += 1 if int(digits[15], 16) % 2 == 0 else -1
    got = {r["s"]: r["v"] for r in found.select("s", vector_to_array("features").alias("v")).collect()}
    assert got == {s: list(v) for s, v in wanted.items()}
    shared = features.hash_collisions(spark.createDataFrame(events, "s int, code string"), "code", 16).collect()
    codes = {c for _, c in events if c is not None}
    at = Counter(sixty_bits(c) % 16 for c in codes)
    assert {r["position"]: r["n_codes"] for r in shared} == {p: n for p, n in at.items() if n > 1}


def split_by_hand(rows, share, labelled):
    labels = {}
    for key, label in rows:
        labels[key] = max(labels.get(key, ""), label or "") if labelled else ""
    train = set()
    for label in set(labels.values()):
        keys = sorted((k for k in labels if labels[k] == label), key=lambda k: (0 if k is None else sixty_bits(k), k is not None, k))
        train |= set(keys[: int(len(keys) * share)])
    return {k: "train" if k in train else "test" for k in labels}


@pytest.mark.parametrize("labelled", [True, False])
@pytest.mark.parametrize("share", [0.0, 0.1, 0.7, 1.0])
def test_exact_split(spark, labelled, share):
    draw = random.Random(3)
    rows = [(draw.choice([5, draw.randint(0, 300)]), draw.choice(["N", "N", "Y"])) for _ in range(900)] + [(None, "N")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "s int, label string, _key string")
    wanted = split_by_hand(rows, share, labelled)
    for parts in (1, 7):
        found = features.exact_split(df.repartition(parts), "s", share, "label" if labelled else None)
        assert {r["s"]: r["part"] for r in found.collect()} == wanted and found.count() == len(rows)
        assert found.columns == ["s", "label", "_key", "part"]


def test_equal_hashes_go_by_key(spark, monkeypatch):
    monkeypatch.setattr(features, "_hash_of", lambda c: (c % 2).cast("bigint"))
    found = features.exact_split(spark.range(20), "id", 0.7).where("part = 'train'").collect()
    assert sorted(r["id"] for r in found) == sorted([*range(0, 20, 2), 1, 3, 5, 7])


def test_vector_summary(spark):
    draw = np.random.default_rng(2)
    dense = draw.integers(0, 3, (50, 6)).astype(float)
    df = spark.createDataFrame([(Vectors.dense(v) if k % 2 else Vectors.sparse(6, enumerate(v)),) for k, v in enumerate(dense)], ["features"])
    found = sorted(features.vector_summary(df).collect())
    assert [r["position"] for r in found] == list(range(6))
    assert np.allclose([r["mean"] for r in found], dense.mean(axis=0)) and np.allclose([r["stddev"] for r in found], dense.std(axis=0, ddof=1))
    assert [r["n_nonzero"] for r in found] == list((dense != 0).sum(axis=0))


def test_vector_summary_of_many_positions(spark):
    """A hundred thousand positions, which no dense table could have as columns."""
    n = 100_000
    df = spark.createDataFrame([(Vectors.sparse(n, [k, n - 1], [2.0, 1.0]),) for k in range(10)], ["features"])
    found = features.vector_summary(df)
    assert found.count() == n and found.where(f"position = {n - 1}").first()["mean"] == pytest.approx(1.0)


def test_roc_curve_and_area(spark):
    draw = random.Random(5)
    rows = [(float(draw.randint(0, 40)), float(draw.random() < 0.3)) for _ in range(700)] + [(None, 1.0), (3.0, None)]
    scored = spark.createDataFrame(rows, "probability double, LABEL double").repartition(5)
    known = [(s, y) for s, y in rows if s is not None and y is not None]
    n_pos = sum(y for _, y in known)
    wanted = [
        (t, sum(y for s, y in known if s >= t) / n_pos, sum(1 - y for s, y in known if s >= t) / (len(known) - n_pos))
        for t in sorted({s for s, _ in known}, reverse=True)
    ]
    found = models.roc_curve(scored).orderBy(F.desc("threshold")).collect()
    assert np.allclose([tuple(r) for r in found], wanted)
    area = models.roc_area(scored).first()[0]
    assert area == pytest.approx(models.area_under_roc(scored.dropna(), by="probability"))
    assert models.roc_area(scored.where("LABEL = 1")).first()[0] is None and models.roc_curve(scored.where("LABEL > 1")).count() == 0


def test_no_task_sees_all_scores(spark):
    scored = spark.range(1000).select((F.col("id") % 2).cast("double").alias("LABEL"), F.col("id").cast("double").alias("probability"))
    plan = models.roc_curve(scored)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "windowspecdefinition(_range" in plan


def test_footers_answer_counts_and_extremes(spark):
    path = scratch_path(spark, "numbers")
    spark.range(1000).select("id", (F.col("id") / 4).alias("a.b"), F.nullif(F.col("id") % 3, F.lit(0)).alias("r")).write.parquet(path)
    counted = footer_counts(spark, {"numbers": path, "again": path})
    assert {tuple(r) for r in counted.collect()} == {("numbers", 1000), ("again", 1000)}
    extremes = footer_extremes(spark, path, ["id", "a.b", "r"])
    assert {tuple(r) for r in extremes.collect()} == {("id", 1000, 0.0, 999.0), ("a.b", 1000, 0.0, 249.75), ("r", 666, 1.0, 2.0)}
    for df in (counted, extremes):
        assert "PushedAggregation: [COUNT" in df._jdf.queryExecution().executedPlan().toString()


def test_scan_with_an_account(spark, tmp_path):
    lines = {
        "one.csv": ["1,10,100,5,2101-01-01 10:00:00,v,1.5,mg,", "2,10,100,5,sometime,v,x1,mg,abnormal", "bad,11,100,5,,v,,mg,delta"],
        "two.csv": ["4,12,,6,2101-02-30 10:00:00,v,-3,mg,"],
    }
    for name, rows in lines.items():
        header = "ROW_ID,SUBJECT_ID,HADM_ID,ITEMID,CHARTTIME,VALUE,VALUENUM,VALUEUOM,FLAG"
        (tmp_path / name).write_text("\n".join([header, *rows]) + "\n")
    rows, account, totals = ingest_entity(spark, "lab_events", str(tmp_path), scratch_path(spark, "labs"))
    found = {(r["source_file"].rsplit("/", 1)[1], r["column_name"], r["n_rejected"]) for r in account.collect()}
    assert found == {("one.csv", "CHARTTIME", 1), ("one.csv", "VALUENUM", 1), ("one.csv", "ROW_ID", 1), ("two.csv", "CHARTTIME", 1)}
    assert totals == {"n_rows": 4, "n_rejected_rows": 3, "ROW_ID": 1, "CHARTTIME": 2, "VALUENUM": 1}
    typed = {r["SUBJECT_ID"]: r for r in rows.where("SUBJECT_ID <> '10'").collect()}
    assert typed["12"]["VALUENUM"] == -3.0 and typed["12"]["CHARTTIME"] is None and typed["11"]["rejected"] == ["ROW_ID"]


def test_a_split_never_sorts_its_subjects(spark):
    """What is ordered in a window is a histogram, or keys of one hash."""
    keys = spark.range(5000).select(F.lit("all").alias("_label"), features._hash_of(F.col("id")).alias("_hash"))
    bound = features.split_thresholds(keys, 0.7).first()
    assert bound["n_train"] == 3500 and keys.where(F.col("_hash") <= bound["_bound"]).count() == 3500
