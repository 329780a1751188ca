import bisect
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import counts, features, models
from cohortloom.plans import mortality
from cohortloom.functions import RISK_MARKERS


@pytest.fixture(scope="module")
def points(spark):
    """200 rows in two separate groups; the label follows the group but for every tenth row."""
    group = F.col("id") % 2
    return spark.range(0, 200, 1, 4).select(
        "id",
        (group * 10 + (F.col("id") % 7) / 7.0).alias("a"),
        (group * -5 + (F.col("id") % 5) / 5.0).alias("b"),
        F.when(F.col("id") % 10 == 0, 1 - group).otherwise(group).cast("double").alias("LABEL"),
    )


@pytest.fixture(scope="module")
def vectors(points):
    return features.scale(features.assemble(points, ["id"])).cache()


def test_clusters_are_the_groups(vectors):
    model = models.fit_kmeans(vectors, 2)
    got = {(r["id"] % 2, r["prediction"]) for r in model.transform(vectors).collect()}
    assert len(got) == 2 and {g for g, _ in got} == {0, 1}


def test_cost_on_the_training_rows_is_the_training_cost(vectors):
    model = models.fit_kmeans(vectors, 3)
    cost = models.kmeans_cost(model, vectors).first()["cost"]
    assert cost == pytest.approx(model.summary.trainingCost)
    by_hand = sum(
        min(sum((x - y) ** 2 for x, y in zip(r[0].toArray(), c)) for c in model.clusterCenters())
        for r in vectors.select("scaledFeatures").collect()
    )
    assert cost == pytest.approx(by_hand)


def test_sweep_fits_every_k(vectors):
    costs = models.k_sweep(vectors, range(2, 5))
    assert [k for k, _ in costs] == [2, 3, 4]
    for k, cost in costs:
        assert cost == pytest.approx(models.fit_kmeans(vectors, k).summary.trainingCost)


def test_area_under_roc_by_pairs(vectors):
    train, test = features.hash_split(vectors, "id")
    scored = models.fit_logistic(train, features="scaledFeatures").transform(test)
    rows = [(r["LABEL"], r["probability"][1], r["prediction"]) for r in scored.collect()]

    def area(column):
        positive = [r[column] for r in rows if r[0] == 1.0]
        negative = [r[column] for r in rows if r[0] == 0.0]
        won = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
        return won / len(positive) / len(negative)

    assert models.area_under_roc(scored) == pytest.approx(area(1), abs=1e-6)
    assert models.area_under_roc(scored, by="prediction") == pytest.approx(area(2), abs=1e-6)


def test_score_and_training_summary(vectors):
    model = models.fit_logistic(vectors, features="scaledFeatures")
    scored = models.score(model, vectors, ["id", "LABEL"])
    assert scored.columns == ["id", "LABEL", "prediction", "probability"] and scored.count() == 200
    for r in scored.collect():
        assert r["prediction"] == float(r["probability"] > 0.5)
    summary = counts.describe_columns(models.training_predictions(model), ["LABEL", "prediction"]).collect()
    assert [(r["column_name"], r["n"]) for r in summary] == [("LABEL", 200), ("prediction", 200)]


def test_stages_equal_the_steps(points, vectors):
    stages = [features.assembler(["a", "b"]), features.scaler(), models.kmeans(2)]
    chained = models.fit_stages(points, stages).transform(points)
    stepwise = models.fit_kmeans(vectors, 2).transform(vectors)
    together = {(r["id"] % 2, r["prediction"]) for r in chained.collect()}
    assert together == {(r["id"] % 2, r["prediction"]) for r in stepwise.collect()}


def test_training_rows_from_the_hospital_files(hospital):
    rows = mortality.hospital_training_rows(
        *[hospital[t] for t in ("patients", "admissions", "lab_events", "diagnoses", "diagnosis_lookup")]
    )
    got = {r["HADM_ID"]: r.asDict() for r in rows.collect()}
    # h5 has no listed diagnosis text, p9 is no known patient
    assert sorted(got) == ["h1", "h2", "h3", "h4"]
    assert [got["h1"][f"lab:{c}"] for c in ("50813", "51221", "50912", "50816")] == [2, 1, 1, 0]
    assert [got["h1"][f"icd:{c}"] for c in ("99591", "99592", "99590")] == [1, 1, 0]
    assert got["h4"]["lab:50912"] == 2 and got["h4"]["icd:99591"] == 0
    # every stay of a subject carries the counts of all of them
    assert {got[h]["GENDER_F"] for h in ("h1", "h2", "h3")} == {3}
    assert {got[h]["ADMISSION_TYPE_EMERGENCY"] for h in ("h1", "h2", "h3")} == {2}
    assert got["h2"]["DIAGNOSIS_SEPSIS"] == 1 and got["h4"]["DIAGNOSIS_PULMONARY EDEMA\\CATH"] == 1
    assert [got[h]["LABEL"] for h in ("h1", "h2", "h3", "h4")] == [1.0, 1.0, 1.0, 0.0]
    assert [got[h]["LOS"] for h in ("h1", "h2", "h3", "h4")] == [9, 0, 12, 4]


def test_hospital_features_hold_no_label(hospital):
    rows = mortality.hospital_training_rows(
        *[hospital[t] for t in ("patients", "admissions", "lab_events", "diagnoses", "diagnosis_lookup")]
    )
    chosen = features.feature_columns(rows, mortality.DESCRIPTIVE)
    assert not {"LABEL", "TARGET", "SUBJECT_ID", "HADM_ID"} & set(chosen)
    assert {"AGE", "LOS"} <= set(chosen) and "AGE_AT_DEATH" not in chosen and sum(c.startswith("lab:") for c in chosen) == len(RISK_MARKERS)
    vectors = features.assemble(rows, mortality.DESCRIPTIVE, fill=0.0)
    assert vectors.first()["features"].size == len(chosen)


def test_logistic_fit_is_the_optimum(vectors):
    """At the maximum of the likelihood, the residuals are orthogonal to the features and sum to zero."""
    model = models.fit_logistic(vectors, features="scaledFeatures")
    scored = model.transform(vectors).select("LABEL", "probability", "scaledFeatures").collect()
    residuals = [r["LABEL"] - r["probability"][1] for r in scored]
    assert sum(residuals) == pytest.approx(0.0, abs=1e-3)
    for i in range(2):
        assert sum(e * r["scaledFeatures"][i] for e, r in zip(residuals, scored)) == pytest.approx(0.0, abs=1e-2)


def test_no_feature_follows_from_the_death(hospital):
    """Other death dates change the label, never a feature."""
    tables = [hospital[t] for t in ("patients", "admissions", "lab_events", "diagnoses", "diagnosis_lookup")]
    later = tables[0].withColumns({c: F.lit("2160-01-01 00:00:00").cast(tables[0].schema[c].dataType) for c in ("DOD", "DOD_HOSP")})

    def features_of(patients):
        rows = mortality.hospital_training_vectors(patients, *tables[1:]).collect()
        return {r["HADM_ID"]: r["features"] for r in rows}, {r["LABEL"] for r in rows}

    (first, labels), (second, changed) = features_of(tables[0]), features_of(later)
    assert first == second and labels == {0.0, 1.0} and changed == {1.0}
    dense = mortality.hospital_training_rows(later, *tables[1:])
    chosen = features.feature_columns(dense, mortality.DESCRIPTIVE)
    both = [sorted(tuple(r) for r in mortality.hospital_training_rows(p, *tables[1:]).select("HADM_ID", *[f"`{c}`" for c in chosen]).collect()) for p in (tables[0], later)]
    assert both[0] == both[1]


def test_sparse_vectors_are_the_dense_rows(hospital):
    tables = [hospital[t] for t in ("patients", "admissions", "lab_events", "diagnoses", "diagnosis_lookup")]
    dense = {r["HADM_ID"]: r.asDict() for r in mortality.hospital_training_rows(*tables).collect()}
    sparse = {r["HADM_ID"]: r for r in mortality.hospital_training_vectors(*tables).collect()}
    assert sorted(sparse) == sorted(dense)
    for stay, row in dense.items():
        cells = [v for k, v in row.items() if k.startswith(("lab:", "icd:", "GENDER_", "ADMISSION_TYPE_", "INSURANCE_", "DIAGNOSIS_"))]
        assert sorted(v for v in cells if v) == sorted(v for v in sparse[stay]["features"].toArray()[:-2] if v)
        assert list(sparse[stay]["features"].toArray()[-2:]) == [row["LOS"], row["AGE"]] and sparse[stay]["LABEL"] == row["LABEL"]
    # every stay with codes counts, and every text is a feature, without a list of texts
    everything = mortality.hospital_training_vectors(*tables, allowed=None)
    assert everything.count() >= len(dense)


def test_more_codes_than_columns(spark):
    """12,000 codes: one sparse vector per subject, and a model on them."""
    n = 12_000
    ids = spark.range(0, 400)
    patients = ids.select(F.col("id").alias("SUBJECT_ID"), F.lit("x").alias("GENDER"))
    target = F.when(F.col("id") % 2 == 0, "Y").otherwise("N").alias("TARGET")
    admissions = ids.select(F.col("id").alias("SUBJECT_ID"), (F.col("id") + 1000).alias("HADM_ID"), F.lit("t").alias("KIND"), target)
    codes = spark.range(0, n).select((F.col("id") % 400).alias("SUBJECT_ID"), F.col("id").cast("string").alias("XCODE"))
    rows = mortality.training_vectors(patients, admissions, codes, ["GENDER"], ["KIND"])
    first = rows.where("SUBJECT_ID = 7").first()["features"]
    assert first.size == n + 2 and first.numNonzeros() == n // 400 + 2
    assert models.fit_logistic(rows.select("LABEL", "features")).numFeatures == n + 2


def test_cost_of_wide_vectors(spark):
    """5,000 columns, new rows, rows of zeros and a centre of zeros."""
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.sparse(5000, [k, k + 7], [1.0 + k % 3, 2.0]),) for k in range(60)] + [(Vectors.sparse(5000, [], []),)] * 3
    df = spark.createDataFrame(rows, ["scaledFeatures"])
    model = models.fit_kmeans(df, 3)
    assert models.kmeans_cost(model, df).first()["cost"] == pytest.approx(model.summary.trainingCost)
    other = df.limit(20)
    by_hand = sum(min(c @ c - 2 * r[0].dot(c) + r[0].dot(r[0]) for c in model.clusterCenters()) for r in other.collect())
    assert models.kmeans_cost(model, other).first()["cost"] == pytest.approx(by_hand)
    nothing = spark.createDataFrame([(Vectors.sparse(3, [], []),)] * 4, ["scaledFeatures"])
    assert models.kmeans_cost(models.fit_kmeans(nothing, 2), nothing).first()["cost"] == 0


def test_area_with_many_scores_and_ties(spark):
    draw = random.Random(2)
    rows = [(round(draw.random() + 0.2 * (k % 2), 3 if k % 3 else 1), float(k % 2)) for k in range(6000)]
    area = models.area_under_roc(spark.createDataFrame(rows, "s double, LABEL double"), by="s")
    positive, negative = (sorted(s for s, y in rows if y == label) for label in (1.0, 0.0))
    won = sum(bisect.bisect_left(negative, s) + bisect.bisect_right(negative, s) for s in positive) / 2
    assert len({s for s, _ in rows}) > 1000
    assert area == pytest.approx(won / len(positive) / len(negative), abs=1e-12)
