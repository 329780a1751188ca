"""Every registered query against its SQL twin."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as driver
from cohortloom.operators import features
from cohortloom.plans import queries
from tests.sql_check import compare, connect

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    with connect(SF_DIR) as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    ours = driver.queries()[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(driver.oracle_sql()[name]).df()
    assert compare(ours, theirs) is None


def test_every_twin_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["SUBJECT_ID", "HADM_ID", "ADMISSION_TYPE", "DIAGNOSIS", "click", "error", "purchase", "refund"]
    assert result.count() > 0


SMALL = "/root/testdata/sf0.001"


def test_models_cover_their_rows(spark):
    """Queries without a SQL twin: which rows they return, and in what shape."""
    ours = driver.queries()
    subjects = ours["count_by_key"](spark, SMALL).count()
    for name in ("kmeans_assign", "stages_fit"):
        clusters = ours[name](spark, SMALL).toPandas()
        assert len(clusters) == subjects and set(clusters["cluster"]) <= {0, 1, 2}
    costs = dict(tuple(r) for r in ours["kmeans_cost"](spark, SMALL).collect())
    swept = dict(tuple(r) for r in ours["kmeans_k_sweep"](spark, SMALL).collect())
    assert sorted(swept) == list(range(2, 9)) and swept[8] < swept[2]
    assert all(costs[k] == pytest.approx(swept[k], abs=1e-5) for k in (2, 3))


def test_outcome_models_cover_their_rows(spark):
    ours = driver.queries()
    labels = {r["HADM_ID"]: r["LABEL"] for r in ours["training_rows"](spark, SMALL).collect()}
    everything = ours["score_rows"](spark, SMALL).toPandas()
    assert dict(zip(everything["HADM_ID"], everything["LABEL"])) == labels
    assert everything["probability"].between(0, 1).all()
    test_part = ours["mortality_model"](spark, SMALL).toPandas()
    assert set(test_part["HADM_ID"]) < set(labels)
    summary = {r["column_name"]: r["n"] for r in ours["training_summary"](spark, SMALL).collect()}
    assert summary == dict.fromkeys(["LABEL", "prediction"], len(labels) - len(test_part))
    areas = ours["model_auc"](spark, SMALL).toPandas()
    assert list(areas["ranked_by"]) == ["rawPrediction", "prediction"]
    # the outcome follows the features but for one row in ten: a fit on shuffled features would be near 0.5
    assert areas["area_under_roc"].between(0.8, 1).all()


def test_parts_share_no_subject(spark):
    train, test = features.hash_split(queries._model_rows(spark, SMALL), "SUBJECT_ID")
    assert train.join(test, "SUBJECT_ID", "left_semi").isEmpty() and not train.isEmpty() and not test.isEmpty()


def test_imports_without_the_corpus_folders(tmp_path):
    """Without the subpackage of corpus operators and the pipeline, the other queries are there."""
    root = os.path.dirname(os.path.abspath(driver.__file__))
    ignore = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(root, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(queries.REGISTRY)), str(len(driver.ORACLE)), "0"]


def test_imports_without_a_library_of_the_corpus_part():
    """Where a library is absent that only corpus operators need, the other queries are there, with a warning."""
    root = os.path.dirname(os.path.abspath(driver.__file__))
    code = "import sys; sys.modules['sentencepiece'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    if os.path.isdir(os.path.join(root, "cohortloom", "llm")):
        assert "no corpus queries" in done.stderr
    assert done.stdout.split() == [str(len(queries.REGISTRY)), str(len(driver.ORACLE))]


def test_models_score_after_a_scan_with_an_account(spark, duck):
    """Observing a scan leaves the session able to send fitted models to executors."""
    driver.queries()["scan_account"](spark, SMALL).collect()
    assert driver.queries()["score_rows"](spark, SMALL).count() > 0
