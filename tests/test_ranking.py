import random

from pyspark.sql import functions as F

from cohortloom.functions.names import free_name
from cohortloom.operators import features
from cohortloom.operators.ranking import numbered, running_totals


def test_places_over_ranges_with_ties_and_nulls(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, *range(9)]), k, "x", "y") for k in range(3000)]
    df = spark.createDataFrame(rows, "v int, k int, _range string, _row string").repartition(7)
    found = numbered(df, F.asc_nulls_last("v"), F.desc("k"), name="place").collect()
    wanted = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert [tuple(r)[:4] for r in sorted(found, key=lambda r: r["place"])] == wanted
    assert sorted(r["place"] for r in found) == list(range(3000))
    assert found[0].asDict().keys() == {"v", "k", "_range", "_row", "place"}


def test_one_row_per_range_and_none(spark):
    """As many ranges as rows, with borders everywhere."""
    eight = spark.range(8).repartition(8)
    assert [tuple(r) for r in numbered(eight, F.desc("id")).orderBy("position").collect()] == [(7 - k, k) for k in range(8)]
    assert numbered(eight.where("id < 0"), "id").count() == 0


def test_no_task_sees_all_rows(spark):
    plan = numbered(spark.range(1000), "id")._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_running_totals(spark):
    draw = random.Random(2)
    rows = [(k, draw.choice([None, 1, 5, -2]), draw.randint(0, 2**40)) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, a int, b bigint").repartition(5)
    found = running_totals(df, [F.desc("k")], {"sum_a": "a", "sum_b": "b"}).collect()
    a = b = 0
    wanted = {}
    for k, x, y in reversed(rows):
        a, b = a + (x or 0), b + y
        wanted[k] = (a, b)
    assert {r["k"]: (r["sum_a"], r["sum_b"]) for r in found} == wanted


def test_free_names():
    assert free_name(["a", "_Range", "_range_"], "_range") == "_range__" and free_name([], "x") == "x"


def test_positions_are_the_same_in_the_driver_and_over_ranges(spark, monkeypatch):
    codes = [f"{c}{k}" for k in range(200) for c in ("é", "b", "Z", "日本", "\U0001f600")] + [None, "b1"]
    df = spark.createDataFrame([(c,) for c in codes], "code string").repartition(6)
    few = {tuple(r) for r in features.positions(df, "code").collect()}
    monkeypatch.setattr(features, "DRIVER_CODES", 10)
    many = features.positions(df, "code")
    assert {tuple(r) for r in many.collect()} == few and len(few) == 1000
    assert "Window" not in many._jdf.queryExecution().toString()
