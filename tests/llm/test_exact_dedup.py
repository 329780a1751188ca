import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from cohortloom.llm.exact_dedup import DigestIndex, drop_exact_copies


def index(spark, tmp_path, buckets=4):
    return DigestIndex(spark, f"file://{tmp_path}/index", buckets)


def test_awkward_rows(spark, awkward, tmp_path):
    found = index(spark, tmp_path).add(awkward).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    groups = defaultdict(list)
    for doc_id, text in texts:
        groups[hashlib.sha256(text.encode()).digest()].append(doc_id)
    assert len(found) == len(texts)
    for row in found:
        ids = groups[bytes(row["digest"])]
        assert row["group_size"] == len(ids)
        assert row["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = [r for r in found if r["kept"]]
    assert sorted(str(r["keep_id"]) for r in kept) == sorted(str(max((i for i in g if i is not None), default=None)) for g in groups.values())


def test_later_batches_meet_the_index(spark, tmp_path):
    tmp_path = tmp_path / "it's here"
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    second = spark.createDataFrame([(0, "a"), (9, "a"), (10, "c"), (11, "c")], "doc_id bigint, text string")
    known = index(spark, tmp_path)
    assert {r["doc_id"] for r in known.add(first, "one").collect() if r["kept"]} == {2, 3}
    decided = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in known.add(second, "two").collect()}
    assert decided == {0: (3, False), 9: (3, False), 10: (11, False), 11: (11, True)}
    # a batch that is run again decides as before and adds nothing
    assert {r["doc_id"] for r in known.add(second, "two").collect() if r["kept"]} == {11}
    assert known.read().count() == 3
    # another session finds the files
    again = DigestIndex(spark.newSession(), known.path, known.buckets)
    assert {r["doc_id"] for r in again.add(first, "three").collect() if r["kept"]} == set()


def test_anti_join_uses_the_buckets(spark, tmp_path):
    known = index(spark, tmp_path)
    known.add(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    other = known.read().select("digest").groupBy("digest").count()
    plan = other._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Scan")[0]


def test_hot_text(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 3000)) AS text")
    found = index(spark, tmp_path).add(docs).toPandas()
    frame = docs.toPandas()
    expected = frame.groupby("text").doc_id.max()
    assert dict(zip(found.doc_id, found.keep_id)) == dict(zip(frame.doc_id, frame.text.map(expected)))
    assert found.kept.sum() == len(expected)


def test_stage_keeps_one_row_of_each_text(spark, awkward, tmp_path):
    kept = drop_exact_copies(awkward, index(spark, tmp_path))
    assert kept.columns == awkward.columns
    rows = kept.collect()
    assert len(rows) == 6 and sum(r["doc_id"] == 2 for r in rows) == 1


def test_empty(spark, nothing, tmp_path):
    assert index(spark, tmp_path).add(nothing).count() == 0
    assert drop_exact_copies(nothing, index(spark, tmp_path)).count() == 0


def test_the_count_of_buckets_belongs_to_the_index(spark, tmp_path):
    """A batch that comes under another setting meets the texts that are there."""
    path, key = f"file://{tmp_path}/kept", "spark.sql.shuffle.partitions"
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, text string")
    kept = spark.conf.get(key)
    try:
        for setting, expected in (("4", [True, True]), ("8", [False, False]), ("3", [False, False])):
            spark.conf.set(key, setting)
            index = DigestIndex(spark, path, None if setting != "3" else 5)
            assert index.buckets == 4
            assert [r["kept"] for r in index.add(docs).collect()] == expected
        other = spark.newSession()
        assert DigestIndex(other, path).read().count() == 2
    finally:
        spark.conf.set(key, kept)


def test_texts_are_shuffled_once(spark, tmp_path):
    """The table of documents is dealt out for one join only; repeated rows are looked at apart."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 300).alias("text"))
    docs.write.parquet(f"{tmp_path}/docs")
    kept = drop_exact_copies(spark.read.parquet(f"{tmp_path}/docs"), DigestIndex(spark, f"file://{tmp_path}/once"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join LeftSemi") == 1 and kept.count() == 300
