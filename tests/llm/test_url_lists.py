import datetime

from cohortloom.llm import url_lists
from cohortloom.llm.url_lists import decide, host_of, key_candidates, path_of, validity
from pyspark.sql import functions as F


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def frames(spark, captures, history):
    captures = [(k, u, None if d is None else day(d), "extra") for k, u, d in captures]
    return (
        spark.createDataFrame(captures, "page_id bigint, url string, fetched_on date, action string"),
        spark.createDataFrame([(k, None if d is None else day(d), a) for k, d, a in history], "key string, listed_on date, action string"),
    )


HISTORY = [
    ("bad.org", 10, "block"),
    ("bad.org", 50, "remove"),
    ("bad.org", 400, "block"),
    ("bad.org/good", 20, "allow"),
    ("a.bad.org", 45, "allow"),
    ("tie.org", 5, "allow"),
    ("tie.org", 5, "block"),
    ("tie.org", 5, "block"),
    (None, 1, "block"),
    ("never.org", None, "block"),
]
CAPTURES = [
    (1, "http://bad.org/x", 9),
    (2, "http://bad.org/x", 10),
    (3, "https://WWW.bad.org:8080/x?y", 49),
    (4, "http://bad.org/", 50),
    (5, "http://bad.org/good/page", 30),
    (6, "http://bad.org/goods", 30),
    (7, "http://a.bad.org/good", 46),
    (8, "http://user@bad.org/", 5000),
    (9, "http://tie.org", 5),
    (10, None, 30),
    (11, "no address", 30),
    (12, "http://bad.org", None),
    (13, "http://never.org", 30),
    (2, "http://bad.org/x", 10),
    (None, "http://bad.org/x", 12),
]
BLOCKED = {2, 3, 6, 8, 9, None}


def test_entries_as_of_the_fetch(spark):
    rows = decide(*frames(spark, CAPTURES, HISTORY)).collect()
    assert len(rows) == len(CAPTURES)
    assert {r["page_id"] for r in rows if r["blocked"]} == BLOCKED
    by_page = {r["page_id"]: r for r in rows}
    assert by_page[5]["decided_by"] == "bad.org/good" and by_page[5]["n_active"] == 2 and by_page[5]["valid_from"] == day(20)
    assert by_page[7]["decided_by"] == "a.bad.org" and by_page[7]["action"] == "allow"
    assert by_page[4]["n_active"] == 1 - 1 and by_page[4]["decided_by"] is None
    assert sum(r["page_id"] == 2 for r in rows) == 2 and all(r["n_active"] == 1 for r in rows if r["page_id"] == 2)


def test_validity(spark):
    _, history = frames(spark, [], HISTORY)
    ranges = {(r["key"], r["valid_from"], r["valid_until"], r["action"]) for r in validity(history).collect()}
    assert ranges == {
        ("bad.org", day(10), day(50), "block"),
        ("bad.org", day(400), None, "block"),
        ("bad.org/good", day(20), None, "allow"),
        ("a.bad.org", day(45), None, "allow"),
        ("tie.org", day(5), None, "block"),
    }


def test_keys(spark):
    url = spark.createDataFrame([("http://a.b.c.org/x//y/z?q",)], "url string")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    keys = url.select(key_candidates(host, path, 3, 5).alias("k")).first()["k"]
    assert keys == ["b.c.org", "c.org", "org", "a.b.c.org/x", "a.b.c.org/x/y", "a.b.c.org/x/y/z"]


def test_empty(spark):
    none = frames(spark, [], [])
    assert decide(*none).count() == 0
    assert not any(r["blocked"] for r in decide(frames(spark, CAPTURES, [])[0], none[1]).collect())
    assert decide(none[0], frames(spark, [], HISTORY)[1]).count() == 0


def test_empty_parts_take_no_depth(spark):
    url = spark.createDataFrame([("http://h.org//x///y/z",)], "url string")
    for depth, starts in ((0, []), (1, ["h.org/x"]), (2, ["h.org/x", "h.org/x/y"])):
        keys = url.select(key_candidates(host_of(F.col("url")), path_of(F.col("url")), 1, depth).alias("k")).first()["k"]
        assert keys == ["org", *starts]
    captures = [(1, "http://h.org//a/b", 9), (2, "http://h.org/a", 9), (3, "http://h.org//b/a", 9)]
    rows = decide(*frames(spark, captures, [("h.org/a", 5, "block"), ("h.org", 1, "allow")])).collect()
    assert {r["page_id"]: (r["n_active"], r["decided_by"], r["blocked"]) for r in rows} == {
        1: (2, "h.org/a", True),
        2: (2, "h.org/a", True),
        3: (1, "h.org", False),
    }


def test_dates_far_off_make_no_rows(spark):
    """One wrong date of a capture, or of an entry, is a period like others."""
    days = ["0001-01-01", "9999-12-31", "2020-03-01", "2020-03-02", None]
    captures = spark.createDataFrame([(k, "http://a.b.com/x", d) for k, d in enumerate(days)], "page_id bigint, url string, d string")
    captures = captures.select("page_id", "url", F.col("d").cast("date").alias("fetched_on"))
    history = [("b.com", "2020-03-02", "block"), ("com", "0001-01-01", "allow"), ("b.com", "9999-12-31", "remove")]
    history = spark.createDataFrame(history, "key string, d string, action string").select("key", F.col("d").cast("date").alias("listed_on"), "action")
    found = {r["page_id"]: (r["n_active"], r["action"]) for r in url_lists.decide(captures, history).collect()}
    assert found == {0: (1, "allow"), 1: (1, "allow"), 2: (1, "allow"), 3: (2, "block"), 4: (0, None)}
    assert len(url_lists._periods(captures)._jc.toString()) < 300


def test_keys_shorter_than_any_listed_are_not_made(spark):
    row = spark.createDataFrame([("x.a.b.com", "/p/q")], "h string, p string")
    found = row.select(url_lists.key_candidates(F.col("h"), F.col("p"), 3, 1, 2)).first()[0]
    assert found == ["a.b.com", "b.com", "x.a.b.com/p"]
