"""URL filters by dated lists.

A list is a history: on a day, a key (a domain, or a host with the start of a path) is given an action: block, allow or remove.
Each entry is valid until the next one of its key. A capture is held against the entries that were valid on the day of its
fetch, under each domain that its host is in and each start of its path; the most specific (longest) key decides.

The as-of join is an equality on key and period (a number of days), into which validity intervals are cut: a hot host's
captures are spread over the periods, and each meets at most one entry a day of its key. Only periods in which something was fetched
count, so a wrong date of a capture or an entry, however far off, makes no more rows than any other. No list is broadcast.

Defined results: of several actions for a key on a day the last by name counts (remove, block, allow); an entry is valid from
its day on; a null or malformed URL has host '' and meets no entry; a capture without fetch day meets none; repeated captures
are decided alike, each in its own row; empty tables give an empty result or no blocked capture; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days of a period of the join.
PERIOD = 32
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_candidates(host: Column, path: Column, labels: int, segments: int, least: int = 1) -> Column:
    """The domains of a host with at least and at most so many labels, and the starts of the path with at most so many segments."""
    parts = F.split(host, r"\.")
    longest = F.greatest(F.size(parts) - labels + 1, F.lit(1))
    begins = F.filter(F.sequence(longest, F.size(parts)), lambda k: k <= F.size(parts) - least + 1)
    domains = F.transform(begins, lambda k: F.concat_ws(".", F.slice(parts, k, F.size(parts))))
    steps = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, segments)
    starts = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(steps)), lambda k: k > 0),
        lambda k: F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(steps, 1, k))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, starts)))


def validity(history: DataFrame) -> DataFrame:
    """``key, action, valid_from, valid_until`` (exclusive, null: open) of a list history ``key, listed_on, action``."""
    daily = history.filter("key IS NOT NULL AND listed_on IS NOT NULL").groupBy("key", "listed_on").agg(F.max("action").alias("action"))
    after = F.lead("listed_on").over(Window.partitionBy("key").orderBy("listed_on"))
    ranges = daily.select("key", "action", F.col("listed_on").alias("valid_from"), after.alias("valid_until"))
    return ranges.filter(F.col("action") != "remove")


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PERIOD).cast("int")


def _periods(captures: DataFrame) -> Column:
    """The periods in which anything was fetched, as one literal array; the calendar bounds them (about 114,000 in 10,000 years)."""
    found = captures.select(_period(F.col("fetched_on").cast("date")).alias("p")).filter("p IS NOT NULL").distinct().collect()
    texts = ",".join(str(r[0]) for r in sorted(found))
    return F.filter(F.split(F.lit(texts), ",").try_cast("array<int>"), lambda p: p.isNotNull()) if found else F.array().cast("array<int>")


def decide(captures: DataFrame, history: DataFrame) -> DataFrame:
    """``page_id, url, fetched_on, host, n_active, decided_by, valid_from, action, blocked`` for each capture.

    ``captures`` has ``page_id, url, fetched_on``, ``history`` has ``key, listed_on, action``.
    """
    ranges = validity(history)
    labels = F.size(F.split(F.split("key", "/")[0], r"\."))
    deepest = ranges.agg(
        F.max(labels).alias("labels"),
        F.min(F.when(~F.contains("key", F.lit("/")), labels)).alias("least"),
        F.max(F.size(F.split("key", "/")) - 1).alias("segments"),
    ).first()
    begin, end = _period(F.col("valid_from")), _period(F.date_sub(F.col("valid_until"), 1))
    inside = F.filter(_periods(captures), lambda p: (p >= begin) & (F.col("valid_until").isNull() | (p <= end)))
    cut = ranges.withColumn("period", F.explode(inside))
    cut = cut.withColumnRenamed("key", "_key").withColumnRenamed("period", "_period")

    rows = captures.select("page_id", "url", F.col("fetched_on").cast("date").alias("fetched_on"))
    rows = rows.groupBy("page_id", "url", "fetched_on").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    keys = key_candidates(F.col("host"), path_of(F.col("url")), deepest["labels"] or 0, deepest["segments"] or 0, deepest["least"] or 1)
    rows = rows.withColumn("key", F.explode_outer(keys)).withColumn("period", _period(F.col("fetched_on")))
    active = (
        (F.col("key") == F.col("_key"))
        & (F.col("period") == F.col("_period"))
        & (F.col("fetched_on") >= F.col("valid_from"))
        & (F.col("valid_until").isNull() | (F.col("fetched_on") < F.col("valid_until")))
    )
    met = rows.join(cut, active, "left")
    length = F.when(F.col("_key").isNotNull(), F.char_length("_key"))
    decided = met.groupBy("page_id", "url", "fetched_on", "host", "n_rows").agg(
        F.count("_key").alias("n_active"), F.max_by(F.struct("_key", "valid_from", "action"), length).alias("last")
    )
    decided = decided.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return decided.select(
        "page_id",
        "url",
        "fetched_on",
        "host",
        "n_active",
        F.col("last._key").alias("decided_by"),
        F.col("last.valid_from").alias("valid_from"),
        F.col("last.action").alias("action"),
        F.coalesce(F.col("last.action") == "block", F.lit(False)).alias("blocked"),
    )
