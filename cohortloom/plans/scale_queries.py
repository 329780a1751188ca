"""Registered queries of the operators for large tables: buckets, bitmaps, hashed features, exact splits, footers, curves, saved chains."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import columns
from cohortloom.operators import cohorts, counts, features, filters, joins, models
from cohortloom.plans import queries, roles
from cohortloom.plans.oracle import COHORT, MARKERS, ORACLE, OUTCOME, TITLED, _xxhash64
from cohortloom.plans.queries import query
from cohortloom.session import materialize, scratch_path
from cohortloom.sources import buckets, files

#: Buckets of the written tables, width of hashed vectors.
BUCKETS, WIDTH = 16, 256


@query
def bucketed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients, admissions and abnormal labs written by buckets of the subject, then joined and counted there."""

    def written(df: DataFrame, name: str) -> buckets.BucketedTable:
        return buckets.write_bucketed(df, scratch_path(spark, name), "SUBJECT_ID", BUCKETS)

    patients = written(roles.patients(spark, sf_dir), "patients")
    admissions = written(roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID", "COST"), "admissions")
    visits = buckets.aggregate_bucketed(
        buckets.join_bucketed(admissions, patients),
        F.first("GENDER").alias("GENDER"),
        F.count(F.lit(1)).alias("n_visits"),
        F.max("COST").alias("highest_cost"),
    )
    return visits


ORACLE["bucketed_visits"] = """SELECT o_custkey AS "SUBJECT_ID", any_value(c_mktsegment) AS "GENDER", count(*) AS n_visits,
    max(o_totalprice) AS highest_cost FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey"""


@query
def bucketed_code_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions with the code counts of their subject: both tables by buckets, counted and joined without a shuffle."""
    labs = filters.codes_in_set(roles.labs(spark, sf_dir), roles.MARKERS, "ITEMID").select("SUBJECT_ID", "ITEMID")
    events = buckets.write_bucketed(labs, scratch_path(spark, "labs"), "SUBJECT_ID", BUCKETS)
    admitted = roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID", "ADMISSION_TYPE", "DIAGNOSIS")
    admissions = buckets.write_bucketed(admitted, scratch_path(spark, "admissions"), "SUBJECT_ID", BUCKETS)
    cells = [F.count_if(F.col("ITEMID") == c).alias(c) for c in roles.MARKERS]
    counted = [part.groupBy("SUBJECT_ID").agg(*cells) for part in (events.rows, events.heavy)]
    return buckets.join_bucketed(admissions, buckets.BucketedTable(*counted, "SUBJECT_ID", BUCKETS)).all_rows()


ORACLE["bucketed_code_matrix"] = ORACLE["admission_code_matrix"]


@query
def cohort_micro_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cohort_micro_events; admissions and events of others are dropped by bitmaps of subjects and stays, where they are read."""
    admissions = roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID")
    cohort = cohorts.cohort_events_by_bitmap(admissions, queries._cohort(spark, sf_dir))
    events = cohorts.cohort_events_by_bitmap(roles.admission_microbiology(spark, sf_dir), cohort, "HADM_ID")
    return events.groupBy("SUBJECT_ID", "SPEC_TYPE_DESC", "ORG_NAME").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("cohort_rows").alias("n_rows")
    )


ORACLE["cohort_micro_bitmap"] = ORACLE["cohort_micro_events"]


@query
def cohort_labs_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labs of the subjects of the cohort, each once, without a shuffle of labs."""
    labs = roles.labs(spark, sf_dir).select("SUBJECT_ID", "ITEMID", "VALUENUM")
    return cohorts.restrict_by_bitmap(labs, queries._cohort(spark, sf_dir))


ORACLE["cohort_labs_bitmap"] = f"""SELECT user_id AS "SUBJECT_ID", event_type AS "ITEMID", value AS "VALUENUM" FROM events
    WHERE user_id IN (SELECT o_custkey FROM {COHORT})"""


def _position(code: str) -> str:
    return f"('0x' || substr(md5({code}), 1, 15))::BIGINT % {WIDTH}"


@query
def hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the subjects' diagnoses as signed counts at hashed positions; the nonzero cells."""
    titled = queries._titled(spark, sf_dir)
    vectors = features.hashed_vectors(titled, "SUBJECT_ID", "SHORT_TITLE", WIDTH)
    cells = vectors.select("SUBJECT_ID", F.posexplode(vector_to_array("features")).alias("position", "value"))
    return cells.where("value <> 0")


ORACLE["hashed_features"] = f"""SELECT o_custkey AS "SUBJECT_ID", ({_position("p_name")})::INT AS position,
    sum(CASE WHEN ('0x' || substr(md5(p_name), 16, 1))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS value
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE {TITLED}
    GROUP BY ALL HAVING value <> 0"""


@query
def hashed_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that several titles share."""
    return features.hash_collisions(roles.lookup(spark, sf_dir), "SHORT_TITLE", WIDTH)


ORACLE["hashed_collisions"] = f"""SELECT ({_position("p_name")})::INT AS position, count(DISTINCT p_name) AS n_codes,
    min(p_name) AS first_code, max(p_name) AS last_code, count(*) AS n_events FROM part GROUP BY 1 HAVING n_codes > 1"""


@query
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions in parts by subject: exactly 70 in 100 subjects of each outcome are in the training part."""
    rows = roles.with_outcome(roles.admissions(spark, sf_dir)).select("SUBJECT_ID", "HADM_ID", "TARGET")
    return features.exact_split(rows, "SUBJECT_ID", 0.7, "TARGET").select("HADM_ID", "part")


ORACLE["exact_split"] = f"""WITH rows AS (
    SELECT o_custkey AS key, o_orderkey, {OUTCOME} AS target FROM orders
  ), keys AS (
    SELECT key, max(target) AS label, ('0x' || substr(md5(key::VARCHAR), 1, 15))::BIGINT AS hash FROM rows GROUP BY key
  ), placed AS (
    SELECT key, row_number() OVER (PARTITION BY label ORDER BY hash, key) AS place, count(*) OVER (PARTITION BY label) AS n FROM keys
  )
  SELECT o_orderkey AS "HADM_ID", CASE WHEN place <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part
  FROM rows JOIN placed USING (key)"""


@query
def table_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and extremes of columns of the admissions, from the footers of the files."""
    return files.footer_extremes(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


ORACLE["table_extremes"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_totalprice")
)


def _planted(spark: SparkSession, sf_dir: str) -> str:
    """Labs as CSV files in the layout of lab events, in four folders, with values and times that don't fit."""
    labs, path = roles.table(spark, sf_dir, "events"), scratch_path(spark, "lab-events-csv")
    text, none = (lambda c: F.col(c).cast("string")), F.lit(None).cast("string")
    lines = labs.select(
        text("event_id").alias("ROW_ID"),
        text("user_id").alias("SUBJECT_ID"),
        none.alias("HADM_ID"),
        F.col("event_type").alias("ITEMID"),
        F.when(F.col("event_id") % 89 == 0, "not known").otherwise(text("ts")).alias("CHARTTIME"),
        none.alias("VALUE"),
        F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(text("value")).alias("VALUENUM"),
        none.alias("VALUEUOM"),
        none.alias("FLAG"),
        (F.col("event_id") % 4).alias("shard"),
    )
    lines.write.partitionBy("shard").option("header", True).csv(path)
    return path


def _shard() -> Column:
    return F.regexp_extract("source_file", r"shard=(\d+)", 1).cast("int")


@query
def scan_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected values by folder and column of a CSV scan, and whether they add up to what was observed while it ran."""
    out = scratch_path(spark, "lab-events")
    _, account, totals = files.ingest_entity(spark, "lab_events", _planted(spark, sf_dir), out)
    by_shard = account.groupBy(_shard().alias("shard"), "column_name").agg(F.sum("n_rejected").alias("n_rejected"))
    observed = F.element_at(F.create_map(*[F.lit(x) for pair in totals.items() for x in pair]), F.col("column_name"))
    total = by_shard.groupBy("column_name").agg((F.sum("n_rejected") == F.first(observed)).alias("adds_up"))
    return by_shard.join(F.broadcast(total), "column_name")


ORACLE["scan_account"] = """SELECT (event_id % 4)::INT AS shard, 'CHARTTIME' AS column_name, count(*) AS n_rejected, true AS adds_up
    FROM events WHERE event_id % 89 = 0 GROUP BY ALL
    UNION ALL SELECT (event_id % 4)::INT, 'VALUENUM', count(*), true FROM events WHERE event_id % 97 = 0 GROUP BY ALL"""


@query
def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lab events read from CSV; what did not fit is null and named."""
    out = scratch_path(spark, "lab-events")
    rows, _, _ = files.ingest_entity(spark, "lab_events", _planted(spark, sf_dir), out)
    return rows.select("ROW_ID", "SUBJECT_ID", "ITEMID", "CHARTTIME", "VALUENUM", F.array_join("rejected", ",").alias("rejected"))


ORACLE["entity_scan"] = """SELECT event_id AS "ROW_ID", user_id::VARCHAR AS "SUBJECT_ID", event_type AS "ITEMID",
    CASE WHEN event_id % 89 <> 0 THEN ts END AS "CHARTTIME", CASE WHEN event_id % 97 <> 0 THEN value END AS "VALUENUM",
    concat_ws(',', CASE WHEN event_id % 89 = 0 THEN 'CHARTTIME' END, CASE WHEN event_id % 97 = 0 THEN 'VALUENUM' END) AS rejected
    FROM events"""


@query
def vector_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each position of sparse count vectors, by one aggregation of vectors."""
    codes = list(roles.MARKERS)
    vectors = features.code_vectors(roles.labs(spark, sf_dir), "SUBJECT_ID", "ITEMID", codes)
    named = F.element_at(F.array(*[F.lit(c) for c in codes]), F.col("position") + 1)
    found = features.vector_summary(vectors)
    return found.select(named.alias("code"), *[F.round(c, 9).alias(c) for c in ("mean", "stddev")], "n_nonzero")


ORACLE["vector_means"] = f"""WITH subjects AS (SELECT DISTINCT user_id FROM events WHERE event_type IN ({MARKERS})),
  cells AS (SELECT s.user_id, c.code, count(e.event_id) AS n FROM subjects s CROSS JOIN (SELECT unnest([{MARKERS}]) AS code) c
    LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = c.code GROUP BY ALL)
  SELECT code, round(avg(n), 9) AS mean, round(stddev_samp(n), 9) AS stddev, count_if(n > 0)::BIGINT AS n_nonzero FROM cells GROUP BY code"""


def _scored_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.with_outcome(roles.admissions(spark, sf_dir))
    return rows.select("COST", columns.label_from_target(F.col("TARGET")).alias("LABEL"))


@query
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ROC curve of the cost of an admission as the score of its outcome, a point for each cost."""
    return models.roc_curve(_scored_cost(spark, sf_dir), by="COST")


ORACLE["roc_curve"] = f"""SELECT s AS threshold, sum(pos) OVER falling / sum(pos) OVER () AS tpr, sum(neg) OVER falling / sum(neg) OVER () AS fpr
    FROM (SELECT o_totalprice AS s, count_if({OUTCOME} = 'Y') AS pos, count_if({OUTCOME} <> 'Y') AS neg FROM orders GROUP BY 1)
    WINDOW falling AS (ORDER BY s DESC)"""


@query
def roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area under that curve, by running totals over ranges of scores."""
    return models.roc_area(_scored_cost(spark, sf_dir), by="COST").select(F.round("area_under_roc", 9).alias("area_under_roc"))


ORACLE["roc_area"] = ORACLE["score_auc"]


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_matrix(roles.labs(spark, sf_dir), "SUBJECT_ID", "ITEMID", roles.EVENT_TYPES)


@query
def stages_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain fitted as one gives what its steps give one by one, and what it gives after it was saved and loaded in another
    session."""
    matrix = materialize(_matrix(spark, sf_dir))
    steps = [features.assembler(roles.EVENT_TYPES), features.scaler(), models.kmeans(3)]
    chain = models.fit_stages(matrix, steps)
    path = scratch_path(spark, "chain")
    models.save_stages(chain, path)
    other = spark.newSession()
    loaded = models.load_stages(other, path)
    kept = scratch_path(spark, "scored")
    loaded.transform(_matrix(other, sf_dir)).select("SUBJECT_ID", "prediction").write.parquet(kept)
    vectors = features.assembler(roles.EVENT_TYPES).transform(matrix)
    scaled = features.scaler().fit(vectors).transform(vectors)
    single = models.fit_kmeans(scaled, 3).transform(scaled).select("SUBJECT_ID", F.col("prediction").alias("single"))
    again = spark.read.parquet(kept).withColumnRenamed("prediction", "again")
    clustered = chain.transform(matrix).select("SUBJECT_ID", "prediction").join(single, "SUBJECT_ID").join(again, "SUBJECT_ID")
    return clustered.select(
        "SUBJECT_ID",
        (F.col("prediction") == F.col("single")).alias("as_single_steps"),
        (F.col("prediction") == F.col("again")).alias("as_loaded"),
    )


ORACLE["stages_conditions"] = """SELECT DISTINCT user_id AS "SUBJECT_ID", true AS as_single_steps, true AS as_loaded FROM events"""


def _least_distances(model: models.KMeansModel, df: DataFrame) -> float:
    """Sum over the rows of the squared distance to the nearest centre, spelled out."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    gap = lambda c: F.aggregate(
        F.zip_with(vector_to_array("scaledFeatures"), c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, d: t + d
    )
    return df.agg(F.sum(F.array_min(F.transform(centres, gap)))).first()[0]


@query
def cost_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each k, the cost of a clustering and the cost that the sweep finds are both the summed least distances."""
    scaled = materialize(queries._scaled(spark, sf_dir))
    swept = dict(models.k_sweep(scaled, (2, 3, 5)))
    near = lambda a, b: F.abs(a - b) <= 1e-8 * F.abs(b)
    rows = []
    for k, cost in swept.items():
        model = models.fit_kmeans(scaled, k)
        least = F.lit(_least_distances(model, scaled))
        rows.append(
            models.kmeans_cost(model, scaled).select(
                F.lit(k).alias("k"),
                near(F.col("cost"), least).alias("cost_is_least"),
                near(F.lit(float(cost)), least).alias("sweep_is_least"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


ORACLE["cost_conditions"] = "SELECT unnest([2, 3, 5])::INT AS k, true AS cost_is_least, true AS sweep_is_least"


@query
def score_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows hold the logistic function of their features and the likelier class, on the rows of the test part."""
    train, test = features.hash_split(queries._model_rows(spark, sf_dir), "SUBJECT_ID")
    model = models.fit_logistic(train)
    weights = F.array(*[F.lit(float(x)) for x in model.coefficients])
    products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
    margin = F.aggregate(products, F.lit(float(model.intercept)), lambda t, d: t + d)
    own = test.select("HADM_ID", (1 / (1 + F.exp(-margin))).alias("own"))
    scored = models.score(model, test, ["HADM_ID", "LABEL"]).join(own, "HADM_ID")
    return scored.select(
        "HADM_ID",
        "LABEL",
        (F.abs(F.col("probability") - F.col("own")) < 1e-9).alias("by_formula"),
        ((F.col("prediction") == 1) == (F.col("probability") > 0.5)).alias("likelier_class"),
    )


ORACLE["score_conditions"] = f"""SELECT "HADM_ID", "LABEL", true AS by_formula, true AS likelier_class
    FROM ({ORACLE["training_rows"]}) dense JOIN ({_xxhash64("o_custkey", "(SELECT DISTINCT o_custkey FROM orders)")}) hashed
    ON key = "SUBJECT_ID" WHERE tenth >= 7"""


@query
def admission_grain_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions with the counts of their own diagnoses by chapter: the matrix is built and attached on the admission key."""
    coded = roles.admission_diagnoses(spark, sf_dir).join(roles.lookup(spark, sf_dir).select("ICD9_CODE", "CHAPTER"), "ICD9_CODE")
    matrix = counts.count_matrix(coded, "HADM_ID", "CHAPTER", roles.CHAPTERS)
    return joins.attach_matrix(roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID"), matrix, "HADM_ID")


ORACLE["admission_grain_matrix"] = f"""SELECT any_value(o_custkey) AS "SUBJECT_ID", o_orderkey AS "HADM_ID",
    {", ".join(f"count(*) FILTER (WHERE p_type = '{c}') AS " + f'"{c}"' for c in roles.CHAPTERS)}
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey"""


@query
def random_split_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each admission is in one part of a seeded random split, and the parts are near their shares."""
    rows = materialize(roles.admissions(spark, sf_dir).select("HADM_ID"))
    train, test = features.random_split(rows)
    parts = train.withColumn("in_train", F.lit(1)).unionByName(test.withColumn("in_train", F.lit(0)))
    total = F.count(F.lit(1))
    return parts.agg(
        total.alias("n"),
        (F.count_distinct("HADM_ID") == total).alias("disjoint"),
        F.avg("in_train").between(0.65, 0.75).alias("near_share"),
    )


ORACLE["random_split_conditions"] = "SELECT count(*) AS n, true AS disjoint, true AS near_share FROM orders"
