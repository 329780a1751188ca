"""Registered queries: every operator on the test tables in their hospital roles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import columns
from cohortloom.operators import counts, features, filters, joins, models
from cohortloom.plans import mortality, roles
from cohortloom.session import materialize, scratch_path
from cohortloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


# sources and sinks


@query
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"o_custkey": "SUBJECT_ID", "o_orderkey": "HADM_ID", "o_orderdate": "ADMITTIME"}
    return features.rename(roles.table(spark, sf_dir, "orders"), names)


@query
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, path = roles.table(spark, sf_dir, "orders"), scratch_path(spark, "orders-csv")
    files.write_csv(orders, path)
    return files.read_csv(spark, path, orders.schema)


@query
def csv_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line breaks, written and read back."""
    texts, path = roles.table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "texts-csv")
    files.write_csv(texts, path, null="\\N")
    return files.read_csv(spark, path, texts.schema, multi_line=True, null="\\N")


@query
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders-parquet")
    files.write_parquet(roles.table(spark, sf_dir, "orders"), path, compression="uncompressed")
    return files.read_parquet(spark, path)


@query
def drop_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two CSV files with header lines, read as data without the header option."""
    path = scratch_path(spark, "orders-headers")
    orders = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    files.write_csv(orders, path)
    read = files.read_csv(spark, path, header=False)
    return files.drop_header_rows(read, "_c0", "o_orderkey").select(
        F.col("_c0").cast("bigint").alias("HADM_ID"),
        F.col("_c1").cast("bigint").alias("SUBJECT_ID"),
        F.col("_c2").alias("ADMISSION_TYPE"),
    )


@query
def code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named code list with the number of events of each code, absent codes included."""
    codes = filters.code_table(spark, roles.MARKERS)
    seen = counts.count_by(filters.codes_in_set(roles.labs(spark, sf_dir), roles.MARKERS, "ITEMID"), "ITEMID")
    joined = codes.join(seen, F.col("ITEMCODE") == F.col("ITEMID"), "left")
    return joined.select("ITEMCODE", "NAME", F.coalesce("n", F.lit(0)).alias("n"))


# projections and filters


@query
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.table(spark, sf_dir, "events").drop("props", "value")


@query
def project_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.project_except(roles.table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_retailprice"])


@query
def length_of_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay = columns.days_between(F.col("ADMITTIME"), F.col("DISCHTIME"))
    return (
        roles.stays(spark, sf_dir)
        .withColumn("days", stay)
        .withColumnRenamed("days", "los_days")
        .drop("ADMITTIME", "DISCHTIME")
    )


@query
def age_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.stays(spark, sf_dir).select(
        "SUBJECT_ID", "HADM_ID", "l_linenumber", columns.age_years(F.col("ADMITTIME"), F.col("DISCHTIME")).alias("AGE")
    )


@query
def feature_matrix_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = filters.codes_in_set(roles.labs(spark, sf_dir), roles.MARKERS, "ITEMID")
    matrix = counts.count_matrix(listed, "SUBJECT_ID", "ITEMID", list(roles.MARKERS))
    return features.project_fixed(matrix, ["SUBJECT_ID"], list(roles.MARKERS))


@query
def filter_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.equal_to(roles.admissions(spark, sf_dir), "DIAGNOSIS", "F").select("HADM_ID", "DIAGNOSIS")


@query
def flag_equals_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = roles.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").cast("string").alias("WARNING")
    )
    return filters.flagged_one(lines)


@query
def filter_abnormal_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.flagged_abnormal(roles.labs(spark, sf_dir))
    return kept.select("ROW_ID", "SUBJECT_ID", "ITEMID", "VALUENUM")


@query
def filter_flag_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.flagged_any(roles.labs(spark, sf_dir))
    return kept.select("ROW_ID", "SUBJECT_ID", "ITEMID", "VALUENUM", "FLAG")


@query
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.title_search(roles.lookup(spark, sf_dir), "SHORT_TITLE", roles.WORDS)
    return found.select("ICD9_CODE", "SHORT_TITLE")


@query
def title_regex_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.text_matches(F.col("SHORT_TITLE"), "ring").alias("found")
    return roles.lookup(spark, sf_dir).select("ICD9_CODE", found)


@query
def mortality_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = columns.mortality_target(F.col("DEATHTIME"))
    return roles.admissions(spark, sf_dir).select("HADM_ID", target.alias("TARGET"))


@query
def label_from_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = columns.mortality_target(F.col("DEATHTIME"))
    return roles.admissions(spark, sf_dir).select("HADM_ID", columns.label_from_target(target).alias("LABEL"))


@query
def codes_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.codes_in_set(roles.labs(spark, sf_dir), roles.MARKERS, "ITEMID")
    return kept.select("ROW_ID", "SUBJECT_ID", "ITEMID")


@query
def codes_not_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.codes_not_in_set(roles.labs(spark, sf_dir), roles.MARKERS, "ITEMID")
    return kept.select("ROW_ID", "SUBJECT_ID", "ITEMID")


def _title_codes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = filters.title_search(roles.lookup(spark, sf_dir), "SHORT_TITLE", roles.WORDS)
    return found.select(F.col("ICD9_CODE").cast(kind).alias("ICD9_CODE"))


@query
def codes_in_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnoses whose code, a number, is in a table of codes as text, and among those in a table of numbers."""
    coded = roles.admission_diagnoses(spark, sf_dir)
    kept = filters.codes_in_set(coded, _title_codes(spark, sf_dir, "string"), "ICD9_CODE")
    kept = filters.codes_in_set(kept, _title_codes(spark, sf_dir, "bigint"), "ICD9_CODE")
    return counts.count_by(kept, "ICD9_CODE")


@query
def codes_not_in_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = roles.admission_diagnoses(spark, sf_dir)
    kept = filters.codes_not_in_set(coded, _title_codes(spark, sf_dir, "string"), "ICD9_CODE")
    return counts.count_by(kept, "ICD9_CODE")


# joins


@query
def patient_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = joins.patient_admissions(roles.patients(spark, sf_dir), roles.admissions(spark, sf_dir))
    return joined.select("SUBJECT_ID", "GENDER", "HADM_ID", "ADMISSION_TYPE", "DIAGNOSIS")


@query
def deaths_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = joins.deaths_only(roles.patients(spark, sf_dir), roles.admissions(spark, sf_dir), "DEATHTIME")
    return joined.select("SUBJECT_ID", "GENDER", "HADM_ID", "DEATHTIME")


@query
def admission_code_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = filters.codes_in_set(roles.labs(spark, sf_dir), roles.MARKERS, "ITEMID")
    matrix = counts.count_matrix(listed, "SUBJECT_ID", "ITEMID", list(roles.MARKERS))
    admissions = roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID", "ADMISSION_TYPE", "DIAGNOSIS")
    return joins.attach_matrix(admissions, matrix)


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients of one group with an admission of one diagnosis, one row each with the number of admissions."""
    admissions = filters.equal_to(roles.admissions(spark, sf_dir), "DIAGNOSIS", "F")
    group = filters.equal_to(roles.patients(spark, sf_dir), "GENDER", "AUTOMOBILE")
    return joins.cohort_members(admissions).join(group.select("SUBJECT_ID"), "SUBJECT_ID", "left_semi")


@query
def cohort_micro_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject and kind: events of the cohort, and the rows of the join with one cohort row per admission."""
    admissions = roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID")
    # the cohort is the smaller part of the admissions, so it comes before the events
    cohort = joins.cohort_events(admissions, _cohort(spark, sf_dir))
    events = roles.admission_microbiology(spark, sf_dir).join(cohort, "HADM_ID")
    return events.groupBy("SUBJECT_ID", "SPEC_TYPE_DESC", "ORG_NAME").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("cohort_rows").alias("n_rows")
    )


@query
def cohort_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject and code: diagnoses of the cohort, and the rows of the join with one cohort row per admission."""
    admissions = roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID")
    cohort = joins.cohort_events(admissions, _cohort(spark, sf_dir))
    coded = roles.admission_diagnoses(spark, sf_dir).join(cohort, "HADM_ID")
    return coded.groupBy("SUBJECT_ID", "ICD9_CODE").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("cohort_rows").alias("n_rows")
    )


@query
def cohort_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions of the subjects of the cohort, each once."""
    admissions = roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID")
    return joins.restrict_to_cohort(admissions, _cohort(spark, sf_dir))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the title search comes first: it leaves the fewest rows for the second join
    found = joins.diagnoses_by_title(
        roles.admission_diagnoses(spark, sf_dir), roles.lookup(spark, sf_dir), roles.WORDS
    )
    return found.join(roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID"), "HADM_ID")


@query
def diagnoses_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir).select("SUBJECT_ID", "ICD9_CODE", "SHORT_TITLE")


@query
def code_overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.code_overlap_count(roles.lookup(spark, sf_dir), "CHAPTER", [*roles.CHAPTERS[:2], *roles.MARKERS])


@query
def top_diagnoses_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = roles.admission_diagnoses(spark, sf_dir)
    return joins.top_diagnoses_titled(codes, roles.lookup(spark, sf_dir), "ICD9_CODE", "SHORT_TITLE", 20)


@query
def one_hot_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    admissions = roles.admissions(spark, sf_dir).select("SUBJECT_ID", "HADM_ID", "ADMISSION_TYPE", "DIAGNOSIS")
    one_hot = counts.one_hot_counts(
        admissions, "SUBJECT_ID", {"ADMISSION_TYPE": roles.PRIORITIES, "DIAGNOSIS": roles.STATUSES}
    )
    return joins.attach_matrix(admissions.select("SUBJECT_ID", "HADM_ID"), one_hot)


@query
def whitelist_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = joins.whitelist(roles.admissions(spark, sf_dir), "ADMISSION_TYPE", ["1-URGENT", "2-HIGH"])
    return kept.select("SUBJECT_ID", "HADM_ID", "ADMISSION_TYPE")


# aggregations


@query
def count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_by(roles.labs(spark, sf_dir), "SUBJECT_ID")


@query
def count_by_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_by(roles.labs(spark, sf_dir), "SUBJECT_ID", "ITEMID")


@query
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables, from the footers of their files."""
    names = ("customer", "orders", "lineitem", "events", "part")
    return files.footer_counts(spark, {name: f"{sf_dir}/{name}.parquet" for name in names})


@query
def matrix_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.matrix_means(feature_matrix_select(spark, sf_dir), list(roles.MARKERS))


@query
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = counts.cube_counts(roles.admissions(spark, sf_dir), "DIAGNOSIS", "ADMISSION_TYPE", first_key_only=True)
    return counts.sort_by_key(cube, "DIAGNOSIS", "ADMISSION_TYPE")


@query
def cube_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.cube_counts(roles.admissions(spark, sf_dir), "DIAGNOSIS", "ADMISSION_TYPE")


@query
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.rollup_counts(roles.admissions(spark, sf_dir), "DIAGNOSIS", "ADMISSION_TYPE")


@query
def crosstab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.crosstab(roles.labs(spark, sf_dir), "SUBJECT_ID", "ITEMID")


@query
def contingency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contingency table in long form, over codes of any number."""
    return counts.contingency(roles.admission_diagnoses(spark, sf_dir), "HADM_ID", "ICD9_CODE")


@query
def matrix_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.sort_by_key(feature_matrix_select(spark, sf_dir), "SUBJECT_ID", ascending=False)


@query
def one_hot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.one_hot_counts(
        roles.admissions(spark, sf_dir), "SUBJECT_ID", {"ADMISSION_TYPE": roles.PRIORITIES}, prefix=False
    )


@query
def codes_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.codes_per_subject(roles.labs(spark, sf_dir), "SUBJECT_ID", "ITEMID")


@query
def listed_codes_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = filters.codes_in_set(roles.labs(spark, sf_dir), roles.MARKERS, "ITEMID")
    return counts.codes_per_subject(listed, "SUBJECT_ID", "ITEMID")


@query
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = counts.describe_columns(roles.table(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"])
    return summary.select("column_name", "n", *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "min", "max")])


@query
def top_k_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.top_k_counts(roles.labs(spark, sf_dir), "SUBJECT_ID", 10)


@query
def union_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    admissions = roles.admissions(spark, sf_dir)
    union = counts.union_codes(
        {
            "type": admissions.select("SUBJECT_ID", F.col("ADMISSION_TYPE").alias("XCODE")),
            "diagnosis": admissions.select("SUBJECT_ID", F.col("DIAGNOSIS").alias("XCODE")),
        }
    )
    return counts.count_by(union, "SUBJECT_ID", "XCODE")


# features and models

VOCABULARY = [f"lab:{c}" for c in roles.MARKERS] + [f"icd:{c}" for c in roles.CHAPTERS]


def _training_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labs = filters.codes_in_set(filters.flagged_any(roles.labs(spark, sf_dir)), roles.MARKERS, "ITEMID")
    return counts.union_codes(
        {
            "lab": labs.select("SUBJECT_ID", F.col("ITEMID").alias("XCODE")),
            "icd": _titled(spark, sf_dir).select("SUBJECT_ID", F.col("CHAPTER").alias("XCODE")),
        }
    )


@query
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with counts of flagged listed labs and of titled diagnoses, one-hot counts and the label."""
    return mortality.training_rows(
        roles.patients(spark, sf_dir),
        roles.with_outcome(roles.admissions(spark, sf_dir)).drop("ADMITTIME", "DEATHTIME"),
        _training_codes(spark, sf_dir),
        VOCABULARY,
        {"GENDER": roles.SEGMENTS},
        {"ADMISSION_TYPE": roles.PRIORITIES},
    )


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.training_vectors(
        roles.patients(spark, sf_dir),
        roles.with_outcome(roles.admissions(spark, sf_dir)),
        _training_codes(spark, sf_dir),
        ["GENDER"],
        ["ADMISSION_TYPE"],
        ["COST"],
    )


@query
def training_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features as sparse vectors, back in one column per value."""
    cells = features_in_order()
    vector = vector_to_array("features")
    return _vectors(spark, sf_dir).select("HADM_ID", "LABEL", *[vector[i].alias(c) for i, c in enumerate(cells)])


def features_in_order() -> list[str]:
    """The cells of the training vectors, in the text order of their codes; listed codes that never occur have none."""
    counted = [f"lab:{c}" for c in roles.MARKERS if c != "refund"] + [f"icd:{c}" for c in roles.CHAPTERS]
    counted += [f"GENDER:{v}" for v in roles.SEGMENTS] + [f"ADMISSION_TYPE:{v}" for v in roles.PRIORITIES]
    return [*sorted(counted), "COST"]


@query
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = list(roles.MARKERS)
    vectors = features.code_vectors(roles.labs(spark, sf_dir), "SUBJECT_ID", "ITEMID", codes)
    cell = vector_to_array("features")
    return vectors.select("SUBJECT_ID", *[cell[i].alias(f"f_{c}") for i, c in enumerate(codes)])


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = counts.count_matrix(roles.labs(spark, sf_dir), "SUBJECT_ID", "ITEMID", roles.EVENT_TYPES)
    vectors = features.assemble(matrix, ["SUBJECT_ID"], invalid="error").select("SUBJECT_ID", "features")
    return features.scale(materialize(vectors))


@query
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = vector_to_array("scaledFeatures")
    scaled = _scaled(spark, sf_dir)
    return scaled.select(
        "SUBJECT_ID", *[F.round(cell[i], 6).alias(f"s_{c}") for i, c in enumerate(roles.EVENT_TYPES)]
    )


@query
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By subject: the counts of a subject are the same in all of its rows, so they must not stand on both sides."""
    marked = features.with_split(roles.admissions(spark, sf_dir), "SUBJECT_ID")
    return marked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("SUBJECT_ID").alias("key_sum"))


@query
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _scaled(spark, sf_dir)
    return models.fit_kmeans(scaled, 3).transform(scaled).select("SUBJECT_ID", F.col("prediction").alias("cluster"))


@query
def kmeans_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _scaled(spark, sf_dir)
    costs = [models.kmeans_cost(models.fit_kmeans(scaled, k), scaled).withColumn("k", F.lit(k)) for k in (2, 3)]
    return reduce(DataFrame.unionByName, costs).select("k", F.round("cost", 6).alias("cost"))


@query
def kmeans_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = models.k_sweep(_scaled(spark, sf_dir), range(2, 9))
    return spark.createDataFrame(costs, "k int, cost double")


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(_vectors(spark, sf_dir).select("SUBJECT_ID", "HADM_ID", "LABEL", "features"))


@query
def mortality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model fitted on the training part, test part scored."""
    train, test = features.hash_split(_model_rows(spark, sf_dir), "SUBJECT_ID")
    return models.score(models.fit_logistic(train), test, ["HADM_ID", "LABEL"])


@query
def model_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve on the test part, by score and by hard class."""
    train, test = features.hash_split(_model_rows(spark, sf_dir), "SUBJECT_ID")
    scored = materialize(models.fit_logistic(train).transform(test).select("LABEL", "rawPrediction", "prediction"))
    areas = [(by, models.area_under_roc(scored, by=by)) for by in ("rawPrediction", "prediction")]
    return spark.createDataFrame(areas, "ranked_by string, area_under_roc double")


@query
def score_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve of a column: the cost of an admission as the score of its outcome."""
    rows = roles.with_outcome(roles.admissions(spark, sf_dir))
    scored = rows.select("COST", columns.label_from_target(F.col("TARGET")).alias("LABEL"))
    area = models.area_under_roc(scored, by="COST")
    return spark.createDataFrame([(round(area, 9),)], "area_under_roc double")


@query
def kmeans_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What defines a clustering, row by row: no other centre is nearer than the subject's, and a centre is the mean of its
    subjects (of a fit that ran until nothing moved)."""
    scaled = _scaled(spark, sf_dir)
    model = models.kmeans(3).setMaxIter(200).setTol(0.0).fit(scaled)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    point = vector_to_array("scaledFeatures")
    gap = lambda c: F.aggregate(F.zip_with(point, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, d: t + d)
    rows = model.transform(scaled).select(
        "SUBJECT_ID", "prediction", point.alias("point"), F.transform(centres, gap).alias("gaps")
    )
    means = rows.groupBy("prediction").agg(F.array(*[F.avg(F.col("point")[i]) for i in range(len(roles.EVENT_TYPES))]).alias("mean"))
    off = F.aggregate(
        F.zip_with("mean", F.get(centres, F.col("prediction")), lambda m, c: F.abs(m - c)), F.lit(0.0), lambda t, d: t + d
    )
    checked = rows.join(F.broadcast(means.select("prediction", (off < 1e-6).alias("central"))), "prediction")
    nearest = F.get(F.col("gaps"), F.col("prediction")) <= F.array_min("gaps") + 1e-9
    return checked.select("SUBJECT_ID", nearest.alias("nearest"), "central")


@query
def logistic_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What defines the fit: over all rows, residuals are orthogonal to each feature; and each row's probability is the
    logistic function of its features and the coefficients, its class the likelier one."""
    rows = _model_rows(spark, sf_dir)
    model = models.logistic().setTol(1e-12).setMaxIter(500).fit(rows)
    weights = F.array(*[F.lit(float(x)) for x in model.coefficients])
    cells = vector_to_array("features")
    margin = F.aggregate(F.zip_with(cells, weights, lambda x, w: x * w), F.lit(float(model.intercept)), lambda t, d: t + d)
    chance = vector_to_array("probability")[1]
    scored = model.transform(rows).select(
        "HADM_ID", "LABEL", "prediction", chance.alias("chance"), (1 / (1 + F.exp(-margin))).alias("own"), cells.alias("cells")
    )
    width = len(features_in_order())
    slopes = scored.agg(
        *[F.sum((F.col("LABEL") - F.col("chance")) * F.col("cells")[i]).alias(f"s{i}") for i in range(width)],
        *[F.sum(F.abs(F.col("cells")[i])).alias(f"t{i}") for i in range(width)],
    ).first()
    flat = all(abs(slopes[f"s{i}"]) <= 1e-4 * slopes[f"t{i}"] for i in range(width))
    return scored.select(
        "HADM_ID",
        (F.abs(F.col("chance") - F.col("own")) < 1e-9).alias("by_coefficients"),
        ((F.col("prediction") == 1) == (F.col("chance") > 0.5)).alias("likelier_class"),
        F.lit(flat).alias("at_optimum"),
    )


@query
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of label and prediction over the scored training rows."""
    train, _ = features.hash_split(_model_rows(spark, sf_dir), "SUBJECT_ID")
    predictions = models.training_predictions(models.fit_logistic(train))
    return counts.describe_columns(predictions, ["LABEL", "prediction"])


@query
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model fitted on all rows, all rows scored."""
    rows = _model_rows(spark, sf_dir)
    return models.score(models.fit_logistic(rows), rows, ["HADM_ID", "LABEL"])


@query
def stages_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembler, scaler and clustering fitted as one chain."""
    matrix = materialize(
        counts.count_matrix(roles.labs(spark, sf_dir), "SUBJECT_ID", "ITEMID", roles.EVENT_TYPES)
    )
    stages = [
        features.assembler(roles.EVENT_TYPES),
        features.scaler(),
        models.kmeans(3),
    ]
    clustered = models.fit_stages(matrix, stages).transform(matrix)
    return clustered.select("SUBJECT_ID", F.col("prediction").alias("cluster"))
