"""Clustering and outcome models on Spark ML, all with explicit seeds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.ranking import running_totals
from cohortloom.session import materialize

SEED = 17


def kmeans(k: int, features: str = "scaledFeatures", seed: int = SEED) -> KMeans:
    return KMeans(featuresCol=features, k=k, seed=seed)


def fit_kmeans(df: DataFrame, k: int, features: str = "scaledFeatures", seed: int = SEED) -> KMeansModel:
    return kmeans(k, features, seed).fit(df)


def kmeans_cost(model: KMeansModel, df: DataFrame, features: str = "scaledFeatures", name: str = "cost") -> DataFrame:
    """Sum of squared distances of the rows to the centres they are assigned to, on any data.

    Spelt out as the squares of the cells, less twice the cells times their centre's, plus the centre's squares for each row:
    cells are summed up by cluster and position before they meet the table of centres, so the plan does not grow with the
    width. A row without any cell of its own is counted at position -1.
    """
    spark, cluster = df.sparkSession, model.getPredictionCol()
    centres = [(k, i, float(x)) for k, c in enumerate(model.clusterCenters()) for i, x in enumerate(c) if x]
    centres = spark.createDataFrame(centres, f"{cluster} int, position int, centre double")
    cells = model.transform(df).select(cluster, F.explode(_cells(features)).alias("cell"))
    sums = cells.groupBy(cluster, F.col("cell.position").alias("position")).agg(
        F.sum("cell.value").alias("total"), F.sum(F.col("cell.value") * F.col("cell.value")).alias("squares")
    )
    sums = materialize(sums)  # read four times below, and no more than clusters times width
    crossed = sums.join(centres, [cluster, "position"], "left").select(
        cluster, (F.col("squares") - 2 * F.col("total") * F.coalesce("centre", F.lit(0.0))).alias("part")
    )
    rows = sums.where("position = -1").select(cluster, F.col("total").alias("n"))
    norms = centres.groupBy(cluster).agg(F.sum(F.col("centre") * F.col("centre")).alias("norm"))
    offsets = rows.join(norms, cluster).select(cluster, (F.col("n") * F.col("norm") - F.col("n")).alias("part"))
    bare = rows.join(norms, cluster, "left_anti").select(cluster, (-F.col("n")).alias("part"))
    return crossed.unionByName(offsets).unionByName(bare).agg(F.sum("part").alias(name))


def _cells(features: str) -> Column:
    """The nonzero cells of a vector as (position, value), and one of value 1 at position -1."""
    values = F.transform(
        vector_to_array(features), lambda x, i: F.struct(i.alias("position"), x.alias("value"))
    )
    row = F.array(F.struct(F.lit(-1).alias("position"), F.lit(1.0).alias("value")))
    return F.concat(row, F.filter(values, lambda c: c["value"] != 0))


def k_sweep(
    df: DataFrame, ks: Iterable[int], features: str = "scaledFeatures", seed: int = SEED, parallelism: int = 4
) -> list[tuple[int, float]]:
    """Training cost for each k. The fits share one cached copy of the vectors and run side by side, since the
    rounds of a single fit are too short to fill a cluster."""
    vectors = df.select(features).persist(StorageLevel.MEMORY_AND_DISK)

    def cost(k: int) -> tuple[int, float]:
        return k, fit_kmeans(vectors, k, features, seed).summary.trainingCost

    try:
        with ThreadPool(parallelism) as pool:
            return pool.map(inheritable_thread_target(df.sparkSession)(cost), list(ks))
    finally:
        vectors.unpersist()


def logistic(label: str = "LABEL", features: str = "features") -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol=features)


def fit_logistic(train: DataFrame, label: str = "LABEL", features: str = "features") -> LogisticRegressionModel:
    return logistic(label, features).fit(train)


def training_predictions(model: LogisticRegressionModel) -> DataFrame:
    """Scored training rows; pass them to ``describe_columns`` for the training summary."""
    return model.summary.predictions


def score(model: LogisticRegressionModel | PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Kept columns, predicted class and probability of class 1."""
    scored = model.transform(df)
    return scored.select(*keep, "prediction", vector_to_array("probability")[1].alias("probability"))


def area_under_roc(scored: DataFrame, label: str = "LABEL", by: str = "rawPrediction") -> float:
    """Area under the ROC curve by score, with a point for every distinct score; ``by="prediction"`` gives that of the hard
    class, and ``by`` may name any column of numbers."""
    return BinaryClassificationEvaluator(rawPredictionCol=by, labelCol=label, numBins=0).evaluate(scored)


def fit_stages(df: DataFrame, stages: Sequence) -> PipelineModel:
    """Fit a chain of feature and model stages as one model."""
    return Pipeline(stages=list(stages)).fit(df)


def _roc_points(scored: DataFrame, label: str, by: str) -> DataFrame:
    """Rows of each distinct score, positive and negative, and those of at least that score."""
    known = scored.where(F.col(label).isNotNull() & F.col(by).isNotNull())
    positive = F.count_if(F.col(label) == 1)
    points = known.groupBy(F.col(by).alias("threshold")).agg(positive.alias("pos"), (F.count(F.lit(1)) - positive).alias("neg"))
    return running_totals(points, [F.desc("threshold")], {"tp": "pos", "fp": "neg"})


def roc_curve(scored: DataFrame, label: str = "LABEL", by: str = "probability") -> DataFrame:
    """``threshold, tpr, fpr``: one point of the ROC curve for each distinct score, of any number.

    The totals run over ranges of scores; no task sees them all. Rows without a label or a score are left out; a rate of a class
    without rows is null.
    """
    points = _roc_points(scored, label, by)
    all_pos, all_neg = points.agg(F.sum("pos"), F.sum("neg")).first()
    rate = lambda n, total: F.col(n) / F.nullif(F.lit(float(total or 0)), F.lit(0.0))
    return points.select("threshold", rate("tp", all_pos).alias("tpr"), rate("fp", all_neg).alias("fpr"))


def roc_area(scored: DataFrame, label: str = "LABEL", by: str = "probability", name: str = "area_under_roc") -> DataFrame:
    """The area under the ROC curve in one row, from whole numbers until the last division; null if a class has no rows."""
    points = _roc_points(scored, label, by)
    # twice the pairs of a positive and a negative in which the positive has the higher score; a tie counts once
    doubled = F.sum(F.col("neg").cast("decimal(18,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(19,0)"))
    pairs = F.nullif(F.sum("pos").cast("double") * F.sum("neg").cast("double"), F.lit(0.0))
    return points.agg((doubled.cast("double") / 2 / pairs).alias(name))


def save_stages(model: PipelineModel, path: str) -> None:
    """Write a fitted chain to storage that every session reaches."""
    model.write().save(path)


def load_stages(spark: SparkSession, path: str) -> PipelineModel:
    """A fitted chain as it was saved, for tables of this session."""
    return PipelineModel.read().session(spark).load(path)
