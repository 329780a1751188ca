"""Feature columns, vectors, scaling and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortloom.functions.names import free_name
from cohortloom.operators.ranking import numbered
from cohortloom.session import broadcast_rows, materialize, scratch_path

#: Distinct codes that are numbered in the driver; more are numbered where they are.
DRIVER_CODES = 10_000


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Choose columns and name them: ``{"o_custkey": "SUBJECT_ID"}``."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def project_except(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """All columns but the excluded ones."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in set(excluded)])


def project_fixed(df: DataFrame, base: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """The base columns and a fixed list of count columns; counts that the table lacks are zeros."""
    present = set(df.columns)
    return df.select(
        *base,
        *[F.col(f"`{c}`") if c in present else F.lit(0).cast("bigint").alias(c) for c in counts],
    )


def feature_columns(df: DataFrame, excluded: Sequence[str], label: str = "LABEL") -> list[str]:
    """Columns that may serve as features: all but the excluded ones and, always, the label."""
    return [c for c in df.columns if c not in {*excluded, label}]


def assembler(columns: Sequence[str], output: str = "features", invalid: str = "error") -> VectorAssembler:
    """Assembler of number columns into one vector; ``invalid`` says what a null does (error, skip or keep)."""
    return VectorAssembler(
        inputCols=[f"`{c}`" if "." in c else c for c in columns], outputCol=output, handleInvalid=invalid
    )


def assemble(
    df: DataFrame,
    excluded: Sequence[str],
    label: str = "LABEL",
    output: str = "features",
    fill: float | None = None,
    invalid: str = "keep",
) -> DataFrame:
    """Add a vector of all feature columns, nulls replaced by ``fill`` first if one is given."""
    columns = feature_columns(df, excluded, label)
    filled = df if fill is None else df.na.fill(fill, columns)
    return assembler(columns, output, invalid).transform(filled)


def positions(events: DataFrame, code: str) -> DataFrame:
    """``code, position``: the distinct codes numbered in text order.

    Few codes are numbered in the driver, whose table is then known to be small; more of them over ranges of the order, so that a
    vocabulary of free texts is never in one task.
    """
    codes = events.select(F.col(code).cast("string").alias(code)).where(F.col(code).isNotNull()).distinct()
    few = codes.limit(DRIVER_CODES + 1).collect()
    if len(few) > DRIVER_CODES:
        return numbered(codes, code)
    # UTF-8 bytes, the order of texts in Spark, sort as code points do
    ordered = sorted(r[0] for r in few)
    return events.sparkSession.createDataFrame([(c, i) for i, c in enumerate(ordered)], f"`{code}` string, position bigint")


def sparse_vectors(
    cells: DataFrame, key: str, size: int, output: str = "features", beside: DataFrame | None = None
) -> DataFrame:
    """One sparse vector per key from ``key, _position, _n`` (one cell for each position), written out, after the columns that
    ``beside`` has for its keys.

    A struct of a vector's layout can't be cast to one, but reads back as one from a Parquet file of it.
    """
    spark, path = cells.sparkSession, scratch_path(cells.sparkSession, "vectors")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_position").cast("int").alias("p"), F.col("_n").cast("double").alias("n"))))
    gathered = cells.groupBy(key).agg(ordered.alias("_cells"))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).cast("int").alias("size"),
        F.col("_cells.p").alias("indices"),
        F.col("_cells.n").alias("values"),
    )
    if beside is not None:
        gathered = beside.join(gathered, key)
    rows = gathered.withColumn(output, vector).drop("_cells")
    rows.write.parquet(path)
    return spark.read.schema(T.StructType([*rows.schema.fields[:-1], T.StructField(output, VectorUDT())])).parquet(path)


def code_vectors(
    events: DataFrame,
    key: str,
    code: str,
    vocabulary: Sequence[str] | DataFrame,
    output: str = "features",
    counted: str | None = None,
    beside: DataFrame | None = None,
) -> DataFrame:
    """One sparse count vector per key; position i counts ``vocabulary[i]``, or the code that a table ``code, position`` has.

    Unlisted codes, and keys with no listed code, drop out. Values never become column names, so the width is free
    of the limits of a dense table. What is gathered per key is one (position, count) pair per distinct code. ``counted`` names
    the column of a table that holds counts of codes instead of events; ``beside`` has columns for the keys, of which only those it
    knows are kept then.
    """
    spark = events.sparkSession
    if isinstance(vocabulary, DataFrame):
        listed = vocabulary.select(F.col(code).cast("string").alias(code), F.col("position").alias("_position"))
        size, rows = listed.agg(F.coalesce(F.max("_position") + 1, F.lit(0)), F.count(F.lit(1))).first()
    else:
        listed = spark.createDataFrame([(str(c), i) for i, c in enumerate(vocabulary)], f"{code} string, _position int")
        size = rows = len(vocabulary)
    amount = F.count(F.lit(1)) if counted is None else F.sum(counted)
    cells = (
        events.select(key, F.col(code).cast("string").alias(code), *([] if counted is None else [counted]))
        .join(broadcast_rows(listed, rows), code)
        .groupBy(key, "_position")
        .agg(amount.alias("_n"))
    )
    return sparse_vectors(cells, key, size, output, beside)


def _hash_of(code: Column) -> Column:
    """A whole number of 60 bits that follows from the text."""
    return F.conv(F.substring(F.md5(code.cast("string")), 1, 15), 16, 10).cast("bigint")


def hash_position(code: Column, width: int) -> Column:
    """The position of a code in vectors of a fixed width."""
    return (_hash_of(code) % width).cast("int")


def hash_sign(code: Column) -> Column:
    """1 or -1, by another part of the hash: what two codes at one position add to products cancels out on average."""
    return F.when(F.conv(F.substring(F.md5(code.cast("string")), 16, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def hashed_vectors(events: DataFrame, key: str, code: str, width: int, output: str = "features") -> DataFrame:
    """One sparse vector per key of signed counts of hashed codes: no vocabulary is built, whatever the codes are.

    Events without a code drop out; a position where codes cancel out is a cell of 0.
    """
    marked = events.where(F.col(code).isNotNull()).select(
        key, hash_position(F.col(code), width).alias("_position"), hash_sign(F.col(code)).alias("_sign")
    )
    return sparse_vectors(marked.groupBy(key, "_position").agg(F.sum("_sign").alias("_n")), key, width, output)


def hash_collisions(events: DataFrame, code: str, width: int) -> DataFrame:
    """``position, n_codes, first_code, last_code, n_events``: positions that several codes share, and how many."""
    counted = events.where(F.col(code).isNotNull()).groupBy(F.col(code).cast("string").alias("_code")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        counted.groupBy(hash_position(F.col("_code"), width).alias("position"))
        .agg(
            F.count(F.lit(1)).alias("n_codes"),
            F.min("_code").alias("first_code"),
            F.max("_code").alias("last_code"),
            F.sum("_n").alias("n_events"),
        )
        .where(F.col("n_codes") > 1)
    )


def scaler(features: str = "features", output: str = "scaledFeatures") -> StandardScaler:
    """Scaler to unit sample standard deviation, without centring (sparse vectors stay sparse)."""
    return StandardScaler(inputCol=features, outputCol=output, withStd=True, withMean=False)


def vector_summary(df: DataFrame, features: str = "features") -> DataFrame:
    """``position, mean, stddev, n_nonzero`` of each position of a vector column, by one aggregation without a column per position.

    The standard deviation is the sample's, as the scaler takes it. What is held per task is a few numbers per position.
    """
    wanted = Summarizer.metrics("mean", "std", "numNonZeros")
    row = df.select(wanted.summary(F.col(features)).alias("s"))
    arrays = [vector_to_array(F.col(f"s.{c}")) for c in ("mean", "std", "numNonZeros")]
    return row.select(F.posexplode(F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, ("mean", "stddev", "n"))])).alias("position", "c")).select(
        "position", F.col("c.mean").alias("mean"), F.col("c.stddev").alias("stddev"), F.col("c.n").cast("bigint").alias("n_nonzero")
    )


def scale(df: DataFrame, features: str = "features", output: str = "scaledFeatures") -> DataFrame:
    return scaler(features, output).fit(df).transform(df)


def with_split(df: DataFrame, key: str, train_tenths: int = 7, part: str = "part") -> DataFrame:
    """Mark each row 'train' or 'test' by a hash of its key: the same row always lands in the same part, whatever
    the partitioning."""
    tenth = F.pmod(F.xxhash64(key), F.lit(10))
    return df.withColumn(part, F.when(tenth < train_tenths, "train").otherwise("test"))


def hash_split(df: DataFrame, key: str, train_tenths: int = 7) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, key, train_tenths, "_part")
    return tuple(marked.where(F.col("_part") == p).drop("_part") for p in ("train", "test"))


def random_split(df: DataFrame, train: float = 0.7, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Spark's random split with a seed; it repeats only while the partitioning of the rows does."""
    first, second = df.randomSplit([train, 1 - train], seed)
    return first, second


#: Bits of the hash of a key, and bits that one round of the search for its threshold settles.
_HASH_BITS, _ROUND_BITS = 60, 12


def split_thresholds(subjects: DataFrame, share: float) -> DataFrame:
    """``_label_of, n_train, _bound, _rest``: for each label, how many of its subjects are wanted, and the hash up to which they are
    taken (with so many of those that have this very hash). A label of which none are wanted has no row.

    ``subjects`` has ``_label`` and ``_hash``. The bound is found from its high bits down: each round counts, of the subjects that
    agree with it so far, how many have which next bits. A label's subjects are never sorted; what a round brings together for a label is a
    histogram.
    """
    wanted = F.floor(F.count(F.lit(1)) * F.lit(share)).alias("n_train")
    state = subjects.groupBy(F.col("_label").alias("_label_of")).agg(wanted)
    state = state.withColumns({"_bound": F.lit(0).cast("bigint"), "_rest": F.col("n_train")}).where("_rest > 0")
    for shift in range(_HASH_BITS - _ROUND_BITS, -1, -_ROUND_BITS):
        known = materialize(state)
        agrees = F.col("_label").eqNullSafe(F.col("_label_of")) & (F.shiftright("_hash", shift + _ROUND_BITS) == F.col("_bound"))
        met = subjects.select("_label", "_hash").join(broadcast_rows(known, known.count()), agrees)
        groups = ["_label_of", "n_train", "_rest"]
        counts = met.groupBy(*groups, F.shiftright("_hash", shift).alias("_next")).agg(F.count(F.lit(1)).alias("_n"))
        upto = Window.partitionBy(*groups).orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_n").over(upto))
        state = counts.where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_n") < F.col("_rest"))).select(
            "_label_of", "n_train", F.col("_next").alias("_bound"), (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest")
        )
    return materialize(state)


def exact_split(df: DataFrame, key: str, share: float = 0.7, label: str | None = None, part: str = "part") -> DataFrame:
    """Mark each row 'train' or 'test' so that exactly the given share of the keys (rounded down) is in the training part, or,
    with a ``label``, exactly that share of the keys of each label; a key's label is its greatest.

    Keys go by a hash, equal hashes by the key, so the split doesn't depend on the partitioning. A null key is a key like others.
    """
    stratum = F.lit("") if label is None else F.max(label)
    keys = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"), stratum.alias("_label"))
    keys = materialize(keys.withColumn("_hash", F.coalesce(_hash_of(F.col("_key")), F.lit(0))))
    bounds = split_thresholds(keys, share)
    marked = keys.join(broadcast_rows(bounds, bounds.count()), F.col("_label").eqNullSafe(F.col("_label_of")))
    place = F.row_number().over(Window.partitionBy("_label_of", "_hash").orderBy("_key"))
    tied = marked.where(F.col("_hash") == F.col("_bound")).withColumn("_place", place).where(F.col("_place") <= F.col("_rest"))
    taken = marked.where(F.col("_hash") < F.col("_bound")).select("_key").unionByName(tied.select("_key"))
    own, mark = free_name(df.columns, "_key"), free_name(df.columns, "_chosen")
    chosen = materialize(taken.select(F.col("_key").alias(own), F.lit(True).alias(mark)))
    rows = df.join(chosen, F.col(key).eqNullSafe(F.col(own)), "left")
    return rows.withColumn(part, F.when(F.col(mark), "train").otherwise("test")).drop(own, mark)
