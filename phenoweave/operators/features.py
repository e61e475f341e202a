"""Feature shaping and the sparse person x feature matrix.

The matrix is kept as entries ``eid, featureName, value``; vectors are built
only where a Spark ML estimator asks for them.
"""

from __future__ import annotations

import uuid

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from phenoweave.functions.names import PERSON
from phenoweave.operators.numbering import number_rows
from phenoweave.operators.setops import bag_union
from phenoweave.operators.sizing import measured
from phenoweave.session import cut_lineage, ensure_checkpoint_dir, stored

# Fixed values.
TOP_MEDICATIONS = 500
VARIANCE_SHARE = 0.9995
MODEL_CATEGORIES = ("CANCER", "NonCancerIllness", "Medication")


def categorical_rows(tall: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows whose name is no base field of the dictionary."""
    return tall.join(measured(fields.select(F.col("field").alias("featureName"))), "featureName", "left_anti")


def numeric_rows(tall: DataFrame, fields: DataFrame) -> DataFrame:
    return tall.join(measured(fields.select(F.col("field").alias("featureName"))), "featureName", "left_semi")


def person_means(tall: DataFrame, fields: DataFrame) -> DataFrame:
    """Numeric features averaged per person, categorical rows as they are; the input is evaluated once."""
    known = measured(fields.select(F.col("field").alias("featureName")).distinct().withColumn("_numeric", F.lit(True)))
    columns = [PERSON, "category", "featureName", "featureValue"]
    told = stored(tall.join(known, "featureName", "left").select(*columns, "_numeric"), "told-apart")
    means = (
        told.where("_numeric")
        .groupBy(PERSON, "category", "featureName")
        .agg(F.avg("featureValue").alias("featureValue"))
    )
    return bag_union(told.where("_numeric IS NULL").select(*columns), means.select(*columns))


def keep_most_common(tall: DataFrame, n: int = TOP_MEDICATIONS) -> DataFrame:
    """All rows of the ``n`` most frequent features; ties by name."""
    common = (
        tall.groupBy("featureName")
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "featureName")
        .limit(n)
        .select("featureName")
    )
    # n rows at most, whatever the table's size
    return tall.join(F.broadcast(common), "featureName", "left_semi").select(*tall.columns)


def model_features(
    tall: DataFrame,
    fields: DataFrame,
    medication: str = "Medication",
    person_mean_categories: tuple[str, ...] = ("Demographic", "Lifestyle", "PhysicalMeasure"),
    n: int = TOP_MEDICATIONS,
) -> DataFrame:
    """Rows for the matrix: common medications, coded diseases whole, numeric measures averaged; the input is evaluated once."""
    columns = [PERSON, "category", "featureName", "featureValue"]
    tall = stored(tall.select(*columns), "model-rows")
    category = F.col("category")
    averaged = category.isin(*person_mean_categories)
    return bag_union(
        keep_most_common(tall.where(category == medication), n).select(*columns),
        tall.where((category != medication) & ~averaged).select(*columns),
        person_means(tall.where(averaged), fields),
    )


def matrix_entries(tall: DataFrame, categories: tuple[str, ...] | None = MODEL_CATEGORIES) -> DataFrame:
    """One entry per person and feature, the largest value where rows repeat."""
    chosen = tall.where(F.col("category").isin(*categories)) if categories else tall
    return chosen.groupBy(PERSON, "featureName").agg(F.max("featureValue").alias("value"))


def feature_index(entries: DataFrame) -> DataFrame:
    """Features numbered 0, 1, ... by name."""
    names = entries.select("featureName").distinct()
    return number_rows(names, [F.col("featureName")], "feature")


def indexed_entries(entries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    if index is None:
        entries = stored(entries.select(PERSON, "featureName", "value"), "entries")  # numbered first, joined then
        index = feature_index(entries)
    index = measured(index)
    return entries.join(index, "featureName").select(PERSON, "feature", "value")


def feature_frequency(entries: DataFrame) -> DataFrame:
    """Column sums of the matrix."""
    return entries.groupBy("featureName").agg(F.sum("value").alias("frequency"))


def feature_variances(entries: DataFrame) -> DataFrame:
    """Population variance of every column, absent entries counted as zero."""
    persons = entries.agg(F.countDistinct(PERSON)).scalar().cast("double")
    sums = entries.groupBy("featureName").agg(
        F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2")
    )
    mean = F.col("s1") / persons
    return sums.select("featureName", (F.col("s2") / persons - mean * mean).alias("variance"))


def selected_features(entries: DataFrame, p: float = VARIANCE_SHARE) -> DataFrame:
    """Features whose variance exceeds that of a binary one held with share ``p``."""
    return feature_variances(entries).where(F.col("variance") > F.lit(p * (1 - p)))


def variance_select(entries: DataFrame, p: float = VARIANCE_SHARE) -> DataFrame:
    """The matrix without its near-constant columns; entries keep their names."""
    entries = cut_lineage(entries)  # read three times from here
    kept = measured(selected_features(entries, p).select("featureName"))
    return entries.join(kept, "featureName", "left_semi").select(*entries.columns)


def to_vectors(entries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``eid, features`` with sparse vectors for Spark ML.

    The vector's parts are written to the shared folder and read back as a
    vector column: no dense row, no Python, and the estimator's many passes
    start from storage.
    """
    spark = entries.sparkSession
    if index is None:
        entries = stored(entries.select(PERSON, "featureName", "value"), "entries")
        index = feature_index(entries)
    size = index.count()
    pairs = indexed_entries(entries, index).groupBy(PERSON).agg(
        F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("p")  # at most `size` pairs
    )
    parts = pairs.select(
        PERSON,
        F.struct(
            F.lit(0).cast("byte").alias("type"),
            F.lit(size).alias("size"),
            F.transform("p", lambda x: x["feature"].cast("int")).alias("indices"),
            F.transform("p", lambda x: x["value"]).alias("values"),
        ).alias("features"),
    )
    path = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    parts.write.parquet(path)
    schema = T.StructType([T.StructField(PERSON, T.StringType()), T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)
