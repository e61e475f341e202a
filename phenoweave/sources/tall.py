"""Long tables ``eid, featureName, featureValue`` and result tables on storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TALL_SCHEMA = "eid string, featureName string, featureValue double"


def read_tall_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(TALL_SCHEMA).csv(path)


def write_tall_csv(tall: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header and rows, as many part files as there are partitions."""
    tall.select("eid", "featureName", "featureValue").write.mode(mode).option("header", True).csv(path)


def write_tall(tall: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, one folder per category, so a category is read without the others."""
    tall.write.mode(mode).partitionBy("category").parquet(path)


def write_tall_table(tall: DataFrame, name: str, path: str, buckets: int, mode: str = "errorifexists") -> None:
    """As a table bucketed by person: joins and groupings by ``eid`` then need no shuffle.

    For long tables that many later stages join; choose ``buckets`` so that one
    holds a few hundred megabytes.
    """
    writer = tall.repartition(buckets, "eid").write.mode(mode).option("path", path)
    writer.bucketBy(buckets, "eid").sortBy("eid").saveAsTable(name)


def read_tall(spark: SparkSession, path: str, *categories: str) -> DataFrame:
    table = spark.read.schema(TALL_SCHEMA + ", category string").parquet(path)
    return table.where(table.category.isin(*categories)) if categories else table


def write_result(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result table as delimited text with a header."""
    result.write.mode(mode).option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a finished output on the file system it names."""
    try:
        spark.read.format("binaryFile").load(path.rstrip("/") + "/_SUCCESS")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def _holds(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(TALL_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def stage(spark: SparkSession, path: str, build, categories: tuple[str, ...] = ()) -> DataFrame:
    """The long table at ``path``, built by ``build()`` when it, or one of ``categories`` in it, is missing."""
    if not (exists(spark, path) and all(_holds(spark, f"{path.rstrip('/')}/category={c}") for c in categories)):
        write_tall(build(), path, mode="overwrite")
    return read_tall(spark, path)
