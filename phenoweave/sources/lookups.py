"""Dictionary, category map, code hierarchy, meanings and trait scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave.functions.names import PERSON, base_field, is_categorical, quoted
from phenoweave.sources.delimited import load_table


def baseline_dictionary(rows: DataFrame) -> DataFrame:
    """Baseline rows of a raw dictionary, typed, with blank types filled in.

    A blank ``Type`` takes the type stated for another column of the same field.
    """
    kept = rows.where("UDI LIKE '%-0.%' OR UDI = 'eid'").select(
        F.expr("try_cast(Colnum AS int)").alias("Colnum"),
        F.coalesce("UDI", F.lit("")).alias("UDI"),
        F.expr("try_cast(`Count` AS int)").alias("Count"),
        F.nullif(F.trim("Type"), F.lit("")).alias("stated"),
        F.coalesce("Description", F.lit("")).alias("Description"),
        base_field("UDI").alias("field"),
    )
    types = kept.groupBy("field").agg(F.max("stated").alias("Type"))
    return kept.join(types, "field").select(
        "Colnum", "UDI", "Count", F.coalesce("Type", F.lit("")).alias("Type"), "Description"
    )


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return baseline_dictionary(load_table(spark, path))


def field_types(dictionary: DataFrame) -> DataFrame:
    """One row per field of the dictionary: ``field, featureType``."""
    return dictionary.groupBy(base_field("UDI").alias("field")).agg(F.max("Type").alias("featureType"))


def dictionary_fields(dictionary: DataFrame) -> DataFrame:
    """Distinct base fields of the dictionary."""
    return dictionary.select(base_field("UDI").alias("field")).distinct()


def category_fields(category_map: DataFrame) -> DataFrame:
    """Category map (one column per category) as rows ``category, field``."""
    columns = category_map.columns
    return (
        category_map.unpivot([], [quoted(c) for c in columns], "category", "field")
        .where(F.col("field").isNotNull())
        .distinct()
    )


def field_partition(categories: DataFrame, types: DataFrame) -> DataFrame:
    """Fields of each category split by type: ``category, field, categorical``."""
    return categories.join(types, "field").select(
        "category", "field", is_categorical("featureType").alias("categorical")
    )


def load_hierarchy(spark: SparkSession, path: str, name: str = "coding") -> DataFrame:
    """Code tree: ``coding, node_id, parent_id, selectable``."""
    table = load_table(spark, path, name, "\t")
    return table.select("coding", "node_id", "parent_id", "selectable")


def load_meanings(spark: SparkSession, path: str, key: str = "coding") -> DataFrame:
    """Decode table ``code, meaning``, keyed by ``coding`` or ``node_id``."""
    return load_table(spark, path, delimiter="\t").select(F.col(key).alias("code"), "meaning")


def load_trait_scores(spark: SparkSession, path: str, key: str = "Indiv") -> DataFrame:
    """Person key and one double per trait."""
    table = load_table(spark, path, delimiter="\t")
    return table.select(
        F.col(key),
        *[quoted(c).try_cast("double").alias(c) for c in table.columns if c != key],
    )


__all__ = [
    "PERSON",
    "baseline_dictionary",
    "category_fields",
    "dictionary_fields",
    "field_partition",
    "field_types",
    "load_dictionary",
    "load_hierarchy",
    "load_meanings",
    "load_trait_scores",
]
