"""Descriptive statistics, every category in the same pass."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from phenoweave.functions.names import PERSON
from phenoweave.operators.setops import bag_union
from phenoweave.session import cut_lineage

RARE_SHARE = 0.01
#: The rows of about so many persons are told apart by one task.
PERSONS_PER_TASK = 10_000


def population(raw: DataFrame) -> DataFrame:
    """Number of distinct persons."""
    return raw.agg(F.countDistinct(PERSON).alias("population"))


def dealt(tall: DataFrame, persons: int) -> DataFrame:
    """Rows of one feature and person together, in as many parts as ``persons`` ask for.

    Most rows have a feature and person of their own, so combining them before
    the shuffle saves little and holds all groups of a mapper; dealt out first,
    a task holds a bounded share of them, however large the table is.
    """
    parts = max(tall.sparkSession.sparkContext.defaultParallelism, math.ceil(persons / PERSONS_PER_TASK))
    return tall.select("category", "featureName", PERSON).repartition(parts, "category", "featureName", PERSON)


def feature_summary(tall: DataFrame, persons: int = 0) -> DataFrame:
    """``category, featureName, rows, persons``; the base of all the counts below.

    Grouping by person first spreads a feature that most of the ``persons``,
    if that many are known of, hold over all tasks.
    """
    return (
        dealt(tall, persons).groupBy("category", "featureName", PERSON)
        .agg(F.count("*").alias("n"))
        .groupBy("category", "featureName")
        .agg(F.sum("n").alias("rows"), F.count("*").alias("persons"))
    )


def unique_features(tall: DataFrame) -> DataFrame:
    return (
        tall.select("category", "featureName")
        .distinct()
        .groupBy("category")
        .agg(F.count("*").alias("features"))
    )


def top_features(tall: DataFrame, n: int = 5, by: str = "category") -> DataFrame:
    """The ``n`` most frequent features of each group by row count; ties by name."""
    counts = tall.groupBy(by, "featureName").agg(F.count("*").alias("rows"))
    return rank_counts(counts, by, n)


def rank_counts(counts: DataFrame, by: str, n: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("rows"), "featureName")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def percent_negative(tall: DataFrame) -> DataFrame:
    """Share of negative values; meant for rows before the positive filter."""
    return tall.groupBy("category").agg(
        (F.avg((F.col("featureValue") < 0).cast("double")) * 100).alias("pct_negative")
    )


def percent_rare(tall: DataFrame, raw: DataFrame, threshold: float = RARE_SHARE) -> DataFrame:
    """Share of a category's features held by fewer than ``threshold`` of all persons."""
    every = population(raw).first()[0]
    holders = dealt(tall, every).distinct()
    persons = holders.groupBy("category", "featureName").agg(F.count("*").alias("persons"))
    return _rare(persons, every, threshold)


def _rare(summary: DataFrame, persons: int, threshold: float) -> DataFrame:
    limit = F.lit(persons) * F.lit(threshold)
    return summary.groupBy("category").agg(
        (F.avg((F.col("persons") < limit).cast("double")) * 100).alias("pct_rare")
    )


def statistics_report(
    raw: DataFrame,
    typed: DataFrame,
    tall: DataFrame,
    threshold: float = RARE_SHARE,
    top_n: int = 5,
    top_categories: list[str] | None = None,
) -> DataFrame:
    """All of the above as rows ``metric, category, feature, value``.

    ``typed`` are the long rows before the positive filter, ``tall`` the clean
    ones. The clean table is read once; everything else works on its summary.
    """
    persons = population(raw).first()[0]
    summary = cut_lineage(feature_summary(tall, persons))
    top = rank_counts(summary, "category", top_n)
    if top_categories is not None:
        top = top.where(F.col("category").isin(*top_categories))

    def rows(df, metric, category, feature, value):
        return df.select(
            metric.alias("metric"),
            category.alias("category"),
            feature.alias("feature"),
            value.cast("double").alias("value"),
        )

    none = F.lit(None).cast("string")
    category = F.col("category")
    unique = summary.groupBy("category").agg(F.count("*").alias("features"))
    return bag_union(
        rows(population(raw), F.lit("population"), none, none, F.col("population")),
        rows(unique, F.lit("unique_features"), category, none, F.col("features")),
        rows(
            top,
            F.concat(F.lit("top_"), F.col("rank").cast("string")),
            category,
            F.col("featureName"),
            F.col("rows"),
        ),
        rows(percent_negative(typed), F.lit("pct_negative"), category, none, F.col("pct_negative")),
        rows(_rare(summary, persons, threshold), F.lit("pct_rare"), category, none, F.col("pct_rare")),
    )
