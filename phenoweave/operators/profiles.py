"""What the persons of a cluster have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from phenoweave.functions.names import PERSON, base_field, code_part
from phenoweave.operators.setops import bag_union
from phenoweave.operators.sizing import measured
from phenoweave.session import cut_lineage

TOP_N = 10  # fixed value of the profile lists
# Categories whose items are named by their code alone.
CODED = ("CANCER", "Medication", "NonCancerIllness")


def with_label(tall: DataFrame, labels: DataFrame) -> DataFrame:
    return tall.join(labels.select(PERSON, "label"), PERSON)


def cluster_summary(tall: DataFrame, labels: DataFrame, fields: DataFrame) -> DataFrame:
    """One pass over the rows: ``label, group, kind, item, rows, mean``.

    ``kind`` is ``code`` (item is the code), ``categorical`` or ``numeric``
    (item is the feature's name). Every list of the profile reads off this
    table, whose size is clusters times vocabulary.
    """
    kind = (
        F.when(F.col("category").isin(*CODED), F.lit("code"))
        .when(F.col("categorical"), F.lit("categorical"))
        .otherwise(F.lit("numeric"))
    )
    known = measured(fields.select("field", F.col("category").alias("group"), kind.alias("kind")).distinct())
    item = F.when(F.col("kind") == "code", code_part("featureName")).otherwise(F.col("featureName"))
    rows = (
        tall.select(PERSON, "featureName", "featureValue", base_field("featureName").alias("field"))
        .join(known, "field")
        .where((F.col("kind") != "numeric") | (F.col("featureName") == F.col("field")))
        .select(PERSON, "group", "kind", item.alias("item"), "featureValue")
    )
    return (
        with_label(rows, labels)
        .groupBy("label", "group", "kind", "item")
        .agg(F.count("*").alias("rows"), F.avg("featureValue").alias("mean"))
    )


def _ranked(summary: DataFrame, kind: str, n: int) -> DataFrame:
    order = Window.partitionBy("label", "group").orderBy(F.desc("rows"), "item")
    return (
        summary.where(F.col("kind") == kind)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("label", "group", "item", "rows", "rank")
    )


def top_codes(tall: DataFrame, labels: DataFrame, fields: DataFrame, n: int = TOP_N) -> DataFrame:
    """Most frequent codes of each cluster and coded category by row count: ``label, group, code, rows, rank``."""
    return _ranked(cluster_summary(tall, labels, fields), "code", n).withColumnRenamed("item", "code")


def top_categorical(tall: DataFrame, labels: DataFrame, fields: DataFrame, n: int = TOP_N) -> DataFrame:
    """Most frequent categorical features of each cluster in the other categories, by full name."""
    return _ranked(cluster_summary(tall, labels, fields), "categorical", n).withColumnRenamed("item", "featureName")


def _means(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("kind") == "numeric").select(
        "label", "group", F.col("item").alias("featureName"), "mean"
    )


def numeric_means(tall: DataFrame, labels: DataFrame, fields: DataFrame) -> DataFrame:
    """Mean of each numeric feature per cluster: ``label, group, featureName, mean``."""
    return _means(cluster_summary(tall, labels, fields))


def cluster_profile(
    tall: DataFrame, labels: DataFrame, fields: DataFrame, n: int = TOP_N, digits: int | None = None
) -> DataFrame:
    """``label, profile``: per cluster a list of (category, items).

    ``fields`` are rows ``category, field, categorical``. Items are codes,
    feature names or ``name:mean``, the mean rounded to ``digits`` if given.
    """
    summary = cut_lineage(cluster_summary(tall, labels, fields))
    mean = F.col("mean") if digits is None else F.round("mean", digits)
    listed = bag_union(
        _ranked(summary, "code", n).select("label", F.col("group").alias("category"), "rank", "item"),
        _ranked(summary, "categorical", n).select(
            "label", F.concat("group", F.lit("(Categorical)")).alias("category"), "rank", "item"
        ),
        _means(summary).select(
            "label",
            F.concat("group", F.lit("(Non-Categorical)")).alias("category"),
            F.lit(0).alias("rank"),
            F.concat_ws(":", "featureName", mean.cast("string")).alias("item"),
        ),
    )
    # A list holds at most n items, or one per numeric field; a cluster has nine lists at most.
    return (
        listed.groupBy("label", "category")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("r"))
        .select("label", "category", F.transform("r", lambda x: x["item"]).alias("items"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("category", "items"))).alias("profile"))
    )


def cluster_percentages(
    tall: DataFrame,
    labels: DataFrame,
    selected: DataFrame,
    meanings: DataFrame,
    matrix_rows: int,
) -> DataFrame:
    """Share of a cluster's and of all persons that hold a feature.

    ``selected`` are rows ``label, featureName`` (the features that stand out
    in a component), ``meanings`` rows ``code, meaning``, ``matrix_rows`` the
    number of persons in the matrix. Result: ``meaning, label,
    percentFeatureInCluster, percentFeatureInPop``.
    """
    # One row per person and feature first: the distinct counts below then are plain counts.
    holders = cut_lineage(with_label(tall, labels).select(PERSON, "label", "featureName").distinct())
    in_cluster = cut_lineage(holders.groupBy("label", "featureName").agg(F.count("*").alias("held")))
    chosen = measured(selected.select("label", "featureName").distinct())
    in_population = in_cluster.groupBy("featureName").agg(F.sum("held").alias("held_all"))
    sizes = holders.select(PERSON, "label").distinct().groupBy("label").agg(F.count("*").alias("persons"))
    return (
        in_cluster.join(chosen, ["label", "featureName"], "left_semi")
        .join(sizes, "label")
        .join(in_population, "featureName")
        .withColumn("code", code_part("featureName"))
        .join(meanings.select("code", "meaning"), "code")
        .select(
            "meaning",
            "label",
            (F.col("held") / F.col("persons") * 100).alias("percentFeatureInCluster"),
            (F.col("held_all") / F.lit(matrix_rows) * 100).alias("percentFeatureInPop"),
        )
        .distinct()
    )


def percentage_pivot(percentages: DataFrame, labels: list[int]) -> DataFrame:
    """One row per meaning, a column per cluster (0 where absent) and the population share.

    Of several codes with one meaning the largest shares are shown.
    """
    prefix = "percentFeatureInCluster"
    wide = (
        percentages.groupBy("meaning")
        .pivot("label", labels)
        .agg(F.max(prefix))
        .select(
            "meaning", *[F.coalesce(F.col(f"`{label}`"), F.lit(0.0)).alias(f"{prefix}{label}") for label in labels]
        )
    )
    share = percentages.groupBy("meaning").agg(F.max("percentFeatureInPop").alias("percentFeatureInPop"))
    return wide.join(share, "meaning")


def matched_traits(traits: DataFrame, labels: DataFrame, key: str = "Indiv") -> DataFrame:
    """Trait rows of labelled persons, with their cluster instead of their key."""
    cluster = labels.select(F.col(PERSON).alias(key), F.col("label").alias("cluster"))
    return traits.join(cluster, key, "left").where(F.col("cluster").isNotNull()).drop(key)


def trait_means(traits: DataFrame, labels: DataFrame, key: str = "Indiv") -> DataFrame:
    """Mean of every trait per cluster."""
    names = [c for c in traits.columns if c != key]
    return matched_traits(traits, labels, key).groupBy("cluster").agg(
        *[F.avg(F.col(f"`{c}`")).alias(c) for c in names]
    )
