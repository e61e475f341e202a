"""Tables about the components of a factorization.

Input is ``H`` in long form, ``label, featureName, weight``; labels are
component indices, so a component without strong features leaves a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phenoweave.functions.names import base_field, coded_name
from phenoweave.operators.sizing import measured

# Fixed values of the reports.
INFO_THRESHOLD = 0.1
COUNT_THRESHOLD = 1.0
SELECTION_THRESHOLD = 1.0
THRESHOLDS = (0.0, 0.0001, 0.01, 0.05, 0.1)
CANCER_THRESHOLDS = (0.0, 0.0005, 0.001, 0.005, 0.05)
CATEGORY_BY_FIELD = {"20001": "cancer", "20002": "noncan", "20003": "med"}
OTHER_CATEGORY = "med"


def count_above(weights: DataFrame, threshold: float = COUNT_THRESHOLD) -> DataFrame:
    """Features per component with more than the threshold's weight."""
    return weights.groupBy("label").agg(
        F.sum((F.col("weight") > F.lit(threshold)).cast("long")).alias("features")
    )


def mean_above(weights: DataFrame, threshold: float = COUNT_THRESHOLD) -> DataFrame:
    return count_above(weights, threshold).agg(F.avg("features").alias("avg_nonzero_feature_count"))


def strong_features(weights: DataFrame, threshold: float) -> DataFrame:
    return weights.where(F.col("weight") > F.lit(threshold))


def category_of(
    name: str, by_field: dict[str, str] | None = None, other: str = OTHER_CATEGORY
) -> Column:
    """Category by the feature's exact field."""
    by_field = by_field if by_field is not None else CATEGORY_BY_FIELD
    column = F.lit(None).cast("string")
    field = base_field(name)
    for prefix, category in by_field.items():
        column = F.when(field == prefix, F.lit(category)).otherwise(column)
    return F.coalesce(column, F.lit(other))


def threshold_counts(
    weights: DataFrame,
    by_field: dict[str, str] | None = None,
    other: str = OTHER_CATEGORY,
    thresholds: tuple[float, ...] = THRESHOLDS,
    special: dict[str, tuple[float, ...]] | None = None,
) -> DataFrame:
    """``category, threshold, label, features`` for a list of thresholds per category.

    Each weight is counted against all thresholds in the same aggregation.
    """
    special = special if special is not None else {"cancer": CANCER_THRESHOLDS}
    width = max(len(thresholds), *(len(t) for t in special.values())) if special else len(thresholds)

    def nth(i):
        default = F.lit(thresholds[i]) if i < len(thresholds) else F.lit(None).cast("double")
        chosen = default
        for category, own in special.items():
            value = F.lit(own[i]) if i < len(own) else F.lit(None).cast("double")
            chosen = F.when(F.col("category") == category, value).otherwise(chosen)
        return chosen

    counted = (
        weights.withColumn("category", category_of("featureName", by_field, other))
        .groupBy("category", "label")
        .agg(*[F.sum((F.col("weight") > nth(i)).cast("long")).alias(f"n{i}") for i in range(width)])
    )
    pairs = F.explode(
        F.array(*[F.struct(nth(i).alias("threshold"), F.col(f"n{i}").alias("features")) for i in range(width)])
    )
    return (
        counted.select("category", "label", pairs.alias("p"))
        .select("category", "p.threshold", "label", "p.features")
        .where(F.col("threshold").isNotNull())
    )


def info_table(weights: DataFrame, meanings: DataFrame, threshold: float = INFO_THRESHOLD) -> DataFrame:
    """Decoded strong features: ``label, category, meaning, weight``.

    ``meanings`` are rows ``category, field, code, meaning``; the join key is
    the full feature name, so equal codes of two fields stay apart.
    """
    decoded = measured(
        meanings.select(
            coded_name(F.col("field"), F.col("code")).alias("featureName"), "category", "meaning"
        )
    )
    return (
        strong_features(weights, threshold)
        .join(decoded, "featureName")
        .select("label", "category", "meaning", "weight")
        .orderBy("label", "category", F.desc("weight"), "meaning")
    )
