"""Wide export to cleaned long table.

Typed long rows are ``eid, category, featureName, featureValue, featureType``;
clean long rows drop the type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from phenoweave.functions.names import (
    DEATH_FIELD,
    EXCLUDED_CODES,
    PERSON,
    base_field_of,
    coded_name,
    is_categorical,
    quoted,
)
from phenoweave.operators.sizing import measured


@dataclass(frozen=True)
class Field:
    """One field of the export and how to read it."""

    category: str
    field: str
    type: str


def fields_of(wide: DataFrame, categories: DataFrame, types: DataFrame) -> list[Field]:
    """Metadata of the export's columns; no longer than its header."""
    present = {base_field_of(c) for c in wide.columns}
    rows = categories.join(types, "field").select("category", "field", "featureType").collect()
    return sorted(
        (Field(r.category, r.field, r.featureType) for r in rows if r.field in present),
        key=lambda f: (f.category, f.field),
    )


def subset_columns(wide: DataFrame, fields: list[str]) -> list[str]:
    wanted = set(fields)
    return [PERSON] + [c for c in wide.columns if base_field_of(c) in wanted and c != PERSON]


def subset(wide: DataFrame, fields: list[str]) -> DataFrame:
    """The person key and the columns of the given fields."""
    return wide.select(*[quoted(c) for c in subset_columns(wide, fields)])


def _cells(wide: DataFrame, field: Field) -> Column:
    columns = [quoted(c) for c in wide.columns if base_field_of(c) == field.field]
    return F.struct(
        F.lit(field.category).alias("category"),
        F.lit(field.field).alias("field"),
        F.lit(field.type).alias("featureType"),
        F.array(*columns).alias("texts"),
    )


def melt(wide: DataFrame, fields: list[Field], one_row_per_person: bool = False) -> DataFrame:
    """Typed, distinct long rows.

    A categorical cell ``v`` becomes ``field=v`` with 1.0 unless it is null or
    an excluded code; a numeric cell becomes ``field`` with its number, null
    included, and the text NaN is null too. Repeats are removed inside each person's row first, which needs
    no shuffle; ``one_row_per_person`` states that this is enough.
    """
    # A list of one typed array per field keeps the exploded rows few.
    per_field = wide.select(PERSON, F.explode(F.array(*[_cells(wide, f) for f in fields])).alias("f"))
    categorical = is_categorical("f.featureType")
    text = F.col("f.texts")
    rows = F.array_distinct(
        F.when(
            categorical,
            F.transform(
                F.filter(text, lambda v: v.isNotNull() & ~v.isin(*EXCLUDED_CODES)),
                lambda v: F.struct(
                    coded_name(F.col("f.field"), v).alias("featureName"),
                    F.lit(1.0).alias("featureValue"),
                ),
            ),
        ).otherwise(
            F.transform(
                text,
                lambda v: F.struct(
                    F.col("f.field").alias("featureName"),
                    F.nanvl(v.try_cast("double"), F.lit(None).cast("double")).alias("featureValue"),
                ),
            )
        )
    )
    tall = per_field.select(PERSON, "f.category", "f.featureType", F.explode(rows).alias("r")).select(
        PERSON, "category", "r.featureName", "r.featureValue", "featureType"
    )
    return tall if one_row_per_person else tall.dropDuplicates()


def deceased(wide: DataFrame, field: str = DEATH_FIELD) -> Column | None:
    """Condition for a non-null death field, or None if the export has none."""
    columns = [quoted(c) for c in wide.columns if base_field_of(c) == field]
    return F.coalesce(*columns).isNotNull() if columns else None


def exclude_deceased(wide: DataFrame, field: str = DEATH_FIELD, one_row_per_person: bool = False) -> DataFrame:
    """Drop every row of persons with a non-null death field."""
    dead = deceased(wide, field)
    if dead is None:
        return wide
    if one_row_per_person:
        return wide.where(~dead)
    return wide.join(wide.where(dead).select(PERSON).distinct(), PERSON, "left_anti")


def drop_field_rows(tall: DataFrame, field: str = DEATH_FIELD) -> DataFrame:
    """The row form of the exclusion: only the field's own non-null rows go."""
    return tall.where(~((F.col("featureName") == field) & F.col("featureValue").isNotNull()))


def _feature_keys(tall: DataFrame) -> list[str]:
    return [c for c in ("category", "featureName") if c in tall.columns]


def numeric_stats(tall: DataFrame) -> DataFrame:
    """Mean and maximum of each numeric feature over its non-null rows."""
    return (
        tall.where(~is_categorical("featureType"))
        .groupBy(*_feature_keys(tall))
        .agg(F.avg("featureValue").alias("mean"), F.max("featureValue").alias("max"))
    )


def impute_mean(tall: DataFrame) -> DataFrame:
    """Null numeric values take their feature's mean; a feature without any value leaves no rows."""
    keys = _feature_keys(tall)
    means = measured(numeric_stats(tall).select(*keys, "mean"))
    filled = F.coalesce("featureValue", "mean")
    return (
        tall.join(means, keys, "left")
        .withColumn("featureValue", filled)
        .where(F.col("featureValue").isNotNull())
        .select(*tall.columns)
    )


def positive_only(tall: DataFrame) -> DataFrame:
    return tall.where(F.col("featureValue") > 0)


def max_scale(tall: DataFrame) -> DataFrame:
    """Divide by the feature's maximum; the minimum is not used."""
    keys = _feature_keys(tall)
    peaks = measured(tall.groupBy(*keys).agg(F.max("featureValue").alias("peak")))
    return (
        tall.join(peaks, keys)
        .withColumn("featureValue", F.try_divide("featureValue", "peak"))
        .select(*tall.columns)
    )


def clean(
    wide: DataFrame,
    fields: list[Field],
    one_row_per_person: bool = False,
    drop_deceased: bool = False,
) -> DataFrame:
    """All categories in one job: melt, impute, keep positive values, scale.

    Only numeric features need statistics (a categorical value is always 1),
    so the first pass reads numeric columns alone and yields at most one row
    per field. The larger of a feature's raw maximum and its mean is the maximum
    after imputation.
    """
    if drop_deceased:
        wide = exclude_deceased(wide, one_row_per_person=one_row_per_person)
    typed = melt(wide, fields, one_row_per_person)
    numeric = [f for f in fields if not is_categorical_type(f.type)]
    if not numeric:
        return typed.select(PERSON, "category", "featureName", "featureValue")
    stats = numeric_stats(melt(wide, numeric, one_row_per_person))
    keys = ["category", "featureName"]
    value = F.coalesce("featureValue", "mean")
    return (
        typed.join(F.broadcast(stats), keys, "left")  # at most one row per field of the header
        .where(value > 0)
        .select(
            PERSON,
            "category",
            "featureName",
            F.when(is_categorical("featureType"), F.col("featureValue"))
            .otherwise(value / F.greatest("max", "mean"))  # rounding may lift a mean of equal values above them
            .alias("featureValue"),
        )
    )


def is_categorical_type(type_name: str) -> bool:
    from phenoweave.functions.names import CATEGORICAL_TYPES

    return type_name in CATEGORICAL_TYPES
