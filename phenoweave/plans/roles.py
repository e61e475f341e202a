"""Pipeline inputs derived from the given tables.

The tables hold no observational export, so customers stand in for persons,
their attributes for the wide export, and what they bought for coded features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave.operators.cleaning import Field
from phenoweave.operators.setops import bag_union

# Type and category per field of the derived export.
FIELD_TYPES = {
    "eid": "Sequence",
    "seg": "Categorical (multiple)",
    "nat": "Categorical (single)",
    "bal": "Continuous",
    "tot": "Continuous",
    "40000": "Date",
}
FIELD_CATEGORIES = {
    "Demographic": ["seg", "nat"],
    "PhysicalMeasure": ["bal"],
    "Lifestyle": ["tot"],
}
CODED_CATEGORIES = {"brand": "CANCER", "type": "NonCancerIllness", "name": "Medication"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One all-string row per customer; nulls and sentinel codes by key arithmetic."""
    totals = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    )
    key = F.col("c_custkey")

    def gaps(value):
        text = value.cast("string")
        return F.when(key % 11 == 0, None).when(key % 13 == 0, F.lit("99999")).otherwise(text)

    return (
        table(spark, sf_dir, "customer")
        .join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            key.cast("string").alias("eid"),
            gaps(F.col("c_mktsegment")).alias("seg-0.0"),
            F.when(key % 5 == 0, F.col("c_mktsegment")).when(key % 5 == 1, "MIXED").alias("seg-0.1"),
            gaps(F.col("c_nationkey")).alias("nat-0.0"),
            (F.col("c_nationkey") + 1).cast("string").alias("nat-1.0"),
            F.when(key % 10 != 0, F.col("c_acctbal")).cast("string").alias("bal-0.0"),
            F.col("lo").cast("string").alias("tot-0.0"),
            F.col("hi").cast("string").alias("tot-0.1"),
            F.when(key % 17 == 0, F.lit("61")).alias("40000-0.0"),
        )
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenoweave.sources.delimited import select_baseline

    return select_baseline(raw_wide(spark, sf_dir))


def fields(*categories: str) -> list[Field]:
    return [
        Field(category, field, FIELD_TYPES[field])
        for category, names in sorted(FIELD_CATEGORIES.items())
        for field in sorted(names)
        if not categories or category in categories
    ]


def raw_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary of the export with the number of filled cells per column.

    The type is stated for a field's first column only, as exports do.
    """
    export = raw_wide(spark, sf_dir)
    columns = [F.col(f"`{c}`") for c in export.columns]
    counts = export.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("n"), F.lit(name).alias("UDI"), c.isNotNull().alias("filled"))
                    for i, (name, c) in enumerate(zip(export.columns, columns))
                ]
            )
        ).alias("c")
    ).groupBy("c.n", "c.UDI").agg(F.sum(F.col("c.filled").cast("long")).alias("Count"))
    stated = F.create_map(
        *[x for name, t in FIELD_TYPES.items() for x in (F.lit(name), F.lit(t))]
    )
    field = F.split("UDI", "-")[0]
    first = (F.col("UDI") == field) | F.col("UDI").endswith("-0.0")
    return counts.select(
        F.col("n").cast("string").alias("Colnum"),
        "UDI",
        F.col("Count").cast("string").alias("Count"),
        F.when(first, stated[field]).alias("Type"),
        F.lit(None).cast("string").alias("Description"),
    )


def category_map(spark: SparkSession) -> DataFrame:
    """Category file of the export: one column per category, padded with nulls."""
    names = sorted(FIELD_CATEGORIES)
    depth = max(len(v) for v in FIELD_CATEGORIES.values())
    rows = [
        tuple(FIELD_CATEGORIES[n][i] if i < len(FIELD_CATEGORIES[n]) else None for n in names)
        for i in range(depth)
    ]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows of what each customer bought, one per order line and code kind."""
    lines = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        .join(
            table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(
            table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
    )
    kinds = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(category).alias("category"),
                    F.concat(F.lit(field + "="), F.col("p_" + field)).alias("featureName"),
                )
                for field, category in CODED_CATEGORIES.items()
            ]
        )
    )
    return lines.select(F.col("o_custkey").cast("string").alias("eid"), kinds.alias("k")).select(
        "eid", "k.category", "k.featureName", F.lit(1.0).alias("featureValue")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows of a coded feature with many codes: the part of every order line, as a medication."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return lines.select(
        F.col("o_custkey").cast("string").alias("eid"),
        F.lit("Medication").alias("category"),
        F.concat(F.lit("item="), "l_partkey").alias("featureName"),
        F.lit(1.0).alias("featureValue"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix entries of the coded features."""
    from phenoweave.operators.features import matrix_entries

    return matrix_entries(coded(spark, sf_dir))


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix entries with many values: quantity bought per customer and brand or type."""
    lines = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(
            table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(
            table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
    )
    names = F.explode(
        F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("type="), "p_type"))
    )
    return (
        lines.select(F.col("o_custkey").cast("string").alias("eid"), names.alias("featureName"), "l_quantity")
        .groupBy("eid", "featureName")
        .agg((F.sum("l_quantity") / 50.0).alias("value"))
    )


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that need no training: the customer's nation modulo 4."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("eid"),
        (F.col("c_nationkey") % 4).cast("int").alias("label"),
    )


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hierarchical code per order, at depths 1 to 4, some unknown or not selectable."""
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    segment = F.concat_ws(".", nation, "c_mktsegment")
    priority = F.concat_ws(".", segment, "o_orderpriority")
    status = F.concat_ws(".", priority, "o_orderstatus")
    key = F.col("o_orderkey")
    node = F.when(key % 5 == 0, nation).when(key % 5 == 1, segment).when(key % 5 == 2, priority).otherwise(status)
    code = F.when(key % 35 == 4, F.lit("-1")).when(key % 35 == 9, F.lit("c:none")).otherwise(
        F.concat(F.lit("c:"), node)
    )
    return joined.select(
        F.col("o_custkey").cast("string").alias("eid"),
        F.lit("NonCancerIllness").alias("category"),
        F.concat(F.lit("diag="), code).alias("featureName"),
        F.lit(1.0).alias("featureValue"),
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree of five levels: region, nation, segment, priority, status."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    paths = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("c_nationkey", "c_mktsegment", "o_orderpriority", "o_orderstatus")
        .distinct()
    )
    n = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    s = F.concat_ws(".", n, "c_mktsegment")
    p = F.concat_ws(".", s, "o_orderpriority")
    t = F.concat_ws(".", p, "o_orderstatus")

    def nodes(node, parent):
        return F.struct(
            F.concat(F.lit("c:"), node).alias("coding"),
            node.alias("meaning"),
            node.alias("node_id"),
            parent.alias("parent_id"),
            F.lit("Y").alias("selectable"),
        )

    deep = paths.select(F.explode(F.array(nodes(s, n), nodes(p, s), nodes(t, p))).alias("x")).select("x.*").distinct()
    r = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    roots = region.select(
        F.lit("-1").alias("coding"),
        F.col("r_name").alias("meaning"),
        r.alias("node_id"),
        F.lit("0").alias("parent_id"),
        F.lit("N").alias("selectable"),
    )
    nn = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    nations = nation.select(
        F.concat(F.lit("c:"), nn).alias("coding"),
        F.col("n_name").alias("meaning"),
        nn.alias("node_id"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"),
        F.lit("Y").alias("selectable"),
    )
    return bag_union(roots, nations, deep)


def meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode table of all coded features: ``category, field, code, meaning``."""
    part = table(spark, sf_dir, "part")
    kinds = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(category).alias("category"),
                    F.lit(field).alias("field"),
                    F.col("p_" + field).alias("code"),
                )
                for field, category in CODED_CATEGORIES.items()
            ]
        )
    )
    return part.select(kinds.alias("k")).select("k.*").distinct().withColumn("meaning", F.lower("code"))


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric table keyed by person: order figures per customer."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("Indiv"))
        .agg(
            F.avg("o_totalprice").alias("mean_price"),
            F.max("o_totalprice").alias("max_price"),
            F.count("*").cast("double").alias("orders"),
        )
    )


def embedding_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as matrix entries, rescaled so that lengths differ."""
    return embeddings(spark, sf_dir).select("eid", F.posexplode("vector").alias("feature", "value"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eid, label, vector``: rows of length 1, 2 or 3 with a shift in the first coordinate."""
    scale = F.lit(1.0) + F.col("vec_id") % 3
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("eid"),
        F.col("label").cast("int").alias("label"),
        F.transform(
            "embedding",
            lambda x, i: x.cast("double") * scale + F.when(i == 0, F.lit(0.25)).otherwise(F.lit(0.0)),
        ).alias("vector"),
    )
