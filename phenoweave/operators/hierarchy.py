"""Roll-up of codes to a chosen level of their tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoweave.functions.names import ROOT_PARENT, base_field, code_part, coded_name
from phenoweave.operators.setops import bag_union
from phenoweave.operators.sizing import measured
from phenoweave.session import cut_lineage


LEVELS = 4  # depth that plain joins resolve; deeper trees take the recursive query


def ancestors(hierarchy: DataFrame, keep_depth: int = 2, levels: int = LEVELS) -> DataFrame:
    """``node_id, depth, ancestor``: nodes down to ``keep_depth`` stand for
    themselves, deeper ones for their ancestor at that depth.

    Each node is joined to its parent, its parent's parent and so on; nodes
    that hang on no root are left out.
    """
    tree = measured(hierarchy.select("node_id", "parent_id").distinct())
    up = tree.select("node_id", F.col("parent_id").alias("p0"))
    for i in range(levels):
        parents = tree.select(F.col("node_id").alias(f"p{i}"), F.col("parent_id").alias(f"p{i + 1}"))
        up = up.join(parents, f"p{i}", "left")
    up = cut_lineage(up)
    top = F.col(f"p{levels}")
    if not up.where(top.isNotNull() & (top != ROOT_PARENT)).isEmpty():
        return _ancestors_of_any_depth(tree, keep_depth)
    path = F.array("node_id", *[f"p{i}" for i in range(levels + 1)])
    depth = (F.array_position(path, ROOT_PARENT) - 2).cast("int")
    steps = F.greatest(F.col("depth") - F.lit(keep_depth), F.lit(0))
    return (
        up.where(F.array_contains(F.array_compact(path), ROOT_PARENT))
        .select("node_id", depth.alias("depth"), path.alias("path"))
        .select("node_id", "depth", F.get("path", steps).alias("ancestor"))
    )


def _ancestors_of_any_depth(tree: DataFrame, keep_depth: int) -> DataFrame:
    return tree.sparkSession.sql(
        f"""
        WITH RECURSIVE level(node_id, depth, ancestor) AS (
          SELECT node_id, 0, node_id FROM {{tree}} WHERE parent_id = '{ROOT_PARENT}'
          UNION ALL
          SELECT t.node_id, l.depth + 1,
                 CASE WHEN l.depth + 1 <= {int(keep_depth)} THEN t.node_id ELSE l.ancestor END
          FROM {{tree}} t JOIN level l ON t.parent_id = l.node_id)
        SELECT node_id, depth, ancestor FROM level
        """,
        tree=tree,
    )


def code_map(hierarchy: DataFrame, keep_depth: int = 2) -> DataFrame:
    """``code, ancestor`` for selectable codes only: other nodes share code ``-1``."""
    chosen = hierarchy.where(F.col("selectable") == "Y")
    return (
        chosen.join(ancestors(hierarchy, keep_depth), "node_id")
        .groupBy(F.col("coding").alias("code"))
        .agg(F.min("ancestor").alias("ancestor"))
    )


def _tagged_map(hierarchies: dict[str, DataFrame], keep_depth: int) -> DataFrame:
    return measured(
        bag_union(
            *[
                code_map(tree, keep_depth).withColumn("category", F.lit(category))
                for category, tree in hierarchies.items()
            ]
        )
    )


def rollup_codes(tall: DataFrame, hierarchies: dict[str, DataFrame], keep_depth: int = 2) -> DataFrame:
    """Rename ``field=code`` to ``field=ancestor`` in the categories that have a tree.

    Codes the tree does not list are dropped; see :func:`unmatched_codes`.
    Repeats that arise from the roll-up stay.
    """
    mapping = _tagged_map(hierarchies, keep_depth)
    rolled = F.col("category").isin(*hierarchies)
    return (
        tall.withColumn("code", code_part("featureName"))
        .join(mapping, ["category", "code"], "left")
        .where(~rolled | F.col("ancestor").isNotNull())
        .withColumn(
            "featureName",
            F.when(rolled, coded_name(base_field("featureName"), F.col("ancestor"))).otherwise(
                F.col("featureName")
            ),
        )
        .select(*tall.columns)
    )


def unmatched_codes(tall: DataFrame, hierarchies: dict[str, DataFrame]) -> DataFrame:
    """Rows per code that the roll-up drops: ``category, code, dropped_rows``."""
    mapping = _tagged_map(hierarchies, 2)
    return (
        tall.where(F.col("category").isin(*hierarchies))
        .select("category", code_part("featureName").alias("code"))
        .groupBy("category", "code")
        .agg(F.count("*").alias("dropped_rows"))
        .join(mapping, ["category", "code"], "left_anti")
    )
