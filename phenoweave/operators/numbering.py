"""Consecutive numbers over a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoweave.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row within partition below


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name`` = 0, 1, 2, ... along ``order``.

    The sort is range-partitioned; each partition is then shifted by the rows
    of the ones before it. Only the per-partition counts are windowed. The
    order must be total for the numbers to be reproducible.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )
    within = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(shifts), "_part")  # one row per partition
        .withColumn(name, F.col("_shift") + within)
        .drop("_part", "_shift", "_place")
    )
