"""Broadcasts behind a size check, and partition counts from row counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave.session import cut_lineage

BROADCAST_LIMIT_BYTES = 64 << 20


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_LIMIT_BYTES


def sized(df: DataFrame, rows: int, row_bytes: int = 100) -> DataFrame:
    """Mark ``df`` for broadcast if ``rows`` of it are small enough.

    Beyond the limit the frame is returned as it is: the join then shuffles
    both sides and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


def measured(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """Compute a (usually small) join side once, count it, and mark it by its size."""
    kept = cut_lineage(df)
    return sized(kept, kept.count(), row_bytes)


def partitions_for(spark: SparkSession, rows: int, small: int = 50_000, large: int = 4_000_000) -> int:
    """Partitions for an iterated table: few for little data, enough for all
    cores, and never more than ``large`` rows in one."""
    cores = spark.sparkContext.defaultParallelism
    return max(2, min(cores, math.ceil(rows / small)), math.ceil(rows / large))
