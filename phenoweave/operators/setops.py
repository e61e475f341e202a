"""Bag union, distinct and subtraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def bag_union(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def subtract_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` equal to no row of ``right``; repeats on the left stay."""
    other = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(left.columns)]).distinct()
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(left.columns)],
    )
    return left.join(other, same, "left_anti")
