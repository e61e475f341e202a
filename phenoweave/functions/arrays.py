"""Small-vector arithmetic on ``array<double>`` columns of fixed length.

The longer expressions are SQL text: one call builds them, however many
constants they hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def dot_text(left: str, right: str) -> str:
    return f"aggregate(zip_with({left}, {right}, (a, b) -> a * b), 0D, (total, x) -> total + x)"


def number_text(value: float) -> str:
    return f"{float(value)!r}D"


def vector_text(values: Sequence[float]) -> str:
    return "array(" + ", ".join(number_text(v) for v in values) + ")"


def matrix_text(rows: Sequence[Sequence[float]]) -> str:
    """A constant ``array<array<double>>``; Spark folds it and passes it to tasks by reference."""
    return "array(" + ", ".join(vector_text(row) for row in rows) + ")"


def weighted_sums(value: str, vector: str, width: int) -> Column:
    """``sum(value * vector)`` per position; each sum is combined map-side."""
    return F.expr("array(" + ", ".join(f"sum({value} * {vector}[{i}])" for i in range(width)) + ")")


def times_matrix(vector: str, columns_of_matrix: Sequence[Sequence[float]]) -> Column:
    """Row vector times a constant matrix given as a list of its columns."""
    return F.expr(f"transform({matrix_text(columns_of_matrix)}, col -> {dot_text(vector, 'col')})")


def argmax_first(values: Column) -> Column:
    """Position of the largest entry, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def hashed_units(seed: int, key: str, width: int) -> Column:
    """``width`` reproducible numbers in (0, 1) from a hash of the key and the position."""
    span = 1 << 52
    return F.expr(
        f"transform(sequence(0, {width - 1}), i -> "
        f"(pmod(xxhash64({seed}, cast({key} AS string), i), {span}L) + 0.5D) / {span}D)"
    )
