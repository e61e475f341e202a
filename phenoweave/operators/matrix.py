"""Products of a sparse matrix with narrow ones, as joins and sums.

The matrix is entries ``eid, featureName, value``. A narrow matrix is one row
per person or feature with an ``array<double>``: ``(eid, w)`` or
``(featureName, h)``. No dense person x feature object is ever formed.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from phenoweave.functions.arrays import weighted_sums
from phenoweave.functions.names import PERSON
from phenoweave.operators.sizing import fits_broadcast, partitions_for, sized
from phenoweave.session import ship_package, stored

QUOTIENT_EPSILON = 2.0e-15  # fixed value of the elementwise quotient


@dataclass
class Matrix:
    """Entries for algorithms that pass over them often: ``kept`` as they were written, ``entries`` together by person."""

    kept: DataFrame
    nonzeros: int
    features: int
    squares: float  # sum of squared values
    laid: DataFrame | None = None
    products: tuple[list[str], np.ndarray] | None = None  # of all pairs of features, once they were taken

    @property
    def spark(self):
        return self.kept.sparkSession

    @property
    def entries(self) -> DataFrame:
        """Partitioned and sorted by ``eid``, made at its first use: a join or grouping by person needs no shuffle.

        A person has at most ``features`` entries, so no partition can be swamped by one key.
        """
        if self.laid is None:
            self.laid = (
                self.kept.repartition(partitions_for(self.spark, self.nonzeros), PERSON)
                .sortWithinPartitions(PERSON)
                .persist(StorageLevel.MEMORY_AND_DISK)
            )
            self.laid.count()  # only a filled cache tells plans how it is laid out
        return self.laid

    def release(self) -> None:
        if self.laid is not None:
            self.laid.unpersist()


def hold(entries: DataFrame) -> Matrix:
    """Write the entries to the shared folder, to be laid out where an algorithm needs them by person."""
    kept = stored(entries.select(PERSON, "featureName", "value"), "matrix")
    nonzeros, squares = kept.agg(F.count("*"), F.sum(F.col("value") * F.col("value"))).first()
    return Matrix(kept, nonzeros, kept.agg(F.countDistinct("featureName")).first()[0], squares or 0.0)


def local_products(m: Matrix, width: int) -> bool:
    """Whether :func:`row_products` runs without a shuffle."""
    return fits_broadcast(m.features, _row_bytes(width))


def _row_bytes(width: int) -> int:
    return 64 + 8 * width


def feature_side(h: DataFrame, features: int, width: int) -> DataFrame:
    """Feature table marked for broadcast if its size allows."""
    return sized(h, features, _row_bytes(width))


def row_products(m: Matrix, h: DataFrame, width: int, column: str = "h") -> DataFrame:
    """Matrix times narrow feature table: ``eid, s``. No shuffle while ``h`` can be broadcast."""
    joined = m.entries.join(feature_side(h, m.features, width), "featureName")
    return joined.groupBy(PERSON).agg(weighted_sums("value", column, width).alias("s"))


def column_products(m: Matrix, w: DataFrame, width: int, column: str = "w") -> DataFrame:
    """Transposed matrix times narrow person table: ``featureName, s``.

    Joined in place by person; what is shuffled are partial sums, at most one
    row per feature and partition.
    """
    joined = m.entries.join(w.hint("merge"), PERSON)
    return joined.groupBy("featureName").agg(weighted_sums("value", column, width).alias("s"))


# Up to this width a Gram matrix is plain sums; beyond, one expression per
# product gets slower to compile than to run, and partitions multiply in numpy.
PLAIN_GRAM_WIDTH = 12


def _partial_grams(frames):
    total = None
    for frame in frames:
        if len(frame):
            x = np.stack(frame.iloc[:, 0].to_numpy())
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pd.DataFrame({"g": [total.ravel().tolist()]})


def gram(narrow: DataFrame, column: str, width: int, block: int | None = None) -> np.ndarray:
    """``XᵀX`` of a narrow matrix: ``width²`` sums, combined per partition first.

    With ``block``, only products inside blocks of that many columns are taken;
    the rest is zero.
    """
    block = block or width
    if width > PLAIN_GRAM_WIDTH:
        partial = narrow.select(column).mapInPandas(_partial_grams, "g array<double>")
        cells = partial.select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("g")).collect()
        full = np.zeros(width * width)
        for cell in cells:
            full[cell["pos"]] = cell["g"]
        groups = np.arange(width) // block
        return full.reshape(width, width) * np.equal.outer(groups, groups)
    pairs = [(i, j) for i in range(width) for j in range(i, width) if i // block == j // block]
    products = ", ".join(f"sum({column}[{i}] * {column}[{j}])" for i, j in pairs)
    sums = narrow.selectExpr(f"array({products}) AS g").first()["g"]
    out = np.zeros((width, width))
    for (i, j), total in zip(pairs, sums):
        out[i, j] = out[j, i] = total or 0.0
    return out


# Persons that one product takes as dense rows.
DENSE_ROWS = 2048


def feature_gram(m: Matrix) -> tuple[list[str], np.ndarray]:
    """Names of the features and the products of all pairs of their columns, for a bounded number of features.

    Each partition adds up the outer products of its persons; one row per feature
    and partition is shuffled. They are taken once for a matrix.
    """
    if m.products is not None:
        return m.products
    names = sorted(r[0] for r in m.entries.select("featureName").distinct().collect())
    place = pd.Series(np.arange(len(names)), index=names)

    def partial(frames):
        total, rest = np.zeros((len(names), len(names))), None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            person = pd.factorize(frame[PERSON], use_na_sentinel=False)[0]
            rest = frame[person == person[-1]]  # the next frame may go on with the last person
            _add_products(total, person, place[frame["featureName"]].to_numpy(), frame["value"].to_numpy(float), person[-1])
        if rest is not None:
            _add_products(total, np.zeros(len(rest), np.int64), place[rest["featureName"]].to_numpy(), rest["value"].to_numpy(float), 1)
            yield pd.DataFrame({"i": np.arange(len(names)), "g": list(total)})

    def summed(frame):
        return pd.DataFrame({"i": frame["i"].iloc[:1], "g": [np.sum(frame["g"].to_list(), axis=0)]})

    ship_package(m.spark)
    partials = m.entries.select(PERSON, "featureName", "value").mapInPandas(partial, "i long, g array<double>")
    out = np.zeros((len(names), len(names)))
    for r in partials.groupBy("i").applyInPandas(summed, "i long, g array<double>").collect():
        out[r["i"]] = r["g"]
    m.products = names, (out + out.T) / 2
    return m.products


def _add_products(total: np.ndarray, person: np.ndarray, column: np.ndarray, value: np.ndarray, end: int) -> None:
    """Add the outer products of the persons numbered below ``end``, in ascending order in ``person``."""
    for start in range(0, end, DENSE_ROWS):
        stop = min(end, start + DENSE_ROWS)
        a, b = np.searchsorted(person, [start, stop])
        dense = np.zeros((stop - start, len(total)))
        np.add.at(dense, (person[a:b] - start, column[a:b]), value[a:b])
        total += dense.T @ dense


@contextmanager
def held(entries: DataFrame | Matrix):
    """The entries laid out for iteration; released afterwards unless they came that way."""
    if isinstance(entries, Matrix):
        yield entries
        return
    m = hold(entries)
    try:
        yield m
    finally:
        m.release()


# Products of two sparse matrices and entry-wise operations, for tables of any width.


def multiply_entries(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(row, col, value)`` times ``(row, col, value)``: inner index joined, products summed."""
    a = left.select("row", F.col("col").alias("inner"), F.col("value").alias("a"))
    b = right.select(F.col("row").alias("inner"), "col", F.col("value").alias("b"))
    return a.join(b, "inner").groupBy("row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def transpose_entries(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def elementwise(left: DataFrame, right: DataFrame, operation: str) -> DataFrame:
    """Entry-wise ``product`` or ``quotient``; the quotient's denominator carries a small constant."""
    a = left.select("row", "col", F.col("value").alias("a"))
    b = right.select("row", "col", F.col("value").alias("b"))
    if operation == "product":
        value = F.col("a") * F.col("b")
    elif operation == "quotient":
        value = F.col("a") / (F.col("b") + F.lit(QUOTIENT_EPSILON))
    else:
        raise ValueError("operation must be 'product' or 'quotient'")
    return a.join(b, ["row", "col"]).select("row", "col", value.alias("value"))


def absolute_entries(entries: DataFrame) -> DataFrame:
    return entries.withColumn("value", F.abs("value"))
