"""Sparse persons in blocks, for products that run in numpy inside tasks.

A block is a row of a table: some thousand persons with their entries. Which
persons it holds depends on the data alone, so sums that are taken block by block
and then added in the order of the blocks are the same numbers on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from phenoweave.functions.names import PERSON
from phenoweave.operators.matrix import Matrix
from phenoweave.operators.sizing import partitions_for
from phenoweave.session import large_rows, ship_package, stored

#: About so many persons, and at most about so many entries, make a block. Where less than FULL_WIDTH
#: columns stand beside it, it takes more persons in proportion, up to WIDER times as many.
BLOCK_PERSONS, BLOCK_ENTRIES, FULL_WIDTH, WIDER = 4096, 1 << 19, 512, 16
#: Up to so many cells, or DENSE_SHARE cells per entry, a block is multiplied as a dense matrix.
DENSE_CELLS, DENSE_SHARE = 1 << 18, 8
#: Cells of a factor that are renewed at a time, and the fewest persons.
TILE_CELLS, LEAST_TILE = 1 << 16, 256
#: Numbers that a product over single entries holds at a time.
SPARSE_CELLS = 1 << 21
#: Up to so many columns, products over single entries are summed column by column.
NARROW = 16
#: Consecutive blocks whose sums one task adds before the totals meet.
FAN = 256

_SCHEMA = "block int, persons array<string>, starts binary, columns binary, numbers binary, squares double"


@dataclass
class Blocks:
    """``block, persons, starts, columns, numbers, squares`` and the names that the columns count."""

    table: DataFrame
    count: int
    persons: int
    names: list[str]
    squares: float
    entries_per_person: float

    def laid(self) -> DataFrame:
        """The blocks partitioned and sorted by number, kept in memory where it fits, to be joined again and again."""
        spark = self.table.sparkSession
        # Two tasks a core, since blocks are dealt by hash and not evenly.
        parts = max(partitions_for(spark, self.count, 1, 64), min(self.count, 2 * spark.sparkContext.defaultParallelism))
        kept = self.table.repartition(parts, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)
        with large_rows(spark):
            kept.count()  # only a filled cache tells plans how it is laid out
        return kept


class Rows:
    """The entries of one block: products with narrow dense matrices."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, numbers: np.ndarray, features: int):
        self.starts, self.columns, self.numbers, self.features = starts, columns, numbers, features
        self.persons = len(starts) - 1
        self.row = np.repeat(np.arange(self.persons), np.diff(starts))
        cells = self.persons * features
        self.dense = self.codes = None
        if cells <= max(DENSE_CELLS, DENSE_SHARE * len(numbers)):
            self.dense = np.bincount(self.row * features + columns, numbers, cells).reshape(self.persons, features)

    @classmethod
    def of(cls, starts: bytes, columns: bytes, numbers: bytes, features: int) -> Rows:
        first = np.frombuffer(starts, np.int64)
        return cls(first, np.frombuffer(columns, _column_type(features)), _unpacked(numbers), features)

    def lean(self) -> Rows:
        """These rows for products only, without the single entries of a dense block."""
        if self.dense is not None:
            self.starts = self.columns = self.numbers = self.row = None
        return self

    def coded(self) -> Rows:
        """These rows for products only; a dense block as places in a list of its different numbers where these are few."""
        if self.dense is not None:
            known, place = np.unique(self.dense, return_inverse=True)
            if len(known) <= 1 << 16:
                self.codes, self.dense = (known, place.reshape(self.dense.shape).astype(_column_type(len(known)))), None
                self.starts = self.columns = self.numbers = self.row = None
                return self
        return self.lean()

    def tiles(self, columns: int) -> Iterator[tuple[slice, Tile]]:
        """Persons whose products with so many columns stay in fast memory, one part after the other; all of them where entries are single."""
        if self.dense is None and self.codes is None:
            yield slice(0, self.persons), Tile(self)
            return
        size = max(LEAST_TILE, TILE_CELLS // max(1, columns))
        for a in range(0, self.persons, size):
            part = self.dense[a : a + size] if self.codes is None else self.codes[0][self.codes[1][a : a + size]]
            yield slice(a, min(self.persons, a + size)), Tile(self, part)

    def unit(self) -> Rows:
        """Every person's row divided by its length; a row of length 0 stays."""
        lengths = np.sqrt(self.squares())
        return Rows(self.starts, self.columns, self.numbers / np.where(lengths > 0, lengths, 1.0)[self.row], self.features)

    def squares(self) -> np.ndarray:
        return np.bincount(self.row, self.numbers**2, self.persons)

    def times(self, right: np.ndarray) -> np.ndarray:
        """Persons x features times features x any."""
        if self.dense is not None:
            return self.dense @ right
        if right.shape[1] <= NARROW:
            return self._summed(self.row, self.columns, right, self.persons)
        return self._added(self.row, np.arange(len(self.row)), self.columns, right, self.persons)

    def transposed_times(self, left: np.ndarray) -> np.ndarray:
        """Features x persons times persons x any."""
        if self.dense is not None:
            return self.dense.T @ left
        if left.shape[1] <= NARROW:
            return self._summed(self.columns, self.row, left, self.features)
        order = np.argsort(self.columns, kind="stable")
        return self._added(self.columns[order], order, self.row, left, self.features)

    def _summed(self, target: np.ndarray, source: np.ndarray, factor: np.ndarray, size: int) -> np.ndarray:
        """Entries times rows of ``factor``, added by ``target`` in any order, one column after the other."""
        out = np.empty((size, factor.shape[1]))
        for t, column in enumerate(np.ascontiguousarray(factor.T)):
            out[:, t] = np.bincount(target, column[source] * self.numbers, size)
        return out

    def _added(self, target: np.ndarray, order: np.ndarray, source: np.ndarray, factor: np.ndarray, size: int) -> np.ndarray:
        """Entries times rows of ``factor``, added where ``target``, which ascends, is equal."""
        out = np.zeros((size, factor.shape[1]))
        if not len(target):
            return out
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        step = max(1, SPARSE_CELLS // len(target))
        for a in range(0, factor.shape[1], step):
            out[target[first], a : a + step] = np.add.reduceat(factor[source[order], a : a + step] * self.numbers[order, None], first)
        return out


@dataclass
class Tile:
    """Some persons of a block, for products with a factor that has its columns as rows."""

    rows: Rows
    dense: np.ndarray | None = None

    def products(self, columns: np.ndarray) -> np.ndarray:
        """Columns x features times features x persons."""
        return columns @ self.dense.T if self.dense is not None else np.ascontiguousarray(self.rows.times(columns.T).T)

    def sums(self, columns: np.ndarray) -> np.ndarray:
        """Columns x persons times persons x features."""
        return columns @ self.dense if self.dense is not None else self.rows.transposed_times(columns.T).T


def _column_type(features: int) -> type:
    """The narrowest type that holds a position among so many features."""
    return np.uint8 if features <= 1 << 8 else np.uint16 if features <= 1 << 16 else np.int32


def _packed(numbers: np.ndarray) -> bytes:
    """Doubles as bytes: how many different ones there are, these, and the place of each; 0 and all of them where that is not shorter."""
    known, place = np.unique(numbers.view(np.int64), return_inverse=True)
    if len(known) > 1 << 16 or 8 * len(known) + 2 * len(numbers) >= 8 * len(numbers):
        return np.int64(0).tobytes() + numbers.tobytes()
    return np.int64(len(known)).tobytes() + known.tobytes() + place.astype(_column_type(len(known))).tobytes()


def _unpacked(numbers: bytes) -> np.ndarray:
    different = int(np.frombuffer(numbers, np.int64, 1)[0])
    if not different:
        return np.frombuffer(numbers, np.float64, offset=8)
    known = np.frombuffer(numbers, np.float64, different, 8)
    return known[np.frombuffer(numbers, _column_type(different), offset=8 + 8 * different)]


def lay_out(m: Matrix, width: int = FULL_WIDTH) -> Blocks:
    """Pack the held entries into blocks that are multiplied with ``width`` columns at a time.

    The number of blocks follows from that width and from the persons and entries only.
    """
    spark = m.spark
    ship_package(spark)
    names = sorted(r[0] for r in m.kept.select("featureName").distinct().collect())  # the caller has bounded them
    persons = m.kept.select(PERSON).distinct().count()
    own = BLOCK_PERSONS * max(1, min(WIDER, FULL_WIDTH // max(1, width)))
    count = max(1, math.ceil(persons / own), math.ceil(m.nonzeros / BLOCK_ENTRIES))
    places = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)))), "featureName string, column int"))

    def pack(key: tuple, entries: pa.Table) -> pa.Table:
        ids = entries[PERSON].combine_chunks().dictionary_encode()
        order = pc.sort_indices(ids.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        person, column = rank[ids.indices.to_numpy()], entries["column"].to_numpy()
        by = np.lexsort((column, person))
        numbers = entries["value"].to_numpy()[by]
        starts = np.append(0, np.cumsum(np.bincount(person, minlength=len(order)))).astype(np.int64)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int32()),
                "persons": pa.array([ids.dictionary.take(pa.array(order)).to_pylist()], pa.list_(pa.string())),
                "starts": pa.array([starts.tobytes()], pa.binary()),
                "columns": pa.array([column[by].astype(_column_type(len(names))).tobytes()], pa.binary()),
                "numbers": pa.array([_packed(numbers)], pa.binary()),
                "squares": pa.array([float((numbers * numbers).sum())], pa.float64()),
            }
        )

    number = F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value")
    keyed = m.kept.join(places, "featureName").select(block_of(count).alias("block"), PERSON, "column", number)
    table = stored(keyed.groupBy("block").applyInArrow(pack, _SCHEMA), "blocks")
    squares = math.fsum(r[0] for r in table.select("squares").collect())  # one per block, the same sum in any order
    return Blocks(table, count, persons, names, squares, m.nonzeros / max(1, persons))


def block_of(count: int):
    return F.pmod(F.xxhash64(PERSON), F.lit(count)).cast("int")


def folded(parts: DataFrame, blocks: int, finish: Callable[[int, np.ndarray], dict], schema: str) -> DataFrame:
    """Add the ``sums`` (doubles as bytes) of every ``key`` in the order of ``block``; ``finish`` makes a row of key and total.

    Tasks stream through their rows and hold one total at a time. Beyond FAN
    blocks, runs of FAN consecutive ones are added first.
    """
    while blocks > FAN:
        parts = _streamed(parts.withColumn("part", F.expr(f"block div {FAN}")), _partial, "key int, block int, sums binary")
        blocks = math.ceil(blocks / FAN)
    return _streamed(parts.withColumn("part", F.lit(0)), lambda key, _, total: finish(key, total), schema)


def _partial(key: int, part: int, total: np.ndarray) -> dict:
    return {"key": key, "block": part, "sums": total.tobytes()}


def _streamed(parts: DataFrame, made: Callable[[int, int, np.ndarray], dict], schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for frame in frames:
            for key, part, sums in zip(frame["key"], frame["part"], frame["sums"], strict=True):
                numbers = np.frombuffer(sums)
                if (key, part) == now:
                    total += numbers
                    continue
                if now is not None:
                    yield pd.DataFrame([made(*now, total)])
                now, total = (int(key), int(part)), numbers.copy()
        if now is not None:
            yield pd.DataFrame([made(*now, total)])

    ordered = parts.select("key", "part", "block", "sums").repartition("key", "part").sortWithinPartitions("key", "part", "block")
    return ordered.mapInPandas(run, schema)
