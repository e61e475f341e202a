"""Bisecting k-means on Spark ML, a split tree for sweeps over k, and the plane projection.

Vectors are ``eid, features``; a model carries its key through ``transform``,
so nothing is zipped by position.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.ml.clustering import BisectingKMeans, BisectingKMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from phenoweave.functions.names import PERSON
from phenoweave.operators.blocks import folded
from phenoweave.operators.svd import pca_entries
from phenoweave.session import ship_package

DEFAULT_K = 4
SWEEP = range(2, 21, 2)
#: Passes that move the centres of a split at most; a leaf of less than this share of the whole error is not split.
SPLIT_ROUNDS, DIVISIBLE = 20, 1e-12


def bisecting_kmeans(vectors: DataFrame, k: int = DEFAULT_K, seed: int = 1) -> BisectingKMeansModel:
    return BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(vectors)


def cost(model: BisectingKMeansModel) -> float:
    """Within-cluster squared error on the training vectors."""
    return float(model.summary.trainingCost)


def assignments(model: BisectingKMeansModel, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors).select(PERSON, "label")


@dataclass
class SplitTree:
    """Two-way splits of all vectors; node n has the children 2n and 2n + 1, the whole is node 1.

    ``splits`` holds the two centres of every split in the order in which splits
    are made, the largest divisible leaf first; the first k - 1 of them make k
    clusters. ``stats`` gives size and squared error of every node.
    """

    splits: list[tuple[int, np.ndarray]]
    stats: dict[int, tuple[int, float]]

    def leaves(self, k: int) -> list[int]:
        out = {1}
        for node, _ in self.splits[: k - 1]:
            out = out - {node} | {2 * node, 2 * node + 1}
        return sorted(out)

    def error(self, k: int) -> float:
        """Squared error of ``k`` clusters, or of as many as can be split off."""
        return float(sum(self.stats[n][1] for n in self.leaves(k)))

    def labels(self, vectors: DataFrame, k: int) -> DataFrame:
        """``eid, label`` in the ``k`` clusters."""
        centres, place = dict(self.splits[: k - 1]), {n: i for i, n in enumerate(self.leaves(k))}
        ship_package(vectors.sparkSession)

        def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    nodes = _routed(np.stack(frame["x"].to_numpy()), centres)
                    yield pd.DataFrame({PERSON: frame[PERSON], "label": [place[n] for n in nodes]})

        return vectors.select(PERSON, vector_to_array("features").alias("x")).mapInPandas(told, f"{PERSON} string, label int")


def _routed(x: np.ndarray, centres: dict[int, np.ndarray]) -> np.ndarray:
    """The node that each row comes to: at a split the nearer centre, the first one on ties."""
    node = np.ones(len(x), np.int64)
    for n in sorted(centres):  # a parent's number is below its children's
        own = np.flatnonzero(node == n)
        if len(own):
            away = [((x[own] - c) ** 2).sum(axis=1) for c in centres[n]]
            node[own] = 2 * n + (away[1] < away[0])
    return node


def split_tree(vectors: DataFrame, k: int = max(SWEEP), rounds: int = SPLIT_ROUNDS) -> SplitTree:
    """Bisect until there are ``k`` clusters, all splits of one level together.

    A pass over the vectors moves the two centres of every leaf that is being
    split; what leaves a task are sums per leaf and side. The tree, 2 (k - 1)
    centres at most, is all that is sent to the tasks, and persons find their leaf
    by walking it, so nothing about them is rewritten between passes.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    table = vectors.select(vector_to_array("features").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(1, table.rdd.getNumPartitions())

    def sums(centres: dict[int, np.ndarray]) -> dict[int, tuple[int, float, np.ndarray]]:
        """Of every node that rows come to: rows, summed squares, summed vectors."""

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals: dict[int, np.ndarray] = {}
            for frame in frames:
                if not len(frame):
                    continue
                x = np.stack(frame["x"].to_numpy())
                nodes = _routed(x, centres)
                for n in np.unique(nodes):
                    own = x[nodes == n]
                    total = np.concatenate([[len(own), (own**2).sum()], own.sum(axis=0)])
                    totals[n] = totals[n] + total if n in totals else total
            part = TaskContext.get().partitionId()
            yield pd.DataFrame([{"key": int(n), "block": part, "sums": t.tobytes()} for n, t in totals.items()], columns=["key", "block", "sums"])

        added = folded(table.mapInPandas(count, "key int, block int, sums binary"), parts, lambda key, total: {"key": key, "sums": total.tobytes()}, "key int, sums binary")
        out = {r["key"]: np.frombuffer(r["sums"]) for r in added.collect()}  # one per leaf
        return {n: (int(t[0]), float(t[1]), t[2:]) for n, t in out.items()}

    try:
        found = sums({})
        stats, middle, made, ended = {}, {}, {}, set()

        def note(totals: dict) -> None:
            for n, (size, squares, total) in totals.items():
                middle[n] = total / size
                stats[n] = (size, max(0.0, squares - size * float(middle[n] @ middle[n])))

        note(found)
        while True:
            order, wanted = _greedy(stats, made, ended, k)
            if not wanted:
                return SplitTree([(n, made[n]) for n in order], stats)
            trial = {n: _apart_start(n, middle[n], *stats[n]) for n in wanted}
            for _ in range(rounds):
                totals = sums(made | trial)
                moved = {n: np.stack([totals[c][2] / totals[c][0] if c in totals else trial[n][c - 2 * n] for c in (2 * n, 2 * n + 1)]) for n in wanted}
                settled = all(np.array_equal(moved[n], trial[n]) for n in wanted)
                trial = moved
                if settled:
                    break
            totals = sums(made | trial)
            for n in wanted:
                if 2 * n in totals and 2 * n + 1 in totals:
                    made[n] = trial[n]
                else:
                    ended.add(n)
            note({c: t for c, t in totals.items() if c // 2 in made and c not in stats})
    finally:
        table.unpersist()


def _greedy(stats: dict, made: dict, ended: set, k: int) -> tuple[list[int], list[int]]:
    """Splits in order, the largest divisible leaf first, and the leaves on that way that are not split yet."""
    leaves, order, wanted, count = [1] if stats else [], [], [], 1
    while count < k:
        able = [n for n in leaves if n not in ended and stats[n][0] > 1 and stats[n][1] > DIVISIBLE * stats[1][1]]
        if not able:
            break
        n = min(able, key=lambda n: (-stats[n][0], n))
        leaves.remove(n)
        count += 1
        if n in made:
            order.append(n)
            leaves += [2 * n, 2 * n + 1]
        else:
            wanted.append(n)
    return order, wanted


def _apart_start(node: int, middle: np.ndarray, size: int, error: float) -> np.ndarray:
    """Two centres a little to both sides of a node's middle, in a direction that depends on the node's number only."""
    step = np.random.default_rng(node).standard_normal(len(middle))
    step *= max(1e-4 * np.linalg.norm(middle), 1e-4 * np.sqrt(error / size)) / np.linalg.norm(step)
    return np.stack([middle - step, middle + step])


def error_by_k(vectors: DataFrame, ks: Iterable[int] = SWEEP) -> DataFrame:
    """``k, error`` for each k, read off one tree of splits, so that more clusters never have a larger error."""
    ks = list(ks)
    tree = split_tree(vectors, max(ks))
    return vectors.sparkSession.createDataFrame([(k, tree.error(k)) for k in ks], "k int, error double")


def pca_project(vectors: DataFrame, labels: DataFrame, k: int = 2) -> DataFrame:
    """Vectors times the leading principal components, not centred: ``eid, x, y, cluster``.

    The components come from passes over the non-zero entries at any width, and
    a vector of zeros keeps its row.
    """
    entries = vectors.select(
        PERSON, F.posexplode(vector_to_array("features")).alias("featureName", "value")
    ).where("value != 0")
    return pca_entries(entries, vectors.select(PERSON).join(labels, PERSON), k)
