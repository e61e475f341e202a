"""Exact top-k by inner product: score histograms are refined until each k-th value is known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenoweave.session import ship_package, stored

#: Bins of a histogram; a refinement divides the interval of the k-th score by so many.
BINS = 256
#: Queries and candidates, about, that meet in one task, and the least number of parts of either.
SLOT_QUERIES, GROUP_CANDIDATES, LEAST_PARTS = 4096, 16384, 4
#: Candidates packed into one row, and queries scored against them at a time.
BLOCK, STRIP = 4096, 512


def whole_numbers(vectors: DataFrame, id_column: str, column: str, scale: float = 64.0) -> DataFrame:
    """``id, vector`` with floor(scale * x) of every component as doubles.

    Rows without id and vectors that are null, empty or hold a null or non-finite component are left out.
    """
    x = F.col(column).cast("array<double>")
    sound = F.col(id_column).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("double"))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), scaled.alias("vector"))


def _packed(ids: np.ndarray, matrix: np.ndarray) -> tuple:
    small = not len(matrix) or np.abs(matrix).max() < 1 << 24
    return matrix.shape[1], ids.astype("<i8").tobytes(), small, matrix.astype("<f4" if small else "<f8").tobytes()


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, "<i8")
    return ids, np.frombuffer(row.data, "<f4" if row.small else "<f8").reshape(len(ids), row.dim)


def _blocks(vectors: DataFrame) -> DataFrame:
    """Candidates packed where they are read: up to BLOCK of one dimension in a row."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["vector"].map(len).to_numpy(dtype=np.int64)
            rows = []
            for dim in np.unique(sizes):
                part = frame[sizes == dim]
                for k in range(0, len(part), BLOCK):
                    piece = part.iloc[k : k + BLOCK]
                    matrix = np.stack(piece["vector"].to_numpy())
                    norm = float(np.sqrt((matrix * matrix).sum(axis=1).max()))
                    rows.append((*_packed(piece["id"].to_numpy(), matrix), norm, float(np.abs(matrix).max()), len(piece)))
            yield pd.DataFrame(rows, columns=["dim", "ids", "small", "data", "norm", "largest", "n"])

    return vectors.mapInPandas(pack, "dim int, ids binary, small boolean, data binary, norm double, largest double, n long")


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats while every sum is a whole number that they hold."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (queries.astype(kind) @ candidates.astype(kind).T).astype(np.int64)


def _scored(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple]:
    """Strips of scores: a slice of the query frame, its ids, the candidates' ids, scores, and whose pairs count."""
    states = [(_unpacked(q), pd.DataFrame({n: np.frombuffer(q[n], "<i8") for n in ("lo", "width", "above")})) for _, q in left.iterrows()]
    for c in right.itertuples():
        ids, matrix = _unpacked(c)
        for (own, vectors), state in states:
            if vectors.shape[1] != c.dim:
                continue
            for k in range(0, len(own), STRIP):
                part = own[k : k + STRIP]
                scores = _products(vectors[k : k + STRIP], matrix)
                valid = np.ones(scores.shape, bool)
                for i in np.flatnonzero(np.isin(part, ids)):
                    valid[i] = ids != part[i]
                yield state.iloc[k : k + STRIP], part, ids, scores, valid


def _best(scores: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Pairs that reach the k-th best of their query here; no other can be among its k best of all."""
    if scores.shape[1] <= k:
        return valid
    least = np.iinfo(np.int64).min
    shown = np.where(valid, scores, least)
    return valid & (shown >= np.partition(shown, -k, axis=1)[:, -k][:, None])


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products, ties to the smaller id.

    Both sides are ``id, vector`` of whole numbers. A candidate with the query's id is
    left out; a repeated query id is answered once, for its least vector, and
    repeated candidates count each. Only vectors of equal length are compared;
    where a side is empty there are no rows.

    Queries, in slots, meet candidates, in groups, so that a task holds a part of
    either. Every pass scores all pairs and sends on, per query and task, a
    histogram over the interval in which the k-th score is known to lie, until
    that interval is one value. The last pass keeps what is above it and, of the
    scores equal to it, the smallest ids that are still wanted.
    """
    spark = queries.sparkSession
    ship_package(spark)
    blocks = stored(_blocks(candidates), "candidate-blocks")
    size = blocks.agg(F.sum("n"), F.max("norm"), F.max("largest")).first()
    total, norm, largest = int(size[0] or 0), float(size[1] or 0), float(size[2] or 0)
    asked = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    highest = asked.agg(F.max(F.array_max(F.transform("vector", F.abs))), F.max(F.size("vector"))).first()
    if float(highest[0] or 0) * largest * float(highest[1] or 0) >= 1 << 61:
        raise ValueError("scores of these vectors do not fit a long")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    reach = (F.ceil(length * norm) + 1).cast("long")
    start = stored(asked.select("id", "vector", (-reach).alias("lo"), (2 * reach + 1).alias("width"), F.lit(0).cast("long").alias("above")), "queries")
    summary = start.agg(F.count("*"), F.max("width")).first()
    count, width = int(summary[0]), int(summary[1] or 1)
    slots = max(LEAST_PARTS, -(-count // SLOT_QUERIES))
    groups = max(LEAST_PARTS, -(-total // GROUP_CANDIDATES))
    dealt = blocks.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        sizes = frame["vector"].map(len).to_numpy()
        for dim in np.unique(sizes):
            part = frame[sizes == dim].sort_values("id")
            state = [part[n].to_numpy().astype("<i8").tobytes() for n in ("lo", "width", "above")]
            rows.append((key[0], *_packed(part["id"].to_numpy(), np.stack(part["vector"].to_numpy())), *state))
        return pd.DataFrame(rows, columns=["slot", "dim", "ids", "small", "data", "lo", "width", "above"])

    def tiles(state: DataFrame):
        keyed = state.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)))
        packed = keyed.groupBy("slot").applyInPandas(pack, "slot long, dim int, ids binary, small boolean, data binary, lo binary, width binary, above binary")
        spread = packed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        return spread.groupBy("slot", "group").cogroup(dealt.groupBy("slot", "group"))

    def histogram(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for state, ids, _, scores, valid in _scored(left, right):
            lo, wide = state["lo"].to_numpy()[:, None], state["width"].to_numpy()[:, None]
            step = -(-wide // BINS)
            keep = _best(scores, valid, k) & (scores >= lo) & (scores < lo + wide)
            at, _ = np.nonzero(keep)
            pairs, n = np.unique(at * BINS + ((scores - lo) // step)[keep], return_counts=True)
            found.append(pd.DataFrame({"id": ids[pairs // BINS], "bin": pairs % BINS, "n": n}))
        if not found:
            return pd.DataFrame({"id": [], "bin": [], "n": []}, dtype="int64")
        return pd.concat(found).groupby(["id", "bin"], as_index=False)["n"].sum()

    def matches(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for state, ids, others, scores, valid in _scored(left, right):
            lo, above = state["lo"].to_numpy()[:, None], state["above"].to_numpy()
            at, to = np.nonzero(valid & (scores > lo))
            found.append(pd.DataFrame({"query_id": ids[at], "vec_id": others[to], "score": scores[at, to]}))
            at, to = np.nonzero(valid & (scores == lo))
            equal = pd.DataFrame({"query_id": ids[at], "vec_id": others[to], "score": scores[at, to], "wanted": (k - above)[at]}).sort_values(["query_id", "vec_id"])
            found.append(equal[equal.groupby("query_id").cumcount() < equal["wanted"]].drop(columns="wanted"))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    state, done = start, start.limit(0)
    from_top = Window.partitionBy("id").orderBy(F.desc("bin"))
    while count and width > 1:
        bins = tiles(state).applyInPandas(histogram, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        # At most BINS rows a query: the first bin from the top at which k scores are reached.
        ranked = bins.withColumn("upto", F.sum("n").over(from_top)).groupBy("id").agg(F.collect_list(F.struct("bin", "n", "upto")).alias("bins"))
        joined = state.join(ranked, "id", "left")
        hit = F.array_max(F.filter("bins", lambda b: F.col("above") + b["upto"] >= k))
        step = F.ceil(F.col("width") / BINS).cast("long")
        found = joined.withColumn("hit", hit).withColumn("step", step)
        least = F.lit(-(1 << 62)).cast("long")
        refined = found.select(
            "id",
            "vector",
            F.when(F.col("hit").isNull(), least).otherwise(F.col("lo") + F.col("hit.bin") * F.col("step")).alias("lo"),
            F.when(F.col("hit").isNull(), F.lit(1)).otherwise(F.col("step")).cast("long").alias("width"),
            F.when(F.col("hit").isNull(), F.col("above")).otherwise(F.col("above") + F.col("hit.upto") - F.col("hit.n")).alias("above"),
        )
        state = stored(refined, "query-state")
        width = int(state.agg(F.max("width")).first()[0])
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        tiles(state)
        .applyInPandas(matches, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(by_rank).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
