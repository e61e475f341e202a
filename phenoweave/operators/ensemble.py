"""Many non-negative factorizations of one matrix at once.

A setting is a number of components with its penalties and its start. Settings
of equal k stand side by side in groups of bounded width; a block of persons and
a group make a unit of work. In a round every unit renews its part of ``W`` and
in the same pass takes the sums that the feature factors need; these are added
per group and give the new ``H``, the errors and the settings that have settled.
A round is one pass over the units and one small fold, however many settings
there are. Where all persons fit one block, nothing has to be gathered between
rounds, and every unit runs to its end by itself. Where the units fit the memory
of all tasks together, each task keeps its own and a barrier stage runs all
rounds, with nothing but sums exchanged; otherwise a round is a job. Where a task
can hold all entries and there are settings enough for all tasks, each task runs
its settings to their end and nothing is exchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext, Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave.functions.names import PERSON
from phenoweave.operators.blocks import DENSE_SHARE, Blocks, Rows, block_of, folded, lay_out
from phenoweave.operators.matrix import QUOTIENT_EPSILON, Matrix
from phenoweave.operators.sizing import BROADCAST_LIMIT_BYTES
from phenoweave.session import LARGE_ROW_FILES, large_rows, shared_folder, ship_package, stored

#: Columns of W that a unit holds, at most (one setting at least).
GROUP_COLUMNS = 512
#: Bytes of units that a task of a barrier stage keeps, at most.
HELD_BYTES = 256 << 20
#: Bytes of all entries and a group's persons with which a task runs a group by itself, at most, columns of each task, at least,
#: and of a group, at most, unless a setting has more.
ALONE_BYTES, ALONE_COLUMNS, ALONE_WIDTH = 384 << 20, 64, 128
#: Bytes of sums that all tasks exchange in a round, and runs of blocks whose sums are told apart, at most.
EXCHANGED_BYTES, SLICES = 16 << 20, 1024
#: Coordinates whose slopes are taken together.
COORDINATES = 8


@dataclass(frozen=True)
class Setting:
    """One factorization: ``k`` columns from position ``first`` of the given start, or drawn from ``seed``."""

    k: int
    l1: float = 0.0
    l2: float = 0.0
    seed: int | None = None
    first: int = 0


@dataclass(frozen=True)
class Rules:
    """How a round renews a factor and when a setting is done.

    ``tol`` ends a setting whose half squared error is at most that;
    ``relative_stop`` one whose projected gradient, summed over both factors as
    they are renewed, is at most that share of the first round's.
    """

    method: str
    max_iter: int
    tol: float
    relative_stop: float | None


# A factor is (settings, rows, k). Some of its rows are renewed at a time as (settings, k, rows), so that what is
# worked on stays in fast memory; their products with the other factor are the same, a Gram matrix (settings, k, k).


def _multiplied(x: np.ndarray, product: np.ndarray, gram: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x * product / (x G + penalties)``, entry by entry; its size of the gradient is not taken."""
    below = gram @ x
    below += (l1 + QUOTIENT_EPSILON)[:, None, None]
    if l2.any():
        below += l2[:, None, None] * x
    product *= x
    product /= below
    return product, np.zeros(len(x))


def _descended(x: np.ndarray, product: np.ndarray, gram: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimize over one coordinate after the other, the earlier ones already renewed, and add up the projected gradients.

    Slopes of COORDINATES are taken together and corrected by what those before among them moved.
    """
    moved = np.zeros(len(x))
    curve = np.diagonal(gram, axis1=1, axis2=2) + l2[:, None]
    curve = np.where(curve > 0, curve, np.inf)  # a flat coordinate stays
    for a in range(0, x.shape[1], COORDINATES):
        own = x[:, a : a + COORDINATES]
        slope = gram[:, a : a + COORDINATES] @ x
        slope -= product[:, a : a + COORDINATES]
        slope += l1[:, None, None]
        if l2.any():
            slope += l2[:, None, None] * own
        step = np.empty_like(slope)
        for i in range(own.shape[1]):
            if i:
                slope[:, i] += (gram[:, a + i, None, a : a + i] @ step[:, :i])[:, 0]
            np.divide(slope[:, i], -curve[:, a + i, None], out=step[:, i])
            np.maximum(step[:, i], -own[:, i], out=step[:, i])
        down = np.minimum(slope, 0.0)
        np.copyto(down, slope, where=own > 0)
        moved += np.abs(down, out=down).sum(axis=(1, 2))
        own += step
    return x, moved


UPDATES = {"multiplicative": _multiplied, "coordinate": _descended}


def _turned(x: np.ndarray) -> np.ndarray:
    """(settings, rows, k) as (settings, k, rows), and back; always a copy."""
    return x.transpose(0, 2, 1).copy()


def _coordinate(x: np.ndarray, product: np.ndarray, gram: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_descended` on a factor as it is."""
    out, moved = _descended(_turned(x), _turned(product), gram, l1, l2)
    return _turned(out), moved


def _side_by_side(x: np.ndarray) -> np.ndarray:
    """(settings, rows, k) as rows x all columns."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], x.shape[0] * x.shape[2])


def _apart(x: np.ndarray, settings: int) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(len(x), settings, -1).transpose(1, 0, 2))


def _person_half(rows: Rows, w: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """The persons of a block, renewed in place, and what the feature half needs of them: ``WᵀV``, ``WᵀW`` and the gradient, as one row of doubles."""
    n, _, k = w.shape
    features = h.transpose(0, 2, 1)
    both, columns = features @ h, np.ascontiguousarray(features).reshape(n * k, -1)
    sums, gram, moved = np.zeros(columns.shape), np.zeros((n, k, k)), np.zeros(n)
    for inside, part in rows.tiles(n * k):
        x = _turned(w[:, inside])
        x, slopes = UPDATES[rules.method](x, part.products(columns).reshape(x.shape), both, l1, l2)
        sums += part.sums(x.reshape(n * k, -1))
        gram += x @ x.transpose(0, 2, 1)
        moved += slopes
        w[:, inside] = x.transpose(0, 2, 1)
    return w, np.concatenate([sums.reshape(n, k, -1).transpose(0, 2, 1).ravel(), gram.ravel(), moved])


def _feature_half(total: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray, squares: float, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The renewed ``H``, half the squared error and the summed gradient of every setting."""
    n, k = len(h), h.shape[2]
    sums, gram, moved = (part.reshape(shape) for part, shape in zip(np.split(total, [h.size, h.size + n * k * k]), (h.shape, (n, k, k), (n,)), strict=True))
    renewed, moved_h = UPDATES[rules.method](_turned(h), _turned(sums), gram, l1, l2)
    h = _turned(renewed)
    both = gram * (renewed @ h)
    return h, 0.5 * (squares - 2 * (h * sums).sum(axis=(1, 2)) + both.sum(axis=(1, 2))), moved + moved_h


def _settled(error: np.ndarray, moved: np.ndarray, first: np.ndarray, rules: Rules) -> np.ndarray:
    done = error <= rules.tol
    return done | (moved <= rules.relative_stop * first) if rules.relative_stop is not None else done


def drawn(names: list[str], settings: list[Setting], side: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes of name, side, seed and column: (settings, names, k)."""
    return _drawn(_keys(names), settings, side)


def _keys(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)


def _drawn(keys: np.ndarray, settings: list[Setting], side: int) -> np.ndarray:
    out = np.empty((len(settings), len(keys), settings[0].k))
    for s, setting in enumerate(settings):
        columns = np.array([(2 * setting.seed + side << 16) + t + 1 for t in range(setting.k)], np.uint64)
        out[s] = ((_mixed(keys[:, None] ^ _mixed(columns)) >> np.uint64(12)) + 0.5) / (1 << 52)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass
class Ensemble:
    """Finished factorizations: ``errors[i]`` is half the squared error of setting ``i`` after each of its rounds."""

    blocks: Blocks
    settings: list[Setting]
    groups: list[list[int]]
    state: DataFrame  # block, group, w: doubles as bytes (settings of the group, persons of the block, k)
    h: list[np.ndarray]
    errors: list[list[float]] = field(default_factory=list)

    def place(self, setting: int) -> tuple[int, int]:
        """Group of a setting and its place there."""
        return next((g, group.index(setting)) for g, group in enumerate(self.groups) if setting in group)

    def person_factor(self, settings: list[int]) -> DataFrame:
        """``eid, w`` with the columns of settings of one group side by side."""
        group, _ = self.place(settings[0])
        own, n, k = [self.groups[group].index(s) for s in settings], len(self.groups[group]), self.settings[settings[0]].k

        def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for persons, w in zip(frame["persons"], frame["w"], strict=True):
                    x = np.frombuffer(w).reshape(n, len(persons), k)[own]
                    yield pd.DataFrame({PERSON: persons, "w": list(_side_by_side(x))})

        rows = self.state.where(F.col("group") == group).join(self.blocks.table.select("block", "persons"), "block")
        return rows.select("persons", "w").mapInPandas(opened, f"{PERSON} string, w array<double>")

    def feature_factor(self, settings: list[int]) -> DataFrame:
        """``featureName, h`` with the columns of settings of one group side by side."""
        group, _ = self.place(settings[0])
        own = [self.groups[group].index(s) for s in settings]
        rows = list(zip(self.blocks.names, _side_by_side(self.h[group][own]).tolist(), strict=True))
        return self.blocks.table.sparkSession.createDataFrame(rows, "featureName string, h array<double>")

    def weights(self, setting: int) -> np.ndarray:
        """``H`` of a setting: features x k."""
        group, place = self.place(setting)
        return self.h[group][place]


def grouped(settings: list[Setting], columns: int = GROUP_COLUMNS) -> list[list[int]]:
    """Positions of settings of equal k, in groups of at most ``columns`` columns."""
    by_k: dict[int, list[int]] = {}
    for i, setting in enumerate(settings):
        by_k.setdefault(setting.k, []).append(i)
    groups = []
    for k, members in sorted(by_k.items()):
        size = max(1, columns // k)
        groups += [members[a : a + size] for a in range(0, len(members), size)]
    return groups


def widest(settings: list[Setting], columns: int = GROUP_COLUMNS) -> int:
    """Columns of the widest group."""
    return max((len(g) * settings[g[0]].k for g in grouped(settings, columns)), default=1)


def batches(settings: list[Setting], features: int) -> list[list[Setting]]:
    """Settings in runs whose feature factors can be broadcast together."""
    out, width = [], None
    for setting in sorted(settings, key=lambda s: s.k):
        if width is None or 8 * features * (width + setting.k) > BROADCAST_LIMIT_BYTES:
            out, width = [*out, []], 0
        out[-1].append(setting)
        width += setting.k
    return out


def factorize_all(
    m: Matrix,
    settings: list[Setting],
    rules: Rules,
    start: tuple[DataFrame, ...] | None = None,
    blocks: Blocks | None = None,
    columns: int = GROUP_COLUMNS,
) -> Ensemble:
    """Run all settings to their end; ``start`` holds the vectors ``eid, w`` and ``featureName, h`` that settings without seed begin with.

    A third table ``featureName, q`` says that ``w`` are the entries times ``q``,
    the first column without its sign and the others cut at 0.

    The feature factors of all settings together must be small enough to be
    broadcast (:func:`batches`). Nothing is random but by seed. A lost executor
    costs the barrier stage of the settings at hand. Where units are too large
    to be kept by tasks it costs the round at hand: every round is written to the
    shared folder, into one of two tables by turns, so that no more than two are kept.
    """
    spark = m.spark
    ship_package(spark)
    blocks = blocks or lay_out(m, widest(settings, columns))
    slots = _slots(spark) if blocks.count > 1 else 0
    alone = _alone_columns(blocks, settings, slots or spark.sparkContext.defaultParallelism) if start is None or len(start) > 2 else 0
    groups = grouped(settings, min(columns, alone or columns))
    parts = [[settings[i] for i in group] for group in groups]
    penalties = [(np.array([s.l1 for s in part]), np.array([s.l2 for s in part])) for part in parts]
    h = _feature_starts(blocks.names, parts, start)
    sizes = (len(blocks.names), blocks.squares)
    if alone:
        with large_rows(spark):
            state, errors = _alone(blocks, parts, slots or spark.sparkContext.defaultParallelism, h, start, penalties, sizes, rules)
        return _finished(blocks, settings, groups, state, h, errors)
    spread = _spread(blocks, parts, start)
    runs = _kept_together(blocks, h, slots)
    with large_rows(spark):
        if runs:
            state, errors = _in_step(blocks, spread, parts, runs, slots, h, penalties, sizes, rules)
        elif blocks.count == 1:
            state, errors = _whole(_units(blocks, spread, parts), h, penalties, sizes, rules)
        else:
            state, errors = _by_rounds(blocks, _units(blocks, spread, parts), h, penalties, sizes, rules)
    return _finished(blocks, settings, groups, state, h, errors)


def _finished(blocks: Blocks, settings: list[Setting], groups: list[list[int]], state: DataFrame, h: list[np.ndarray], errors: list) -> Ensemble:
    out = Ensemble(blocks, settings, groups, state, h, [[] for _ in settings])
    for group, found in zip(groups, errors, strict=True):
        for i, own in zip(group, found, strict=True):
            out.errors[i] = own
    return out


def _feature_starts(names: list[str], parts: list[list[Setting]], start: tuple[DataFrame, ...] | None) -> list[np.ndarray]:
    vectors = _vectors(names, start[1], max(s.first + s.k for part in parts for s in part)) if start else None
    return [drawn(names, part, 1) if part[0].seed is not None else np.stack([vectors[:, s.first : s.first + s.k] for s in part]) for part in parts]


def _vectors(names: list[str], table: DataFrame, width: int) -> np.ndarray:
    given = {r[0]: r[1] for r in table.collect()}
    return np.array([given[n][:width] for n in names], float).reshape(len(names), width)


def _spread(blocks: Blocks, parts: list[list[Setting]], start: tuple[DataFrame, ...] | None) -> DataFrame:
    """``block, group, persons, starts, columns, numbers, given``: every block with every group, and the start vectors of its persons."""
    table = blocks.table
    if start:
        def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(PERSON)
            return pd.DataFrame({"block": [key[0]], "given": [np.stack(frame["w"].to_numpy()).astype(float).tobytes()]})

        given = start[0].select(block_of(blocks.count).alias("block"), PERSON, "w").groupBy("block").applyInPandas(packed, "block int, given binary")
        table = table.join(stored(given, "start"), "block")
    else:
        table = table.withColumn("given", F.lit(None).cast("binary"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))).alias("group")
    return table.select("block", every, "persons", "starts", "columns", "numbers", "given")


def _begun(part: list[Setting], persons: np.ndarray, given: bytes | None) -> np.ndarray:
    """The first person factor of a unit."""
    if part[0].seed is not None:
        return drawn(list(persons), part, 0)
    vectors = np.frombuffer(given).reshape(len(persons), -1)
    return np.stack([vectors[:, s.first : s.first + s.k] for s in part])


def _units(blocks: Blocks, spread: DataFrame, parts: list[list[Setting]]) -> DataFrame:
    """``block, group, persons, starts, columns, numbers, w``: every block with every group's first person factor."""

    def begun(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            first = [_begun(parts[u.group], u.persons, u.given).tobytes() for u in frame.itertuples()]
            yield frame.drop(columns="given").assign(w=first)

    many = min(blocks.count * len(parts), 4 * spread.sparkSession.sparkContext.defaultParallelism)
    spread = spread.repartition(max(many, -(-blocks.count * len(parts) // 64)), "block", "group")
    return spread.mapInPandas(begun, "block int, group int, persons array<string>, starts binary, columns binary, numbers binary, w binary")


def _slots(spark: SparkSession) -> int:
    """Tasks that surely run at the same time, 0 where executors come and go."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    known = sc._jsc.sc()
    return known.maxNumConcurrentTasks(known.resourceProfileManager().defaultResourceProfile())


def _kept_together(blocks: Blocks, h: list[np.ndarray], slots: int) -> list[list[int]]:
    """Groups in runs whose units all tasks together can keep; none where a single group is too large."""
    if not slots:
        return []
    features, entries = len(blocks.names), blocks.entries_per_person * blocks.persons
    cells = blocks.persons * features
    opened = 8 * (cells if cells <= DENSE_SHARE * entries else max(3, DENSE_SHARE) * entries)  # dense blocks drop their entries
    runs, room = [], 0.0
    for g, x in enumerate(h):
        size = opened + 8 * blocks.persons * x.shape[0] * x.shape[2]
        if size > slots * HELD_BYTES or _exchanged(x) > EXCHANGED_BYTES:
            return []
        if not runs or size > room or sum(_exchanged(h[o]) for o in [*runs[-1], g]) > EXCHANGED_BYTES:
            runs, room = [*runs, []], float(slots * HELD_BYTES)
        runs[-1].append(g)
        room -= size
    return runs


def _exchanged(x: np.ndarray) -> int:
    """Bytes of the sums that the feature half of a group needs."""
    return 8 * (x.size + x.shape[0] * x.shape[2] ** 2 + x.shape[0])


def _whole(units: DataFrame, h: list[np.ndarray], penalties: list, sizes: tuple[int, float], rules: Rules) -> tuple[DataFrame, list]:
    """All rounds of every group inside its task, for persons of a single block. ``h`` is renewed."""
    spark = units.sparkSession
    features, squares = sizes
    held = spark.sparkContext.broadcast(h)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for unit in frame.itertuples():
                x, (l1, l2) = held.value[unit.group].copy(), penalties[unit.group]
                rows = Rows.of(unit.starts, unit.columns, unit.numbers, features)
                w = np.frombuffer(unit.w).reshape(len(x), rows.persons, -1).copy()
                active, first, errors = np.arange(len(x)), None, [[] for _ in x]
                for _ in range(rules.max_iter):
                    w[active], total = _person_half(rows, w[active], x[active], l1[active], l2[active], rules)
                    x[active], error, moved = _feature_half(total, x[active], l1[active], l2[active], squares, rules)
                    first = moved if first is None else first
                    for i, e in zip(active, error, strict=True):
                        errors[i].append(float(e))
                    active = active[~_settled(error, moved, first[active], rules)]
                    if not len(active):
                        break
                yield pd.DataFrame({"block": [unit.block], "group": [unit.group], "w": [w.tobytes()], "h": [x.tobytes()], "errors": [errors]})

    path = shared_folder(spark, "factors")
    units.select("block", "group", "starts", "columns", "numbers", "w").mapInPandas(
        run, "block int, group int, w binary, h binary, errors array<array<double>>"
    ).write.options(**LARGE_ROW_FILES).parquet(path)
    held.destroy()
    done = spark.read.parquet(path)
    errors: list = [[[]] for _ in h]
    for r in done.select("group", "h", "errors").collect():  # one row per group
        h[r["group"]] = np.frombuffer(r["h"]).reshape(h[r["group"]].shape)
        errors[r["group"]] = r["errors"]
    return done.select("block", "group", "w"), errors


def _alone_columns(blocks: Blocks, settings: list[Setting], slots: int) -> int:
    """Columns of a group that a task can run with all entries beside it; 0 where a setting is too wide or there are too few to keep the tasks busy."""
    columns, most = sum(s.k for s in settings), max((s.k for s in settings), default=1)
    if blocks.count == 1 or columns < slots * max(most, ALONE_COLUMNS):
        return 0
    entries = blocks.entries_per_person * blocks.persons
    cells = blocks.persons * len(blocks.names)
    size = 2 * cells if cells <= DENSE_SHARE * entries else 8 * 3 * entries  # dense blocks as places of their numbers, at least
    room = int((ALONE_BYTES - size) // (8 * blocks.persons))
    return max(most, min(room, ALONE_WIDTH, columns // (4 * slots))) if room >= most else 0


def _alone(
    blocks: Blocks, parts: list[list[Setting]], slots: int, h: list[np.ndarray], start: tuple[DataFrame, ...] | None, penalties: list, sizes: tuple[int, float], rules: Rules
) -> tuple[DataFrame, list]:
    """All rounds of every group inside a task that holds all entries. ``h`` is renewed."""
    spark = blocks.table.sparkSession
    features, squares = sizes
    tasks = min(slots, len(parts))
    place = _dealt([(x.shape[0] * x.shape[2], g, 0) for g, x in enumerate(h)], tasks)
    seeded = any(part[0].seed is not None for part in parts)
    width = max(s.first + s.k for part in parts for s in part)
    held = spark.sparkContext.broadcast((h, _vectors(blocks.names, start[2], width) if start else None))

    def begun(part: list[Setting], rows: Rows, keys: np.ndarray | None) -> np.ndarray:
        if part[0].seed is not None:
            return _drawn(keys, part, 0)
        found = np.concatenate([tile.products(held.value[1].T).T for _, tile in rows.tiles(width)])
        found[:, 0] = np.abs(found[:, 0])
        np.maximum(found[:, 1:], 0.0, out=found[:, 1:])
        return np.stack([found[:, s.first : s.first + s.k] for s in part])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, task = [], 0
        for frame in frames:
            for u in frame.itertuples():
                units.append((u.block, Rows.of(u.starts, u.columns, u.numbers, features).coded(), _keys(u.persons) if seeded else None))
                task = u.task
        units.sort(key=lambda u: u[0])
        for g in sorted(g for (g, _), t in place.items() if t == task and units):
            x, (l1, l2) = held.value[0][g].copy(), penalties[g]
            factors = [begun(parts[g], rows, keys) for _, rows, keys in units]
            active, first, errors = np.arange(len(x)), None, [[] for _ in x]
            for _ in range(rules.max_iter):
                total, every = 0.0, len(active) == len(x)
                for i, (_, rows, _) in enumerate(units):
                    w = factors[i]
                    renewed, sums = _person_half(rows, w if every else w[active], x[active], l1[active], l2[active], rules)
                    if every:
                        factors[i] = renewed
                    else:
                        w[active] = renewed
                    total = total + sums
                x[active], error, moved = _feature_half(total, x[active], l1[active], l2[active], squares, rules)
                first = moved if first is None else first
                for i, e in zip(active, error, strict=True):
                    errors[i].append(float(e))
                active = active[~_settled(error, moved, first[active], rules)]
                if not len(active):
                    break
            for i, (block, _, _) in enumerate(units):
                yield pd.DataFrame({"block": [block], "group": [g], "w": [factors[i].tobytes()], "h": [None], "errors": [None]})
                factors[i] = None
            yield pd.DataFrame({"block": [-1], "group": [g], "w": [None], "h": [x.tobytes()], "errors": [errors]})

    table = blocks.table.select("block", "persons" if seeded else F.lit(None).alias("persons"), "starts", "columns", "numbers")
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    path = shared_folder(spark, "factors")
    table.select("*", every).repartitionById(tasks, F.col("task")).mapInPandas(
        run, "block int, group int, w binary, h binary, errors array<array<double>>"
    ).write.options(**LARGE_ROW_FILES).parquet(path)
    held.destroy()
    done = spark.read.parquet(path)
    errors: list = [[[]] for _ in h]
    for r in done.where("block < 0").select("group", "h", "errors").collect():  # one row per group
        h[r["group"]] = np.frombuffer(r["h"]).reshape(h[r["group"]].shape)
        errors[r["group"]] = r["errors"]
    return done.where("block >= 0").select("block", "group", "w"), errors


def _in_step(
    blocks: Blocks, spread: DataFrame, parts: list[list[Setting]], runs: list[list[int]], slots: int, h: list[np.ndarray], penalties: list, sizes: tuple[int, float], rules: Rules
) -> tuple[DataFrame, list]:
    """All rounds of a run of groups in one barrier stage after the other. ``h`` is renewed.

    Every task keeps its units from the first round to the last. After each pass
    the tasks exchange the sums of their slices, runs of consecutive blocks that
    depend on the data alone, and each adds them in the order of the slices.
    """
    spark = spread.sparkSession
    errors: list = [[[] for _ in x] for x in h]
    paths = []
    for run in runs:
        slices = max(1, min(blocks.count, SLICES, EXCHANGED_BYTES // sum(_exchanged(h[g]) for g in run)))
        pairs = [(g, s) for g in run for s in range(slices)]
        tasks = min(slots, len(pairs))
        place = _dealt([(h[g].shape[0] * h[g].shape[2], g, s) for g, s in pairs], tasks)
        held = spark.sparkContext.broadcast({g: h[g] for g in run})
        part = F.expr(f"cast(block * {slices}L div {blocks.count} AS int)")
        task = F.element_at(F.lit([place.get((g, s), 0) for g in range(run[0], run[-1] + 1) for s in range(slices)]), (F.col("group") - run[0]) * slices + F.col("slice") + 1)
        own = spread.where(F.col("group").between(run[0], run[-1])).withColumn("slice", part).repartitionById(tasks, task.cast("int"))
        paths.append(shared_folder(spark, "factors"))
        own.mapInPandas(
            _to_the_end(held, parts, penalties, sizes, rules), "block int, group int, w binary, h binary, errors array<array<double>>", barrier=True
        ).write.options(**LARGE_ROW_FILES).parquet(paths[-1])
        held.destroy()
        for r in spark.read.parquet(paths[-1]).where("block < 0").select("group", "h", "errors").collect():  # one row per group
            h[r["group"]] = np.frombuffer(r["h"]).reshape(h[r["group"]].shape)
            errors[r["group"]] = r["errors"]
    return spark.read.parquet(*paths).where("block >= 0").select("block", "group", "w"), errors


def _dealt(costs: list[tuple[int, int, int]], tasks: int) -> dict[tuple[int, int], int]:
    """A task for every ``(cost, group, slice)``, the costly ones first, each to the task with least to do."""
    load, place = [(0, t) for t in range(tasks)], {}
    for cost, group, part in sorted(costs, key=lambda c: (-c[0], c[1:])):
        least, t = heapq.heappop(load)
        place[group, part] = t
        heapq.heappush(load, (least + cost, t))
    return place


def _to_the_end(held: Broadcast, parts: list[list[Setting]], penalties: list, sizes: tuple[int, float], rules: Rules):
    features, squares = sizes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        opened, units = {}, []
        for frame in frames:
            for u in frame.itertuples():
                if u.block not in opened:
                    opened[u.block] = Rows.of(u.starts, u.columns, u.numbers, features).lean()
                units.append([u.group, u.slice, u.block, _begun(parts[u.group], u.persons, u.given)])
        units.sort(key=lambda u: u[:3])
        h = {g: x.copy() for g, x in held.value.items()}
        active = {g: np.arange(len(x)) for g, x in h.items()}
        errors, first = {g: [[] for _ in x] for g, x in h.items()}, {}
        for _ in range(rules.max_iter):
            sums: dict = {}
            for unit in units:
                group, part, block, w = unit
                own, (l1, l2) = active[group], penalties[group]
                if len(own) == len(w):
                    unit[3], total = _person_half(opened[block], w, h[group], l1, l2, rules)
                elif len(own):
                    w[own], total = _person_half(opened[block], w[own], h[group][own], l1[own], l2[own], rules)
                else:
                    continue
                sums[group, part] = sums[group, part] + total if (group, part) in sums else total
            everywhere: dict = {}
            for told in context.allGather(base64.b64encode(pickle.dumps(sums)).decode()):
                everywhere |= pickle.loads(base64.b64decode(told))
            totals: dict = {}
            for (group, _), total in sorted(everywhere.items(), key=lambda s: s[0]):
                totals[group] = totals[group] + total if group in totals else total
            for g, total in totals.items():
                own, (l1, l2) = active[g], penalties[g]
                h[g][own], error, moved = _feature_half(total, h[g][own], l1[own], l2[own], squares, rules)
                first.setdefault(g, moved)
                for i, e in zip(own, error, strict=True):
                    errors[g][i].append(float(e))
                active[g] = own[~_settled(error, moved, first[g][own], rules)]
            if not any(len(a) for a in active.values()):
                break
        for group, _, block, w in units:
            yield pd.DataFrame({"block": [block], "group": [group], "w": [w.tobytes()], "h": [None], "errors": [None]})
        if context.partitionId() == 0:
            for g, x in h.items():
                yield pd.DataFrame({"block": [-1], "group": [g], "w": [None], "h": [x.tobytes()], "errors": [errors[g]]})

    return run


def _by_rounds(
    blocks: Blocks, units: DataFrame, h: list[np.ndarray], penalties: list, sizes: tuple[int, float], rules: Rules
) -> tuple[DataFrame, list]:
    """Round by round over all units. ``h`` is renewed.

    Where the factor is wider than the entries, the entries travel with it and
    nothing is shuffled but sums; otherwise they stay laid out by block and the
    narrow factor comes to them.
    """
    spark = units.sparkSession
    carried = sum(x.shape[0] * x.shape[2] for x in h) >= blocks.entries_per_person
    kept = ["starts", "columns", "numbers"] if carried else []
    fixed = None if carried else blocks.laid()
    schema = "block int, group int, " + "".join(f"{c} binary, " for c in kept) + "w binary, sums binary"
    turns = [shared_folder(spark, "round") for _ in range(2)]
    units.select("block", "group", *kept, "w").write.options(**LARGE_ROW_FILES).parquet(turns[0])
    read = f"block int, group int, {''.join(f'{c} binary, ' for c in kept)}w binary"
    active = [np.arange(len(x)) for x in h]
    first: list = [None] * len(h)
    errors = [[[] for _ in x] for x in h]
    count = 0
    while count < rules.max_iter and any(len(a) for a in active):
        state = spark.read.schema(read).parquet(turns[count % 2])
        if fixed is not None:
            state = fixed.select("block", "starts", "columns", "numbers").join(state.hint("merge"), "block")
        held = spark.sparkContext.broadcast((h, active))
        state.select("block", "group", "starts", "columns", "numbers", "w").mapInPandas(_step(held, penalties, sizes[0], kept, rules), schema).write.options(
            **LARGE_ROW_FILES
        ).mode("overwrite").parquet(turns[(count + 1) % 2])
        sums = spark.read.schema(schema).parquet(turns[(count + 1) % 2]).where("sums is not null")
        ends = folded(sums.select(F.col("group").alias("key"), "block", "sums"), blocks.count, _end(held, penalties, sizes[1], rules), "key int, h binary, error binary, moved binary")
        for r in ends.collect():  # one row per group that still moves
            g, error, moved = r["key"], np.frombuffer(r["error"]), np.frombuffer(r["moved"])
            h[g] = h[g].copy()
            h[g][active[g]] = np.frombuffer(r["h"]).reshape(len(active[g]), *h[g].shape[1:])
            first[g] = moved if first[g] is None else first[g]
            for i, e in zip(active[g], error, strict=True):
                errors[g][i].append(float(e))
            active[g] = active[g][~_settled(error, moved, first[g][active[g]], rules)]
        held.destroy()
        count += 1
    if fixed is not None:
        fixed.unpersist()
    done = spark.read.schema(read).parquet(turns[count % 2])
    if count:  # the round before is no longer needed
        done.limit(0).write.mode("overwrite").parquet(turns[(count + 1) % 2])
    return done.select("block", "group", "w"), errors


def _step(held: Broadcast, penalties: list, features: int, kept: list[str], rules: Rules):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, active = held.value
        for frame in frames:
            factors, sums = [], []
            for unit in frame.itertuples():
                own, (l1, l2) = active[unit.group], penalties[unit.group]
                if not len(own):
                    factors.append(unit.w)
                    sums.append(None)
                    continue
                rows = Rows.of(unit.starts, unit.columns, unit.numbers, features)
                x = h[unit.group]
                w = np.frombuffer(unit.w).reshape(len(x), rows.persons, -1).copy()
                w[own], total = _person_half(rows, w[own], x[own], l1[own], l2[own], rules)
                factors.append(w.tobytes())
                sums.append(total.tobytes())
            yield frame[["block", "group", *kept]].assign(w=factors, sums=sums)

    return run


def _end(held: Broadcast, penalties: list, squares: float, rules: Rules):
    def run(group: int, total: np.ndarray) -> dict:
        h, active = held.value
        own, (l1, l2) = active[group], penalties[group]
        x, error, moved = _feature_half(total, h[group][own], l1[own], l2[own], squares, rules)
        return {"key": group, "h": x.tobytes(), "error": error.tobytes(), "moved": moved.tobytes()}

    return run


# Scores over all settings


def total_dissimilarities(e: Ensemble, halved: bool = False) -> dict[int, float]:
    """Per k the sum over all ordered pairs of its settings of how far their person factors are apart.

    Tiles of the products of all columns of two groups are summed over the
    blocks; each gives the correlations of its pairs of settings, and one number
    of it leaves the task. A constant column correlates with none.
    """
    counts = [len(g) for g in e.groups]
    ks = [e.settings[g[0]].k for g in e.groups]
    persons, m = e.blocks.persons, len(e.groups)

    def tiles(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        k = int(key[1])
        columns = {g: _side_by_side(np.frombuffer(w).reshape(counts[g], -1, k)) for g, w in zip(frame["group"], frame["w"], strict=True)}
        out = []
        for a, x in sorted(columns.items()):
            for b, y in sorted(columns.items()):
                if a <= b:
                    total = np.concatenate([(x.T @ y).ravel(), x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0)])
                    out.append({"key": a * m + b, "block": key[0], "sums": total.tobytes()})
        return pd.DataFrame(out)

    def end(key: int, total: np.ndarray) -> dict:
        a, b = divmod(key, m)
        k, na, nb = ks[a], counts[a] * ks[a], counts[b] * ks[b]
        xy, sx, sy, qx, qy = np.split(total, np.cumsum([na * nb, na, nb, na]))
        spread = lambda q, s: np.sqrt(np.maximum(q - s * s / persons, 0.0))
        scale = np.outer(spread(qx, sx), spread(qy, sy))
        covariance = xy.reshape(na, nb) - np.outer(sx, sy) / persons
        close = np.divide(covariance, scale, out=np.zeros_like(scale), where=scale > 0).reshape(counts[a], k, counts[b], k)
        apart = np.abs(2 * k - close.max(axis=1).sum(axis=2) - close.max(axis=3).sum(axis=1)) / (2 * k if halved else k)
        return {"k": k, "total": float(apart.sum()) * (1 if a == b else 2)}

    of_k = F.element_at(F.lit(ks), F.col("group") + 1).cast("int")
    keyed = e.state.withColumn("k", of_k).groupBy("block", "k").applyInPandas(tiles, "key int, block int, sums binary")
    found = folded(keyed, e.blocks.count, end, "k int, total double").collect()  # one number per pair of groups
    return {k: float(sum(r["total"] for r in sorted(found) if r["k"] == k)) for k in sorted(set(ks))}


def _labels(w: np.ndarray) -> np.ndarray:
    """The strongest component of every setting and person, the first one on ties."""
    return w.argmax(axis=2)


def silhouettes(e: Ensemble, metric: str = "cosine") -> DataFrame:
    """``setting, eid, label, silhouette`` of every setting's assignment on ``cosine`` or ``sqeuclidean`` distance.

    Exact and without pairs of persons, as in :mod:`quality`: one pass takes the
    mean vectors of all clusters of all settings, a second one the distances.
    Persons of length 0 have no cosine and are left out; an only cluster leaves
    the score undefined.
    """
    if metric not in ("cosine", "sqeuclidean"):
        raise ValueError("metric must be cosine or sqeuclidean")
    spark, unit = e.blocks.table.sparkSession, metric == "cosine"
    ship_package(spark)
    features, groups = len(e.blocks.names), e.groups
    counts, ks = [len(g) for g in groups], [e.settings[g[0]].k for g in groups]
    rows = e.blocks.table.join(e.state, "block").select("block", "group", "persons", "starts", "columns", "numbers", "w")

    def opened(unit_row) -> tuple[Rows, np.ndarray, np.ndarray]:
        """Entries, labels (settings, persons) and squared lengths of the persons that are scored."""
        entries = Rows.of(unit_row.starts, unit_row.columns, unit_row.numbers, features)
        labels = _labels(np.frombuffer(unit_row.w).reshape(counts[unit_row.group], entries.persons, -1))
        return entries, labels, entries.squares()

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                entries, labels, squares = opened(r)
                there = squares > 0 if unit else np.ones(entries.persons, bool)
                member = (labels[:, :, None] == np.arange(ks[r.group])) & there[None, :, None]
                member = _side_by_side(member.astype(float))
                total = (entries.unit() if unit else entries).transposed_times(member)
                out.append({"key": r.group, "block": r.block, "sums": np.concatenate([total.ravel(), member.sum(0), squares @ member]).tobytes()})
            yield pd.DataFrame(out)

    totals = folded(rows.mapInPandas(sums, "key int, block int, sums binary"), e.blocks.count, lambda key, total: {"key": key, "sums": total.tobytes()}, "key int, sums binary")
    means = {}
    with large_rows(spark):
        found = totals.collect()  # as large as the feature factors
    for r in found:
        width = counts[r["key"]] * ks[r["key"]]
        total, size, squares = np.split(np.frombuffer(r["sums"]), [features * width, features * width + width])
        means[r["key"]] = (total.reshape(features, width) / np.maximum(size, 1.0), size, squares / np.maximum(size, 1.0))
    held = spark.sparkContext.broadcast(means)

    def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                entries, labels, squares = opened(r)
                mean, size, lengths = held.value[r.group]
                near = (entries.unit() if unit else entries).times(mean)
                away = 1 - near if unit else squares[:, None] - 2 * near + lengths
                away = _apart(away, counts[r.group])
                there = np.flatnonzero(squares > 0) if unit else np.arange(entries.persons)
                for s, label in enumerate(labels):
                    value = _standard(away[s], label, size.reshape(counts[r.group], -1)[s])
                    yield pd.DataFrame({"setting": groups[r.group][s], PERSON: np.asarray(r.persons, object)[there], "label": label[there], "silhouette": value[there]})

    # NaN is what pandas makes of an undefined score
    out = rows.mapInPandas(scores, f"setting int, {PERSON} string, label int, silhouette double")
    with large_rows(spark):
        return stored(out.withColumn("silhouette", F.nanvl("silhouette", F.lit(None))), "silhouettes")


def _standard(away: np.ndarray, label: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Silhouettes from mean distances to all clusters, the person itself taken out of its own; NaN with a single cluster."""
    place, own = np.arange(len(label)), size[label]
    a = away[place, label] * own / np.maximum(own - 1, 1.0)
    others = np.where(size > 0, away, np.inf)
    others[place, label] = np.inf
    b = others.min(axis=1)
    largest = np.maximum(a, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(largest == 0, 0.0, (b - a) / largest)
    return np.where(own == 1, 0.0, np.where(np.isfinite(b), score, np.nan))


def labels_used(e: Ensemble) -> dict[int, int]:
    """Per setting how many components are some person's strongest."""
    counts, groups = [len(g) for g in e.groups], e.groups

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, w in zip(frame["group"], frame["w"], strict=True):
                k = e_ks[group]
                labels = _labels(np.frombuffer(w).reshape(counts[group], -1, k))
                for s, own in enumerate(labels):
                    yield pd.DataFrame({"setting": groups[group][s], "label": np.unique(own)})

    e_ks = [e.settings[g[0]].k for g in groups]
    rows = e.state.select("group", "w").mapInPandas(found, "setting int, label int").groupBy("setting").agg(F.countDistinct("label").alias("n"))
    with large_rows(e.state.sparkSession):
        return {r["setting"]: r["n"] for r in rows.collect()}  # one per setting
