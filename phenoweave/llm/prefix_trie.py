"""Prefix trie of turn sequences, its subtree totals by time-forward processing.

A sequence is a path: the turns' units, each UNIT bytes of digest and length, one
after the other. Paths sorted as bytes bring every node's members together. Shards
are ranges of that order, so they cut hot turns and copies of one sequence as
well. In a shard nodes are sorted by Spark in reverse level order; each one meets
the totals of its children in a priority queue, which spills, and sends its own
to its parent. Nodes that touch the end of a shard may go on in the next one: they
leave it as parts, which are settled the same way over runs of FAN shards, until
one run holds all.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoweave.llm.common import sized_join
from phenoweave.session import ship_package, stored

#: Bytes of a turn in a path: a digest of role and text, and the text's code points.
DIGEST, UNIT = 16, 20
#: Turns of a shard, at most about, and about as few as are worth a task of their own.
SHARD_TURNS, LEAST_TURNS = 1 << 20, 1 << 13
#: Shards or runs of shards that one task settles together.
FAN = 256
#: Messages that a queue holds in memory, and members' ids in one row.
QUEUE, CHUNK = 1 << 16, 1 << 16

_PART, _ENDS, _NODE = 0, 1, 2
_SCHEMA = (
    "kind int, depth long, key binary, parent binary, shard long, place long, first boolean, last boolean, "
    "conv_id long, parent_conv_id long, n_convs long, chars long, n_children long, n_leaves long, saved_tokens long, ends binary"
)
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]
_BLANK = {c: 0 for c in ("shard", "place", "conv_id", "n_convs", "chars", "n_children", "n_leaves", "saved_tokens")} | {"first": False, "last": False}


def turn_unit(role: str = "role", text: str = "text"):
    """The unit of a turn; a null role or text counts as empty."""
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.sha2(role.cast("binary"), 256), text).cast("binary"), 256)
    return F.concat(F.unhex(F.substring(digest, 1, 2 * DIGEST)), F.unhex(F.lpad(F.hex(F.length(text)), 2 * (UNIT - DIGEST), "0")))


def paths(turns: DataFrame, base, head) -> DataFrame:
    """``conv_id, path``: of every conversation the first ``head`` turns of conversation ``base``, then its own turns after as many.

    ``turns`` holds ``conv_id, turn, role, text``; a base that is absent gives
    no turns. Turns are taken by number, null first; those of equal number by
    role, then by digest of the turn. Rows without id belong to no conversation.
    Conversations of one base meet in one task, which streams through them and
    holds one and the base's at a time.
    """
    ship_package(turns.sparkSession)
    own = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), base.cast("long").alias("base"), head.cast("int").alias("head"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), turn_unit().alias("unit"),
    )
    ordered = own.repartition("base").sortWithinPartitions(
        "base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "unit"
    )

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, units, opening = None, [], (None, b"")
        for frame in frames:
            out = []
            for row in zip(frame["base"], frame["conv_id"], frame["head"], frame["unit"], strict=True):
                if row[:3] != now:
                    if now is not None:
                        opening = _built(now, b"".join(units), opening, out)
                    now, units = row[:3], []
                units.append(row[3])
            yield pd.DataFrame(out, columns=["conv_id", "path"])
        if now is not None:
            out = []
            _built(now, b"".join(units), opening, out)
            yield pd.DataFrame(out, columns=["conv_id", "path"])

    return ordered.select("base", "conv_id", "head", "unit").mapInPandas(build, "conv_id long, path binary")


def _built(conversation: tuple, own: bytes, opening: tuple, out: list) -> tuple:
    """Add the rebuilt conversation to ``out``; the opening that the next one of this base starts with."""
    base, conv_id, head = conversation
    if conv_id == base:
        opening = (base, own)
    start = opening[1] if opening[0] == base else b""
    out.append((int(conv_id), start[: head * UNIT] + own[head * UNIT :]))
    return opening


class SpillingQueue:
    """Least item first; beyond ``most`` items the larger half goes to an unnamed file of the task, sorted, and is merged from there."""

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs, self.heads = max(2, most), [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            half = len(self.heap) // 2
            run = self._run(self.heap[half:])
            del self.heap[half:]  # a sorted list is a heap
            self.runs.append(run)
            self._next(len(self.runs) - 1)

    @staticmethod
    def _run(items: list[tuple]) -> Iterator[tuple]:
        file, blocks = tempfile.TemporaryFile(), range(0, len(items), 1024)
        for a in blocks:
            pickle.dump(items[a : a + 1024], file)
        file.seek(0)
        return itertools.chain.from_iterable(pickle.load(file) for _ in blocks)

    def _next(self, run: int) -> None:
        head = next(self.runs[run], None)
        if head is not None:
            heapq.heappush(self.heads, (head, run))

    def peek(self) -> tuple | None:
        own, spilled = (self.heap[0] if self.heap else None), (self.heads[0][0] if self.heads else None)
        return spilled if own is None else own if spilled is None else min(own, spilled)

    def pop(self) -> tuple:
        if not self.heads or (self.heap and self.heap[0] < self.heads[0][0]):
            return heapq.heappop(self.heap)
        head, run = heapq.heappop(self.heads)
        self._next(run)
        return head


class _Rows:
    """Rows of the common schema, handed on in frames."""

    def __init__(self, most: int = 8192):
        self.rows, self.most = [], most

    def add(self, **values) -> None:
        """A null among numbers would make pandas turn them into doubles, so only a parent's id may be null."""
        self.rows.append(tuple(values.get(c, _BLANK.get(c)) for c in _COLUMNS))

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=_COLUMNS, dtype=object)
        self.rows = []
        return out


def _nodes(frames: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    """The nodes of a shard from its sorted paths: parts of kind _PART, and the ids of sequences that end there."""
    from pyspark import TaskContext

    shard, out = TaskContext.get().partitionId(), _Rows()
    path, stack = None, []  # a node: hash state, key, members, least member, chars, ids that end here, rows of ids, at the shard's begin

    def ids(depth: int, node: list) -> None:
        if node[5]:
            out.add(kind=_ENDS, depth=depth, key=node[1], shard=shard, place=node[6], ends=np.array(node[5], np.int64).tobytes())
            node[5], node[6] = [], node[6] + 1

    def close(last: bool) -> None:
        node, depth = stack.pop(), len(stack)
        ids(depth, node)
        above = stack[-1] if stack else None
        out.add(
            kind=_PART, depth=depth, key=node[1], parent=above[1] if above else None, shard=shard, place=0, first=node[7], last=last,
            conv_id=node[3], n_convs=node[2], chars=node[4], n_children=0, n_leaves=0, saved_tokens=0,
        )
        if above:
            above[2] += node[2]
            above[3] = min(above[3], node[3])

    for frame in frames:
        for conv_id, now in zip(frame["conv_id"], frame["path"], strict=True):
            conv_id, now = int(conv_id), bytes(now)
            if path is None:
                state = hashlib.blake2b(digest_size=DIGEST)
                stack.append([state, state.digest(), 0, conv_id, 0, [], 0, True])
                shared = 0
            else:
                shared = _shared(path, now)
            while len(stack) > shared + 1:
                close(False)
            for a in range(shared * UNIT, len(now), UNIT):
                state = stack[-1][0].copy()
                state.update(now[a : a + UNIT])
                chars = int.from_bytes(now[a + DIGEST : a + UNIT], "big")
                stack.append([state, state.digest(), 0, conv_id, chars, [], 0, path is None])
            node = stack[-1]
            node[2], node[3] = node[2] + 1, min(node[3], conv_id)
            node[5].append(conv_id)
            if len(node[5]) >= chunk:
                ids(len(stack) - 1, node)
            path = now
            if out.full():
                yield out.frame()
    while stack:
        close(True)
    yield out.frame()


def _shared(a: bytes, b: bytes) -> int:
    """Leading units that two paths have in common."""
    most = min(len(a), len(b)) // UNIT
    low, high = 0, most
    while low < high:  # equal prefixes are compared as whole slices
        middle = (low + high + 1) // 2
        if a[: middle * UNIT] == b[: middle * UNIT]:
            low = middle
        else:
            high = middle - 1
    return low


def _settled(frames: Iterator[pd.DataFrame], whole: bool, queue: int) -> Iterator[pd.DataFrame]:
    """Settle the nodes of one run of shards, which come in reverse level order, parts before ids, in the order of shards.

    A node of which no part touches an end of the run has met all its members: it
    gets the totals of its children out of the queue, hands them their parent's
    least member and sends its own totals up. The others stay parts.
    """
    out, waiting = _Rows(), SpillingQueue(queue)
    node: dict | None = None

    def children() -> None:
        """Messages to the node at hand; each child's row leaves here, where its parent is known."""
        at = (-node["depth"], node["key"])
        while (head := waiting.peek()) is not None and head[:2] == at:
            child = waiting.pop()[2]
            node["n_children"] += 1
            node["n_leaves"] += child[3]
            node["saved_tokens"] += child[4]
            out.add(
                kind=_NODE, key=child[6], conv_id=child[0], depth=node["depth"] + 1, n_convs=child[1], n_children=child[2], n_leaves=child[3], saved_tokens=child[4],
                ends=child[5], parent_conv_id=node["conv_id"] if node["done"] else None, parent=None if node["done"] else node["key"],
            )

    def finish() -> None:
        children()
        if not node["done"]:
            out.add(kind=_PART, **{c: node[c] for c in ("depth", "key", "parent", "shard", "first", "last", "conv_id", "n_convs", "chars", "n_children", "n_leaves", "saved_tokens")}, place=0)
            return
        leaves = node["n_leaves"] or 1
        saved = node["saved_tokens"] + (node["n_convs"] - 1) * node["chars"]
        own = (node["conv_id"], node["n_convs"], node["n_children"], leaves, saved, node["ends"].digest(), node["key"])
        if node["depth"]:
            waiting.push((1 - node["depth"], node["parent"], own))
        else:
            out.add(kind=_NODE, key=own[6], conv_id=own[0], depth=0, n_convs=own[1], n_children=own[2], n_leaves=own[3], saved_tokens=own[4], ends=own[5])

    for frame in frames:
        for row in frame.itertuples():
            key = bytes(row.key)
            if node is None or (row.depth, key) != (node["depth"], node["key"]):
                if node is not None:
                    finish()
                node = {
                    "depth": int(row.depth), "key": key, "parent": None if row.parent is None else bytes(row.parent), "shard": int(row.run), "conv_id": int(row.conv_id), "chars": int(row.chars),
                    "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "first": False, "last": False, "ends": hashlib.sha256(), "any": False, "rows": 0, "done": None,
                }
            if row.kind == _PART:
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    node[c] += int(getattr(row, c))
                node["conv_id"] = min(node["conv_id"], int(row.conv_id))
                node["first"] |= bool(row.first) and row.shard == row.low and not whole
                node["last"] |= bool(row.last) and row.shard == row.high and not whole
                node["done"] = not (node["first"] or node["last"])
            elif node["done"]:
                text = ",".join(map(str, np.frombuffer(row.ends, np.int64).tolist()))
                node["ends"].update((("," if node["any"] else "") + text).encode())
                node["any"] = True
            else:  # ids wait for the rest of their node
                out.add(kind=_ENDS, depth=node["depth"], key=key, shard=node["shard"], place=node["rows"], ends=row.ends)
                node["rows"] += 1
            if out.full():
                yield out.frame()
    if node is not None:
        finish()
    yield out.frame()


def _reverse_levels() -> list:
    return [F.desc("depth"), *map(F.asc, ("key", "kind", "shard", "place"))]


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row per distinct prefix of the paths ``conv_id long, path binary``, the empty one included.

    ``conv_id`` (the least member), ``depth``, ``parent_conv_id``, ``n_convs``
    (members), ``n_children``, ``n_leaves`` (childless nodes in the subtree, itself
    included), ``saved_tokens`` (over the subtree, members beyond the first times
    the last turn's code points) and ``ends_sha256`` (hex SHA-256 of the ids of
    sequences that end here, ascending, by commas). Equal paths and repeated ids
    are members of their own; without paths there are no nodes. A path, 20 bytes a
    turn, is one row, as a text is; nothing else of a conversation is gathered.
    """
    spark = paths.sparkSession
    ship_package(spark)
    held = stored(paths.select("conv_id", "path"), "paths")  # ranges are drawn from fixed rows, so a repeated task cuts alike
    turns = (held.agg(F.sum(F.length("path"))).first()[0] or 0) // UNIT + held.count()
    shards = max(1, -(-turns // SHARD_TURNS), min(2 * spark.sparkContext.defaultParallelism, turns // LEAST_TURNS))
    queue, chunk = QUEUE, CHUNK
    cut = held.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = cut.mapInPandas(lambda f: _nodes(f, chunk), _SCHEMA).withColumns({"run": F.col("shard"), "low": F.col("shard"), "high": F.col("shard")})
    parts = stored(nodes.sortWithinPartitions(*_reverse_levels()).mapInPandas(lambda f: _settled(f, False, queue), _SCHEMA), "trie")
    found, tops = parts.where(F.col("kind") == _NODE), []
    runs = (parts.agg(F.max("shard")).first()[0] or 0) + 1
    while True:
        runs = -(-runs // FAN)
        left = parts.where(F.col("kind") != _NODE).withColumn("run", F.expr(f"shard div {FAN}"))
        ends = left.groupBy("run").agg(F.min("shard").alias("low"), F.max("shard").alias("high"))
        whole = runs == 1
        ordered = sized_join(left, ends, "run", "inner").repartition("run").sortWithinPartitions("run", *_reverse_levels())
        parts = stored(ordered.mapInPandas(lambda f, w=whole: _runs(f, w, queue), _SCHEMA), "trie")
        tops.append(parts.where(F.col("kind") == _NODE))
        if whole:
            break
    top = tops[0]
    for more in tops[1:]:
        top = top.union(more)
    # A child that was done before its parent waits for the parent's least member.
    known = found.union(top)
    names = top.select(F.col("key").alias("parent"), F.col("conv_id").alias("_above"))
    rows = sized_join(known.drop("shard"), names, "parent", "left")
    return rows.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.lower(F.hex("ends")).alias("ends_sha256"),
    )


def _runs(frames: Iterator[pd.DataFrame], whole: bool, queue: int) -> Iterator[pd.DataFrame]:
    """Settle the runs of a task one after the other."""
    now: list = []

    def own(run: int) -> Iterator[pd.DataFrame]:
        while now and now[0] == run:
            frame = now[1]
            mine = frame["run"] == run
            count = int(mine.to_numpy().argmin()) if not mine.all() else len(frame)
            yield frame.iloc[:count]
            if count < len(frame):
                rest = frame.iloc[count:]
                now[:] = [int(rest["run"].iloc[0]), rest]
            else:
                following = next((f for f in frames if len(f)), None)
                now[:] = [] if following is None else [int(following["run"].iloc[0]), following]

    first = next((f for f in frames if len(f)), None)
    if first is not None:
        now[:] = [int(first["run"].iloc[0]), first]
    while now:
        yield from _settled(own(now[0]), whole, queue)
