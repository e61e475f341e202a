import hashlib
import pickle
import random
import zlib

import pytest
from pyspark.sql import functions as F

from phenoweave.llm import prefix_trie
from phenoweave.llm.queries import op13_prefix_trie

TURNS = "conv_id long, turn long, role string, text string, _extra string, key string, path string"


def rebuilt(rows):
    """The contract's conversations, one list of (role, text) each."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(sequences):
    """Every figure of every node from its definition, by ids and prefixes."""
    nodes = {tuple(s[:d]) for s in sequences.values() for d in range(len(s) + 1)}
    members = {n: [c for c, s in sequences.items() if tuple(s[: len(n)]) == n] for n in nodes}
    out = []
    for n in nodes:
        below = [x for x in nodes if x[: len(n)] == n]
        children = [x for x in below if len(x) == len(n) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in members[n] if len(sequences[c]) == len(n))))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(members[n]), len(n), parent, len(members[n]), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    turns = spark.createDataFrame([(*r, None, "k", "p") for r in rows], TURNS)
    conv = F.col("conv_id").cast("long")
    paths = prefix_trie.paths(turns, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(paths).collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_brute_force(spark, monkeypatch, small):
    """Hot first turns, many copies, deep branches; in one shard and in many, with queues and id lists that overflow."""
    if small:
        for name, value in {"SHARD_TURNS": 6, "LEAST_TURNS": 3, "FAN": 2, "QUEUE": 3, "CHUNK": 2}.items():
            monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(100, 120), 307, 9007199254740993]:
        kind = c % 4
        length = rng.randint(1, 7) if kind else 6
        for t in range(length):
            text = f"same {t}" if kind == 0 or (kind == 1 and t < 3) else f"t{rng.randint(0, 2)}" * rng.randint(1, 2)
            rows.append((c, t, "user" if t % 2 else "assistant", text))
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rebuilt(rows))


def test_edge_turns(spark):
    rows = [
        (0, None, None, None), (0, 0, "user", ""), (0, 0, "user", ""), (0, 1, None, "😀é"), (1, 0, "user", "x" * 100_000), (2, 5, "a", None), (2, 5, "a", "b"),
        (None, 0, "user", "lost"), (250, 0, "user", "x"), (7, 0, "user", "y"), (-3, 0, "user", "z"), (3, 1, "user", "only"),
    ]
    got = found(spark, rows)
    assert got == brute({c: s for c, s in rebuilt_truncated(rows).items()})
    assert any(r[1] == 0 and r[2] is None for r in got) and found(spark, []) == []


def rebuilt_truncated(rows):
    """As Spark divides: the remainder of a negative id is not positive; ties of a turn by role, then by digest."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256((hashlib.sha256(role.encode()).hexdigest() + text).encode()).digest()[:16]
            own.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    return {c: own.get(base(c), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + turns[h:] for c, turns in own.items()}


def test_given_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op13_prefix_trie(spark, sf).collect()), key=repr) == brute(rebuilt(rows))


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    queue, taken, added = prefix_trie.SpillingQueue(4), [], []
    for _ in range(3000):
        if rng.random() < 0.6 or queue.peek() is None:
            added.append((rng.randint(0, 50), rng.random()))
            queue.push(added[-1])
        else:
            least = queue.peek()
            taken.append(queue.pop())
            assert taken[-1] == least
    while queue.peek() is not None:
        taken.append(queue.pop())
    assert sorted(taken) == sorted(added) and len(queue.heap) == 0
    drained = prefix_trie.SpillingQueue(2)
    for x in (items := [(rng.random(),) for _ in range(200)]):
        drained.push(x)
    assert [drained.pop() for _ in items] == sorted(items) and drained.peek() is None and pickle.dumps(items)
