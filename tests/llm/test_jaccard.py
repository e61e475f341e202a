import random

import numpy as np

from phenoweave.llm import jaccard


def brute(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        grams = [tuple(words)] if 0 < len(words) < 4 else [tuple(words[k : k + 4]) for k in range(len(words) - 3)]
        sets[i] = frozenset(grams)
    above = {i: i for i in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            shared = len(x & y)
            if shared and 100 * shared >= 85 * (len(x) + len(y) - shared):
                p, q = root(ids[a]), root(ids[b])
                above[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(count, edits, size=120, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
    rows = []
    for i in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(frame).collect()}


def test_given_documents(documents):
    assert found(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_large_cluster_in_chunks(spark, monkeypatch):
    rows = near_copies(260, 4) + [(1000 + i, t) for i, t in near_copies(30, 2, seed=9)] + [(2000, "a b"), (2001, "A  b"), (2002, "a"), (2003, ""), (2004, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert found(frame) == want
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 40)
    assert found(frame) == want
    monkeypatch.setattr(jaccard, "GATHERED", 20)
    assert found(frame) == want
    monkeypatch.setattr(jaccard, "LISTED", 5)
    assert found(frame) == want


def test_signatures_never_differ_more_than_their_sets():
    rng = np.random.default_rng(3)
    for size in (5, 500, 40_000):
        a, b = (np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) << np.uint64(1)) for _ in range(2))
        b = np.unique(np.concatenate([a[: size // 2], b[: size // 2]]))
        x, y = (np.frombuffer(jaccard.signature(s), np.uint8).astype(int) for s in (a, b))
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_exact_border(spark):
    # 20 words have 17 shingles; 17 of 20 shared is the border itself.
    words = [f"a{i}" for i in range(20)]
    longer = words + ["x1", "x2", "x3"]
    beyond = words + ["y1", "y2", "y3", "y4"]
    rows = [(3, " ".join(words)), (1, " ".join(longer)), (9, " ".join(beyond))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == {3: (17, 1), 1: (20, 1), 9: (21, 9)}


def test_edge_rows(edge):
    rows = jaccard.similar_components(edge).collect()
    assert len(rows) == edge.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[None][1] is None
    assert got[5] == got[6] and got[6][1] == 5 and got[7] == (1, 7) and got[9007199254740993][1] == 9007199254740993
    assert jaccard.similar_components(edge.limit(0)).count() == 0


def test_derived_answers_equal_plain_ones():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 200, 3).astype(np.uint64)])) for _ in range(40)]
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    lo, hi = np.searchsorted(100 * sizes, 85 * sizes), np.searchsorted(85 * sizes, 100 * sizes, side="right")
    for i, a, shared in jaccard.overlaps(sets, np.arange(40), lo, hi):
        assert all(n == len(np.intersect1d(sets[i], sets[a + k])) for k, n in enumerate(shared.tolist()) if a + k != i)
        assert a + len(shared) == hi[i]


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 105: 100}
    assert jaccard.components(spark.createDataFrame([], "x long, y long")).count() == 0
