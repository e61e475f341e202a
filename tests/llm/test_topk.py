import random

import pytest

from phenoweave.llm import topk


def brute(rows, asked, k):
    out = set()
    for q, v in asked:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def test_equals_brute_force_with_many_ties(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(200)]
    rows += [(300 + i, [1.0, 1.0, 1.0]) for i in range(100)] + [(900, [1e6, 2e6]), (901, [5.0, 1.0]), (902, [2e6, 1.0])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    asked = frame.where("id % 7 = 0 or id >= 900")
    want = brute(rows, [r for r in rows if r[0] % 7 == 0 or r[0] >= 900], 5)
    assert set(map(tuple, topk.exact_topk(asked, frame, 5).collect())) == want


def test_small_tasks_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-60, 60)) for _ in range(8)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    monkeypatch.setattr(topk, "GROUP_CANDIDATES", 50)
    monkeypatch.setattr(topk, "SLOT_QUERIES", 4)
    got = topk.exact_topk(frame.where("id % 20 = 0"), frame, 20).collect()
    assert set(map(tuple, got)) == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)


def test_empty_and_unsound_vectors(spark):
    schema = "i long, e array<double>, vector string"
    rows = [(1, [1.0, None], "x"), (2, None, None), (None, [1.0], "x"), (3, [float("nan"), 1.0], "x"), (5, [], "x"), (6, [float("inf")], "x"), (4, [0.5, -0.26], "x")]
    frame = spark.createDataFrame(rows, schema)
    sound = topk.whole_numbers(frame, "i", "e")
    assert [tuple(r) for r in sound.collect()] == [(4, [32.0, -17.0])]
    assert topk.exact_topk(sound, sound, 3).count() == 0
    assert topk.exact_topk(sound.limit(0), sound, 3).count() == 0
    assert topk.exact_topk(sound, sound.limit(0), 3).count() == 0


def test_repeated_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [3.0]), (1, [3.0]), (2, [2.0])], "id long, vector array<double>")
    got = sorted(map(tuple, topk.exact_topk(frame.where("id = 0"), frame, 3).collect()))
    assert got == [(0, 1, 1, 3), (0, 2, 1, 3), (0, 3, 2, 2)]


def test_scores_beyond_a_long_are_refused(spark):
    frame = spark.createDataFrame([(0, [1e18]), (1, [1e18])], "id long, vector array<double>")
    with pytest.raises(ValueError):
        topk.exact_topk(frame, frame, 1)
