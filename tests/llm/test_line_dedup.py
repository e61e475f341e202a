import random

import numpy as np
import pytest

from phenoweave.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least_docs=5, least_chars=40):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACES))
            if len(key) >= least_chars:
                holders.setdefault(key, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            docs = holders.get(lower(line.strip(SPACES)), set())
            if len(docs) < least_docs or doc_id == max(d for d in docs if d is not None):
                kept.append(line)
        out.append((str(doc_id), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(8)
    common = [f"Line number {i} that many of the documents have in common é" for i in range(6)]
    rows = []
    for d in range(60):
        own = [rng.choice(common) if rng.random() < 0.5 else f"{rng.random()} a line that is found only once in all the texts" for _ in range(rng.randint(1, 8))]
        own = [rng.choice(["", " \t", "\x0b"]) + (x.upper().replace("É", "é") if rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "]) for x in own]
        rows.append((d * 7 % 61, "\n".join([*own, "short", "short"])))
    exactly = "a line of exactly forty code points, éé😀"
    assert len(exactly) == 40
    rows += [(100 + i, exactly) for i in range(5)] + [(200 + i, exactly[:-1]) for i in range(5)] + [(300 + i, "four documents hold this line of enough characters") for i in range(4)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (9007199254740993, common[0]), (9007199254740992, common[0]), (500, "x" * 200_000), (501, common[0]), (501, common[0])]
    return rows


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("bits", [1 << 20, 1 << 6])
def test_lines_equal_brute_force(spark, lines, monkeypatch, bits, many):
    """Also with filters so full that they suspect every line, and with too many lines to send to all tasks."""
    monkeypatch.setattr(line_dedup, "LEAST_BITS", bits)
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    if many:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame(lines, "doc_id long, text string").repartition(5)
    got = line_dedup.line_dedup(docs).collect()
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got) == brute(lines)


def test_edge_rows_keep_their_columns(spark, edge):
    rows = line_dedup.line_dedup(edge)
    assert rows.columns == [*edge.columns, "n_lines", "n_dropped"] and rows.count() == edge.count()
    got = {str(r.doc_id): (r.text, r.n_lines, r.n_dropped) for r in rows.collect()}
    assert got["1"] == got["2"] == ("", 1, 0) and got["7"] == ("x" * 100_000, 1, 0)
    assert line_dedup.line_dedup(edge.limit(0)).count() == 0
    again = line_dedup.line_dedup(rows)
    assert again.columns == rows.columns


def test_rows_without_id(spark):
    line = "this line is long enough to be looked at by the operator"
    docs = spark.createDataFrame([(None, line), (None, line), *[(i, line) for i in range(4)]], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.line_dedup(docs).collect())
    assert got == sorted([("None", ""), ("None", ""), ("0", ""), ("1", ""), ("2", ""), ("3", line)])


def test_filter_forgets_nothing():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    bloom = line_dedup.Bloom(1 << 17)
    bloom.add(keys[:4000])
    assert bloom.has(keys[:4000]).all() and bloom.has(keys[4000:]).mean() < 0.05


def test_only_suspected_lines_are_shuffled(spark):
    texts = [(d, "\n".join(f"{d} {i} a line of some length that is in one document only" for i in range(50))) for d in range(40)]
    shared = "the one line that is long and is in three of the documents"
    texts = [(d, t + ("\n" + shared if d < 3 else "")) for d, t in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    bits = 1 << 20
    again = np.zeros(bits >> 3, np.uint8)
    whole = line_dedup.filters_of(docs, bits, 40).repartition("segment").mapInPandas(line_dedup._joined, "segment int, again binary")
    for r in whole.collect():
        again[r["segment"] * line_dedup.SEGMENT :][: len(r["again"])] = np.frombuffer(r["again"], np.uint8)
    held = spark.sparkContext.broadcast(again)
    asked = line_dedup.suspected(docs, held, bits, 40).collect()
    assert {0, 1, 2} <= {r["doc_id"] for r in asked} and len(asked) <= 6
