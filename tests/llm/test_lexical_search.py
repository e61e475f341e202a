import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from phenoweave.llm import lexical_search
from phenoweave.llm.queries import op11_lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs = sum(1 for c in counts if c)
    tokens = sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, counts, strict=True):
            if not c:
                continue
            m = 100 - 25 + (25 * c.total() * n_docs) // tokens
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, doc_id, -s) for r, (s, _, _, doc_id) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, parts=3):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, n long").repartition(parts)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in lexical_search.search(d, i, k).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Über", "漢字", "É", "ab1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i * 3 % 401, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)]  # ties beyond k
    docs += [(2000, None), (2001, ""), (2002, " .,- \n"), (None, "w3 w9"), (None, "w3 w9"), (3, "w3-W9"), (9007199254740993, "w50 w51 " * 3000)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20])))) for i in range(25)]
    items += [(30, None), (31, "..."), (32, "unknown"), (33, "w3 W9 w3"), (33, "w1"), (None, "w2")]
    return docs, items


@pytest.mark.parametrize("postings", [1 << 21, 50])
def test_search_equals_brute_force(spark, corpus, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", postings)
    if postings == 50:
        monkeypatch.setattr(lexical_search, "PASS_TERMS", 20)
    assert found(spark, *corpus) == brute(*corpus)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None), (2, "")], items) == []


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]
    got = op11_lexical_search(spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


def shard(rng, docs, n_terms):
    own = [np.unique(rng.integers(0, n_terms, rng.integers(1, 12))).astype(np.int32) for _ in range(docs)]
    counts = [rng.integers(1, 9, len(t)).astype(np.int32) for t in own]
    n = np.array([c.sum() + rng.integers(0, 400) for c in counts], np.int64)
    return lexical_search.Shard([str(i) for i in range(docs)], n, [t.tobytes() for t in own], [c.tobytes() for c in counts], n_terms, docs, int(n.sum()))


def test_best_positions_stop_early_and_lose_nothing():
    """Against full scores; ties at the k-th place are all returned, and rare heavy terms end a query before all documents are met."""
    rng = np.random.default_rng(4)
    part, scratch = shard(rng, 3000, 40), np.full(40, -1, np.int64)
    early = 0
    for block in (1, 8, 64):
        for _ in range(30):
            asked = np.unique(rng.integers(0, 40, rng.integers(1, 6)))
            weights = rng.integers(0, 5, len(asked)).astype(np.int64) ** 6
            scores = np.zeros(3000, np.int64)
            for t, w in zip(asked, weights, strict=True):
                own = part.term == t
                np.add.at(scores, part.doc[own], w * part.impact[own])
            docs, got, met = part.best(asked, weights, 20, scratch, block)
            kth = max(1, np.sort(scores)[-20])
            assert set(np.flatnonzero(scores >= kth)) == set(docs[got >= kth].tolist()) and (scores[docs] == got).all()
            assert (scratch == -1).all()
            early += met < (np.isin(part.term, asked) * 1).sum() / 3
    assert early > 5
