import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoweave.llm import quality_classifier, quality_rules
from phenoweave.llm.common import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures_equal_brute_force(documents, edge):
    for frame in (documents, edge):
        rows = quality_rules.quality_rules(frame).collect()
        want = sorted((str(r.doc_id), *brute(r.text)) for r in frame.collect())
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and (r.base_failed or r.failed))
    assert quality_rules.quality_rules(edge.limit(0)).count() == 0


def test_repeats_few_and_many(spark):
    few = "a b c d a b c e"
    many = " ".join(f"w{i % 60}" for i in range(200))
    lap = "x x x x x"
    frame = spark.createDataFrame([(1, few), (2, many), (3, lap)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_rules(frame).collect()}
    assert got == {1: brute(few)[4], 2: brute(many)[4], 3: brute(lap)[4]} == {1: 6, 2: 200, 3: 5}


def test_filters_stay_above_the_measures(documents):
    kept = quality_rules.quality_rules(documents).where("kept and n_words > 60")
    assert 0 < kept.count() <= documents.count()


def test_rules_are_compiled_from_the_table(documents):
    strict = (quality_rules.Rule("n_words", least=10**6), quality_rules.Rule("symbol_ratio", most=-1.0))
    row = quality_rules.quality_rules(documents, strict).first()
    assert row.failed == ["n_words below 1e+06", "symbol_ratio above -1"] and not row.kept
    assert quality_rules.quality_rules(documents, ()).where("failed <> array()").count() == 0


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_fold_is_crc32_of_the_id(spark):
    frame = spark.range(50).select(F.col("id").alias("doc_id"), held_out("doc_id", 4, 2).alias("out"))
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in frame.collect())


def test_held_out_quality(larger):
    docs, labels = larger
    ensemble = quality_classifier.learn(docs, labels, "quality")
    rows = quality_classifier.quality(docs, ensemble).join(labels, "doc_id").where(held_out("doc_id", 4, 2)).collect()
    right = [(r.quality_score >= 0.7) == (r.quality == 1) for r in rows]
    assert np.mean(right) > 0.95
    assert all(0 <= r.quality_score <= 1 for r in rows)


def test_score_column_equals_the_rules_in_numpy(larger):
    docs, labels = larger
    ensemble = quality_classifier.learn(docs, labels, "quality")
    assert ensemble.rules
    stats, names = quality_classifier.statistics(docs.select("doc_id", "text"))
    frame = stats.withColumn("score", ensemble.column()).toPandas()
    total = np.full(len(frame), ensemble.intercept)
    for rule, weight in zip(ensemble.rules, ensemble.weights, strict=True):
        holds = np.ones(len(frame), bool)
        for name, below, cut in rule:
            holds &= (frame[name] <= cut) == below
        total += weight * holds
    assert np.allclose(frame["score"], 1 / (1 + np.exp(-total)))


def test_lasso_drops_useless_rules():
    rng = np.random.default_rng(1)
    rules = rng.random((4000, 12)) < 0.5
    y = (rng.random(4000) < np.where(rules[:, 3], 0.9, 0.1)).astype(float)
    _, weights = quality_classifier._lasso(rules, y)
    assert weights[3] > 3 and np.count_nonzero(weights) < 8 and np.abs(np.delete(weights, 3)).max() < 0.3


def test_edge_rows_and_missing_labels(edge, labels):
    prior = quality_classifier.learn(edge, labels.limit(0), "quality")
    rows = quality_classifier.quality(edge, prior)
    assert rows.columns == [*edge.columns, "quality_score"] and {r.quality_score for r in rows.collect()} == {0.5}
    some = edge.sparkSession.createDataFrame([(5, 1), (5, None), (6, 0), (None, 1), (4, None)], "doc_id long, quality int")
    found = quality_classifier.learn(edge, some, "quality")
    scored = quality_classifier.quality(edge, found)
    assert scored.count() == edge.count() and scored.where("quality_score between 0 and 1").count() == edge.count()
    assert quality_classifier.quality(edge.limit(0), found).count() == 0


def test_the_ensemble_is_fitted_in_a_task(documents, monkeypatch):
    """The driver gets the rules alone, not the sample or the matrix of rules."""
    real = quality_classifier.fit

    def spied(x, y, names):
        ensemble = real(x, y, names)
        ensemble.process, ensemble.seen = os.getpid(), len(y)
        return ensemble

    monkeypatch.setattr(quality_classifier, "fit", spied)
    labels = documents.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 2).cast("int").alias("quality")).distinct()
    learnt = quality_classifier.learn(documents, labels, "quality")
    assert learnt.seen > 0 and learnt.process != os.getpid()
    assert isinstance(quality_classifier.learn(documents.limit(0), labels, "quality").intercept, float)
