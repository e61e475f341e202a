import itertools
import math
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from phenoweave.llm import langid, toxicity
from phenoweave.llm.common import hash_sample, held_out, word_hashes

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_ways(marked, pieces, p):
    """Sum over every segmentation, by definition; a single letter that is no piece counts as the last row."""
    total = 0.0
    for bits in range(1 << (len(marked) - 1)):
        cuts = [0, *(k + 1 for k in range(len(marked) - 1) if bits >> k & 1), len(marked)]
        product = 1.0
        for part in (marked[a:b] for a, b in itertools.pairwise(cuts)):
            product *= p[pieces.index(part)] if part in pieces else p[-1] if len(part) == 1 else 0.0
        total += product
    return total


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "▁", "▁a", "abababababab"]
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(pieces, ["x", "y"], rng.random((8, 2)) / 4)
    words = ["abab", "b", "abcab", "aba", "c", "ab" * 7]
    found = model.word_scores(words, langid.Lattice(pieces))
    expected = [[np.log(all_ways("▁" + w, pieces, model.probabilities[:, j])) for j in range(2)] for w in words]
    assert np.allclose(found, expected)


def test_long_words_and_long_pieces_are_not_cut(monkeypatch):
    """Words beyond SIDE_BY_SIDE letters and a piece of 30 letters: exact fractions over all segmentations, no stretch taken apart."""
    pieces = ["a", "ab", "b", "▁", "▁a", "ab" * 15]
    rows = [[Fraction(k + 1, 97 + j) for j in range(2)] for k in range(7)]
    model = langid.LanguageModel(pieces, ["x", "y"], np.array([[float(x) for x in r] for r in rows]))
    for word in ("ab" * 20, "ab" * 15, "abc" * 100, "a" * 1000):
        marked = "▁" + word
        exact = []
        for j in range(2):
            ways = [Fraction(1)] + [Fraction(0)] * len(marked)
            for end in range(1, len(marked) + 1):
                for start in range(max(0, end - 30), end):
                    part = marked[start:end]
                    k = pieces.index(part) if part in pieces else 6 if len(part) == 1 else None
                    if k is not None:
                        ways[end] += ways[start] * rows[k][j]
            exact.append(math.log(ways[-1].numerator) - math.log(ways[-1].denominator))
        lattice = langid.Lattice(pieces)
        assert np.allclose(model.word_scores([word], lattice)[0], exact, rtol=1e-9)
    # The two ways of scoring, and of counting expected pieces, agree.
    words, counts, p = ["abab", "ba" * 9, "abc"], np.array([2.0, 1.0, 3.0]), model.probabilities[:, 0]
    both = []
    for most in (24, 0):
        monkeypatch.setattr(langid, "SIDE_BY_SIDE", most)
        both.append((model.word_scores(words, lattice), langid._expected(words, counts, p, lattice), langid._matches(words, counts, lattice)))
    assert all(np.allclose(x, y) for x, y in zip(*both, strict=True))


def test_the_whole_vocabulary_is_used():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    every = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    letters = {p for p in every if p.removeprefix("▁").isalpha() and p.lower() == p}
    assert set(langid.vocabulary(PATH)) == letters | {"▁"} and max(map(len, letters)) > 8


def test_expectation_maximisation_never_lowers_the_likelihood():
    pieces = ["a", "ab", "b", "ba", "▁", "▁a", "abb"]
    lattice, words, counts = langid.Lattice(pieces), ["abba", "ab", "babab"], np.array([3.0, 5.0, 2.0])
    p, last = np.full(8, 1 / 8), -np.inf
    for _ in range(6):
        model = langid.LanguageModel(pieces, ["x"], p[:, None])
        now = float(counts @ model.word_scores(words, lattice)[:, 0])
        assert now >= last - 1e-9
        used, last = langid._expected(words, counts, p, lattice), now
        p = used / used.sum()


def test_held_out_language(documents):
    model = langid.learn(documents, PATH, ~held_out("doc_id", 4, 2))
    rows = langid.identify(documents, model).where(held_out("doc_id", 4, 2)).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    hidden = langid.identify(documents.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), model).collect()
    assert {r.doc_id: r.lang_pred for r in hidden if r.doc_id in {x.doc_id for x in rows}} == {r.doc_id: r.lang_pred for r in rows}


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(2)
    names = [f"l{i:02d}" for i in range(70)]
    words = {n: ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(5)] for n in names}
    rows = [(i * 10 + k, " ".join(words[n]), n) for i, n in enumerate(names) for k in range(3 if i < 64 else 2)]
    docs = spark.createDataFrame([*rows, (-1, "nothing", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs, PATH, F.lit(True))
    assert model.languages == names
    assert all(r.lang == r.lang_pred for r in langid.identify(docs.where("lang is not null"), model).collect())


def test_sample_of_each_group_is_bounded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 100 * F.col("id") % 97).cast("string").alias("lang"))
    docs = docs.union(spark.range(5000).select(F.col("id") + 50_000, F.lit("big")))
    taken = {r.lang: r["count"] for r in hash_sample(docs, "doc_id", 300, "lang").groupBy("lang").count().collect()}
    there = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert taken.keys() == there.keys() and 220 < taken["big"] < 380
    assert all(taken[k] == n for k, n in there.items() if n <= 300)


def test_language_of_edge_rows(edge, documents):
    model = langid.learn(documents, PATH, F.lit(True))
    rows = langid.identify(edge, model)
    assert rows.count() == edge.count() and rows.columns == [c for c in edge.columns if c != "score"] + ["lang_pred", "score", "likeness"]
    got = {str(r.doc_id): (r.lang_pred, r.score) for r in rows.collect()}
    assert got["1"] == got["2"] == got["3"] == ("und", 0.0) and got["4"][0] == "de" and got["9007199254740993"][0] == "de"
    assert langid.identify(edge.limit(0), model).count() == 0
    none = langid.learn(edge.limit(0), PATH, F.lit(True))
    assert {r.lang_pred for r in langid.identify(edge, none).collect()} == {"und"}
    assert langid.words_of("12 ²") == [] and langid.words_of("Über 7") == ["über"]


def test_memory_bound_changes_no_score(documents, monkeypatch):
    model = langid.learn(documents, PATH, F.lit(True))
    texts = [r.text for r in documents.collect()]
    whole = langid.Scorer(model).texts(texts)[0]
    monkeypatch.setattr(langid, "REMEMBERED", 50)
    scorer = langid.Scorer(model)
    parts = np.vstack([scorer.texts(texts[k : k + 20])[0] for k in range(0, len(texts), 20)])
    assert np.allclose(whole, parts)


def test_word_hashes_follow_words():
    a, b = word_hashes(b" one  two\tthree\none"), word_hashes(b"x one")
    assert len(a) == 4 and a[0] == a[3] == b[1] and len(set(a.tolist())) == 3
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0
    assert word_hashes(b"lowly lower", first=3)[0] == word_hashes(b"lowly lower", first=3)[1]


@pytest.fixture(scope="module")
def trained(spark, prose):
    rows, labels = [], []
    for i in range(400):
        lang = ("en", "de")[i % 2]
        bad = {"en": "idiot", "de": "dummkopf"}[lang]
        toxic = i % 5 == 0
        text = prose(lang, 40) + (f" {bad}! " if toxic else " ") + prose(lang, 20)
        rows.append((i, text, lang))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, marks, toxicity.learn(docs, marks, "toxic", PATH)


def test_held_out_toxicity(trained):
    docs, labels, model = trained
    rows = toxicity.toxicity(docs, model).join(labels, "doc_id").where(held_out("doc_id", 3, 1)).collect()
    assert np.mean([(r.toxicity_score >= 0.7) == (r.toxic == 1) for r in rows]) > 0.95
    assert set(model.thresholds) == {"de", "en"}


def test_whole_text_is_convolved(trained, prose, spark, monkeypatch):
    _, _, model = trained
    long = prose("en", 3000) + " idiot " + prose("en", 3000)
    words = model.network.rows(toxicity.buckets_of(long))
    whole = model.network.logit(words)
    monkeypatch.setattr(toxicity, "WINDOW", 64)
    assert np.isclose(model.network.logit(words), whole)
    frame = spark.createDataFrame([(1, long), (2, prose("en", 6000))], "doc_id long, text string")
    got = {r.doc_id: r.toxicity_score >= 0.7 for r in toxicity.toxicity(frame, model).collect()}
    assert got == {1: True, 2: False}


def test_training_fits_and_unknown_words_stay_zero(trained, monkeypatch):
    docs, _, _ = trained
    buckets = [toxicity.buckets_of(r.text) for r in docs.limit(60).collect()]
    y = (np.arange(60) % 5 == 0).astype(float)
    net = toxicity.Network.new(np.unique(np.concatenate(buckets)))
    texts = [net.rows(b) for b in buckets]
    toxicity.train(net, texts, y)
    assert np.mean([(net.logit(t) > 0) == (v > 0) for t, v in zip(texts, y, strict=True)]) > 0.8
    assert not net.embedding[-1].any()
    assert np.allclose(net.maxima([*texts, texts[0][:0], texts[1][:1]])[:60], [net.pooled(t)[0] for t in texts], atol=1e-5)
    assert not net.maxima([texts[0][:0]]).any() and np.allclose(net.maxima([texts[1][:1]])[0], net.pooled(texts[1][:1])[0], atol=1e-5)
    best, place = toxicity._pooled_batch(net, texts)[1:]
    assert np.allclose(best, [net.pooled(t)[0] for t in texts], atol=1e-5)
    monkeypatch.setattr(toxicity, "WINDOW", 50)  # long batches are pooled text by text
    assert np.allclose(net.maxima(texts), best, atol=1e-5)
    apart = toxicity._pooled_batch(net, texts)[1:]
    assert np.allclose(apart[0], best, atol=1e-5) and np.mean(apart[1][best > 0] == place[best > 0]) > 0.9  # texts repeat words, so equal maxima may lie apart


def word_hash(raw):
    """The shared word hash of one word, number by number."""
    mask, step = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & mask
        return x ^ x >> 31

    total = sum(mixed((b + 1) * step & mask) * pow(step, i, 1 << 64) for i, b in enumerate(raw))
    return mixed((total + len(raw)) & mask)


def test_whole_score_equals_brute_force(spark, trained, prose):
    """Words, buckets, embeddings, convolutions, maxima, language threshold and sigmoid once more, word by word."""
    _, _, model = trained
    net, size = model.network, toxicity.BUCKETS
    texts = [prose("en", 15) + " idiot!", "Dummkopf, " + prose("de", 30), "", None, "one", "é漢 unknownword x1-y2"]
    rows = {int(b): i for i, b in enumerate(net.buckets)}
    expected = []
    for text in texts:
        raw = (text or "").lower().encode()
        words = [bytes(w) for w in re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", raw)]
        vectors = []
        for w in words:
            keys = (word_hash(w) % size, word_hash(w[: toxicity.PREFIX]) % size | size)
            vectors.append(sum(net.embedding[rows.get(k, len(net.buckets))].astype(float) for k in keys))
        logit = net.offset
        for k, width in enumerate(toxicity.WIDTHS):
            padded = vectors + [np.zeros(toxicity.DIMENSIONS)] * (width - 1)
            for f in range(toxicity.FILTERS):
                at = [float(np.concatenate(padded[i : i + width]) @ net.filters[k][:, f]) + float(net.biases[k][f]) for i in range(len(vectors))]
                logit += max([0.0, *at]) * float(net.output[k * toxicity.FILTERS + f])
        lang = langid.predicted(langid.Scorer(model.languages), [text])[0][0]
        moved = logit - model.thresholds.get(lang, model.common) + math.log(0.7 / 0.3)
        expected.append(1 / (1 + math.exp(-min(30.0, max(-30.0, moved)))))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.toxicity_score for r in toxicity.toxicity(frame, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], expected, atol=1e-4)


def test_edge_rows_and_missing_labels_of_toxicity(edge, trained, labels):
    _, _, model = trained
    rows = toxicity.toxicity(edge, model)
    assert rows.columns == [*edge.columns, "toxicity_score"] and rows.where("toxicity_score between 0 and 1").count() == edge.count()
    assert toxicity.toxicity(edge.limit(0), model).count() == 0
    none = toxicity.learn(edge, labels.limit(0), "toxic", PATH)
    assert toxicity.toxicity(edge, none).where("toxicity_score >= 0.7").count() in (0, edge.count())


def test_labels_that_are_learnt_from_by_default(spark, labels, monkeypatch):
    asked = []
    monkeypatch.setattr(toxicity, "hash_sample", lambda rows, key, limit: asked.append(limit) or hash_sample(rows, key, limit))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    toxicity.learn(docs, labels.limit(0), "toxic", PATH)
    assert asked == [8000]


def test_every_labelled_document_is_learnt_from(spark, monkeypatch):
    """Beyond the first sample too: a word that stands in few documents is learnt, and in all shards; a small table is fitted as one."""
    asked = []
    learn = toxicity.langid.learn
    monkeypatch.setattr(toxicity.langid, "learn", lambda docs, path, learnt, limit=1000: asked.append(limit) or learn(docs, path, learnt, limit))
    rng, words = np.random.default_rng(6), "the of and to in is that it for was with house river green walking little".split()
    rows = [(i, " ".join(rng.choice(words, 12)) + (f" zapword{i % 40}" if i % 4 == 0 else ""), "en") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1500)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks, "toxic", PATH, limit=150)
    learnt = {r.doc_id: r.text for r in docs.where(~held_out("doc_id", 3, 1)).withColumn("h", F.xxhash64("doc_id")).collect() if r.h % toxicity.CALIBRATION_SHARE}
    found, n = np.unique(np.concatenate([np.unique(toxicity.buckets_of(t)) for t in learnt.values()]), return_counts=True)
    assert asked == [None] and np.array_equal(model.network.buckets, found[n >= toxicity.LEAST_DOCS])
    got = toxicity.toxicity(docs, model).join(marks, "doc_id").where(held_out("doc_id", 3, 1)).collect()
    assert np.mean([(r.toxicity_score >= 0.7) == (r.toxic == 1) for r in got]) > 0.95


def test_languages_fitted_together_equal_fits_apart(documents):
    apart, together = (langid.learn(documents, PATH, F.lit(True), limit) for limit in (10**6, None))
    assert apart.languages == together.languages
    assert np.allclose(apart.probabilities, together.probabilities, rtol=1e-9, atol=0) and np.allclose(apart.floors, together.floors)


def test_thresholds_in_bins_equal_those_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    net = toxicity.Network.new(np.arange(50))
    net.embedding[:50] = rng.standard_normal((50, toxicity.DIMENSIONS))
    texts = [rng.integers(0, 50, (6, 2)).astype(np.int32) for _ in range(400)]
    logits = net.logits(texts)
    y = (logits + rng.standard_normal(400) * logits.std() > np.median(logits)).astype(float)
    lang = np.array(["x", "y", "only", "x"])[rng.integers(0, 4, 400)]
    y[lang == "only"] = 1.0
    rows = spark.createDataFrame([(float(v), i, str(n), bytearray(t.tobytes())) for i, (v, n, t) in enumerate(zip(y, lang, texts, strict=True))], "y double, order long, lang string, words binary")
    for bins in (64, 2):
        monkeypatch.setattr(toxicity, "BINS", bins)
        limits, common = toxicity._thresholds(rows, net)
        assert limits == pytest.approx({n: toxicity._threshold(logits[lang == n], y[lang == n]) for n in ("x", "y")}, abs=1e-5)
        assert common == pytest.approx(toxicity._threshold(logits, y), abs=1e-5)
