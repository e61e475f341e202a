import itertools
import random
import re

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest

from phenoweave.llm import jaccard, langid, quality_classifier, secrets
from phenoweave.llm.common import held_out
from tests.llm.test_packing import check_layout, expected_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_stages_keep_columns_and_clean_documents(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    before = ids(docs)
    for stage in stages[:4]:
        assert stage.columns == docs.columns and ids(stage) <= before
        before = ids(stage)
    assert len(good & ids(stages[1])) >= 0.97 * len(good & ids(docs))
    assert ids(stages[2]) == ids(stages[3])


def test_one_document_of_each_group_stays(stages):
    rows = jaccard.similar_components(stages[1]).collect()
    assert ids(stages[2]) == {r.component_id for r in rows}


def test_secrets_are_gone_and_pieces_are_packed(stages):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    before = {r.doc_id: r.text for r in stages[2].collect()}
    changed = {k for k in texts if texts[k] != before[k]}
    assert all("[secret]" in texts[k] for k in changed)
    rows = stages[4].collect()
    check_layout(rows, 1024)
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == dict(zip(texts, map(len, expected_ids(texts.values())), strict=True))


def test_run_equals_the_stages(spark, stages):
    assert sorted(pipeline.run(spark, SF).collect()) == sorted(stages[4].collect())


def test_edge_rows_in_every_stage(spark, edge):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars", "blob", "_words")
    for _, stage in pipeline.STAGES[:4]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    distinct = pipeline.keep_distinct(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in distinct) == sorted(["1", "2", "3", "None", "4", "5", "7", "8", "9007199254740993"])
    assert pipeline.pack_sequences(spark, docs.limit(0), SF).count() == 0


def test_rows_of_one_id_are_judged_each_by_its_text(spark, prose):
    """A row goes only for its own text; a null text never stands for a real one; the least id of a group stays, none last."""
    a, b, c = prose("en", 60), prose("de", 60), prose("en", 70)
    rows = [(1, a), (5, a), (5, b), (7, None), (7, c), (9, c), (None, b), (None, prose("de", 50)), (11, ""), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in pipeline.keep_distinct(spark, docs.repartition(3), SF).collect()]
    gone = [(5, a), (9, c), (None, b)]
    assert sorted(kept, key=repr) == sorted([r for r in rows if r not in gone], key=repr)


def test_texts_like_no_language_go(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chance = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (3, 30, 300)]
    more = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(chance)], docs.schema)
    kept = ids(pipeline.keep_languages(spark, docs.union(more), SF))
    assert all(10**6 + i not in kept for i in range(3)) and kept == ids(pipeline.keep_languages(spark, docs, SF))


def test_each_stage_equals_a_plain_version(spark, stages):
    """Decisions of every stage once more on what it was given, row by row in Python."""
    given = [spark.read.parquet(f"{SF}/documents.parquet"), *stages[:4]]
    docs = [{r.doc_id: r for r in g.collect()} for g in given]
    ensemble = quality_classifier.learn(given[0], spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    score = {r.doc_id: r.quality_score for r in quality_classifier.quality(given[0], ensemble).collect()}
    assert set(docs[1]) == {d for d in docs[0] if score[d] >= 0.7}
    model = langid.learn(given[1], public_tokenizers.path("piece_bpe_32k.model"), ~held_out("doc_id", 4, 2))
    lattice, stay = langid.Lattice(model.pieces), set()
    for doc_id, row in docs[1].items():
        words = langid.words_of(row.text)
        logs = sum((model.word_scores([w], lattice)[0] for w in words), np.zeros(len(model.languages)))
        if words and 1 / np.exp(logs - logs.max()).sum() >= 0.5 and logs.max() / sum(len(w) + 1 for w in words) >= model.floors[logs.argmax()]:
            stay.add(doc_id)
    assert set(docs[2]) == stay
    sets = {}
    for doc_id, row in docs[2].items():
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in row.text or ""))
        sets[doc_id] = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())
    links = {d: {d} for d in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            joined = links[a] | links[b]
            for d in joined:
                links[d] = joined
    assert set(docs[3]) == {min(group) for group in links.values()}
    for doc_id, row in docs[4].items():
        text, spans = docs[3][doc_id].text, []
        for rule in secrets.RULES:
            for hit in re.finditer(rule.pattern, text, re.ASCII):
                if len(hit.group(rule.group)) >= rule.least:
                    spans.append(hit.span())
        covered = np.zeros(len(text), bool)
        for a, b in spans:
            covered[a:b] = True
        assert (row.text == text) == (not spans)
        left = "".join(c for c, gone in zip(text, covered, strict=True) if not gone)
        assert row.text.replace("[secret]", "") == left.replace("[secret]", "")
