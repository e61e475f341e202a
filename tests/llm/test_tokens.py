import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from phenoweave.llm import sp_encode, token_counts
from phenoweave.llm.queries import SPECIALS_50K

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def counted(docs, **options):
    return token_counts.token_counts(docs, BYTES, public_tokenizers.PATTERN, tuple(SPECIALS_50K), **options)


def test_counts_equal_the_library(documents):
    tokenizer = Tokenizer.from_file(BYTES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counted(documents).collect()}
    for d in documents.collect():
        n = len(tokenizer.encode(d.text or "", add_special_tokens=False).ids)
        assert got[d.doc_id] == (len((d.text or "").encode()), n, n > 512)


def test_counts_without_frequent_pre_tokens(documents, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 1)
    few = counted(documents)
    monkeypatch.undo()
    assert sorted(few.collect()) == sorted(counted(documents).collect())


def test_counts_of_edge_rows(edge):
    tokenizer = Tokenizer.from_file(BYTES)
    want = sorted((len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in edge.collect())
    rows = counted(edge).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in edge.collect())
    assert counted(edge.limit(0)).count() == 0


def test_pre_tokens_of_late_characters():
    pre = token_counts.PreTokens(BYTES, public_tokenizers.PATTERN)
    for text in ("a՘b", "漢字 ႔0 x", "a\n\n b  c \n", "it's 12²"):
        assert "".join(pre.split(text)) == text
        assert sum(pre.counts(pre.split(text))) == len(pre.tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_encoding_equals_the_library(documents, edge, model):
    for frame in (documents, edge):
        texts = {(r.doc_id, i): r.text for i, r in enumerate(frame.collect())}
        want = sorted((str(k[0]), model.encode(t or "")) for k, t in texts.items())
        rows = sp_encode.decode(sp_encode.encode(frame, PIECES), PIECES).collect()
        assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
        assert all(r.decoded == model.decode(list(r.ids)) for r in rows)
    assert sp_encode.encode(edge.limit(0), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["▁", " ", "  ", "the", "ing", "\n", "é", "漢", "0x", "<s>", "aab", ","]), max_size=20).map("".join))
def test_any_text_round_trips(text):
    own, library = sp_encode.codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    ids = own.encode(text)
    assert ids == library.encode(text)
    assert own.decode(ids) == library.decode(ids)


def test_long_runs(model):
    rng = random.Random(2)
    own = sp_encode.codec(PIECES)
    for text in (" " * 500 + "x", "ab" * 20_000, "".join(rng.choice("abcde") for _ in range(5000)), "\n" * 300):
        assert own.encode(text) == model.encode(text)
