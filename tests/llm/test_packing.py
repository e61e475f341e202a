import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phenoweave.llm import packing
from phenoweave.llm.queries import END_ID, pieces_of


def expected_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, END_ID] for t in texts]


def test_pieces_equal_the_library(documents):
    docs = documents.collect()
    found = {}
    for r in pieces_of(documents, with_ids=True).collect():
        found.setdefault(r.doc_id, []).append(r)
    for doc, ids in zip(docs, expected_ids([d.text for d in docs]), strict=True):
        pieces = sorted(found[doc.doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [i for p in pieces for i in p.ids] == ids
        assert all(p.length == 1024 for p in pieces[1:])
        for p in pieces:
            assert p.start == sum(q.length for q in pieces[: p.piece])
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())


def check_layout(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_edge_rows_and_layout(edge):
    rows = packing.pack(pieces_of(edge)).collect()
    check_layout(rows, 1024)
    assert sum(r.piece == 0 for r in rows) == edge.count()
    assert {r.doc_id for r in rows} == {r.doc_id for r in edge.collect()}
    assert [r.length for r in rows if r.doc_id == 1] == [1] and [r.length for r in rows if r.doc_id == 2] == [1]
    assert packing.pack(pieces_of(edge.limit(0))).count() == 0


def test_few_sequences_and_the_same_for_any_layout(spark):
    rng = random.Random(1)
    data = [(i, 0, 0, rng.randint(1, 1024), 0) for i in range(3000)]
    frame = spark.createDataFrame(data, "doc_id long, piece int, start long, length long, ids_crc32 long")
    runs = [sorted(packing.pack(frame.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    used = check_layout(runs[0], 1024)
    assert used <= 1.05 * sum(r[3] for r in data) / 1024 + 2
    split = packing.pack(frame, bucket_tokens=100_000).collect()
    assert check_layout(split, 1024) <= 1.2 * used


def online(pieces, capacity, open_bins):
    """Best-fit over a plain list of (number, free): the first of the fullest that fit, the fullest closed beyond the bound."""
    bins, out, made, closed = [], [], 0, 0
    for length in pieces:
        fit = [b for b in bins if b[1] >= length]
        if fit:
            number, free = min(fit, key=lambda b: b[1])
            bins.remove((number, free))
        else:
            number, free = made, capacity
            made += 1
        out.append((number, capacity - free))
        if free > length:
            if len(bins) == open_bins:
                bins.remove(min(bins, key=lambda b: b[1]))
                closed += 1
            bins.append((number, free - length))
    return out, closed


def test_layout_equals_online_best_fit(spark):
    """Placement of every piece in the order that its bucket meets it, with bins that close; against plain lists."""
    rng = random.Random(6)
    data = [(i // 2, i % 2, 0, min(1024, int(rng.paretovariate(0.4) * 20)), 0) for i in range(2000)]
    frame = spark.createDataFrame(data, "doc_id long, piece int, start long, length long, ids_crc32 long")
    draws = frame.select("doc_id", "piece", "length", F.xxhash64("doc_id", "piece").alias("draw")).collect()
    buckets = -(-sum(r[3] for r in data) // 200_000)
    found = {(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in packing.pack(frame.repartition(5), open_bins=6, bucket_tokens=200_000).collect()}
    total = 0
    for bucket in range(buckets):
        own = sorted((r for r in draws if r.draw % buckets == bucket), key=lambda r: (r.draw, r.doc_id, r.piece))
        places, closed = online([r.length for r in own], 1024, 6)
        total += closed
        assert [found[r.doc_id, r.piece] for r in own] == [((bucket << 32) | number, offset) for number, offset in places]
    assert total > 20


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]
    # The bin with 7 closed for the one with 8, so 3 more do not fit there.
    assert bins.place(3) == (0, 6)
    assert bins.place(2) == (2, 8)
    full = packing.OpenBins(10, 2)
    assert [full.place(10) for _ in range(3)] == [(0, 0), (1, 0), (2, 0)] and full.count == 0
