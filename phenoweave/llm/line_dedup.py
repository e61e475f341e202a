"""Lines that many documents share, found by two Bloom filters and confirmed exactly.

One pass over the texts fills a filter of lines met once and one of lines met in
two documents. Only lines of the second filter are shuffled, as digests with the
ids of their documents; grouped, they show how many documents hold a line and
which of them keeps it. A last pass drops the others' lines. The filters have a
size that follows from the number of lines, up to a bound; beyond it more lines
are suspected and shuffled, and the result stays the same.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoweave.llm.common import BROADCAST_BYTES, SPACES, slices
from phenoweave.session import ship_package, stored

LEAST_DOCS, LEAST_CHARS = 5, 40
#: Bits a line of a filter, places that a line sets, and the most bits of a filter (32 MB).
BITS_A_LINE, PLACES, LEAST_BITS, MOST_BITS = 16, 4, 1 << 20, 1 << 28
#: Bytes of a filter that are added up together.
SEGMENT = 1 << 16
#: A confirmed line takes about so much memory where it is looked up.
LINE_BYTES = 128

_STRIPPED = SPACES.decode()


def keys_of(text: str | None, least_chars: int) -> list[bytes | None]:
    """Digest of the key of every line of a text, None where the key is too short. A null text is one empty line."""
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(_STRIPPED)
        out.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= least_chars else None)
    return out


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """PLACES bit numbers of every digest, given as two 64-bit halves."""
    steps = np.arange(PLACES, dtype=np.uint64)
    return ((keys[:, :1] + steps * (keys[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


class Bloom:
    """Bits in a byte array; a power of two of them."""

    def __init__(self, bits: int, held: np.ndarray | None = None):
        self.bits, self.held = bits, np.zeros(bits >> 3, np.uint8) if held is None else held

    def add(self, keys: np.ndarray) -> None:
        at = _places(keys, self.bits).ravel()
        np.bitwise_or.at(self.held, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = _places(keys, self.bits)
        return (self.held[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def _distinct(frame: pd.DataFrame, least_chars: int) -> np.ndarray:
    """Digests of a frame's documents, each document's lines once, as rows of two numbers."""
    found = [d for text in frame["text"] for d in {k for k in keys_of(text, least_chars) if k is not None}]
    return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


def filters_of(docs: DataFrame, bits: int, least_chars: int) -> DataFrame:
    """``segment, once, again``: both filters of every task, in compressed segments."""

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, again = Bloom(bits), Bloom(bits)
        for frame in slices(frames, ("text",)):
            keys = _distinct(frame, least_chars)
            if not len(keys):
                continue
            keys, counts = np.unique(keys, axis=0, return_counts=True)
            again.add(keys[(counts > 1) | once.has(keys)])
            once.add(keys)
        for a in range(0, bits >> 3, SEGMENT):
            parts = [f.held[a : a + SEGMENT] for f in (once, again)]
            if parts[0].any():
                yield pd.DataFrame({"segment": [a // SEGMENT], **{n: [zlib.compress(p.tobytes(), 1)] for n, p in zip(("once", "again"), parts, strict=True)}})

    return docs.select("text").mapInPandas(fill, "segment int, once binary, again binary")


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both filters of all tasks, segment by segment: what two of them have met once has been met again."""
    now, once, again = None, None, None
    for frame in frames:
        for segment, *parts in zip(frame["segment"], frame["once"], frame["again"], strict=True):
            one, two = (np.frombuffer(zlib.decompress(p), np.uint8) for p in parts)
            if segment != now:
                if now is not None:
                    yield pd.DataFrame({"segment": [now], "again": [again.tobytes()]})
                now, once, again = segment, one.copy(), two.copy()
                continue
            again |= two | (once & one)
            once |= one
    if now is not None:
        yield pd.DataFrame({"segment": [now], "again": [again.tobytes()]})


def suspected(docs: DataFrame, held: Broadcast, bits: int, least_chars: int) -> DataFrame:
    """``key, doc_id`` of every line that the second filter knows, once a document."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = Bloom(bits, held.value)
        for frame in slices(frames, ("text",)):
            keys, ids = [], []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                own = list(dict.fromkeys(k for k in keys_of(text, least_chars) if k is not None))
                keys += own
                ids += [doc_id] * len(own)
            hit = again.has(np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)) if keys else []
            at = np.flatnonzero(hit)
            yield pd.DataFrame({"key": [keys[i] for i in at], "doc_id": [ids[i] for i in at]}, dtype=object)

    # Ids travel as text, since a null among them would make pandas turn them into doubles.
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return plain.mapInPandas(ask, "key binary, doc_id string").withColumn("doc_id", F.col("doc_id").cast("long"))


def shared_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``key, keeper``: lines of at least ``least_docs`` documents, and the largest id among these.

    Rows that share an id are one document, those without id together are one that keeps nothing.
    """
    spark = docs.sparkSession
    ship_package(spark)
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_A_LINE * lines):
        bits *= 2
    parts = stored(filters_of(docs, bits, least_chars), "filters")
    whole = parts.repartition("segment").sortWithinPartitions("segment").mapInPandas(_joined, "segment int, again binary")
    again = np.zeros(bits >> 3, np.uint8)
    for row in whole.toLocalIterator():  # MOST_BITS at most
        again[row["segment"] * SEGMENT : row["segment"] * SEGMENT + len(row["again"])] = np.frombuffer(row["again"], np.uint8)
    held = spark.sparkContext.broadcast(again)
    found = suspected(docs, held, bits, least_chars).groupBy("key", "doc_id").agg(F.lit(1).alias("n"))
    confirmed = found.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= least_docs)
    out = stored(confirmed.select("key", "keeper"), "shared-lines")
    held.destroy()
    return out


def line_dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Every row with its ``text`` less the lines that other documents keep, ``n_lines`` it had and ``n_dropped``.

    A line is known by its text without ASCII white space at the ends, ASCII
    letters in lower case; shorter ones than ``least_chars`` code points always
    stay. A line of ``least_docs`` documents and more stays, wherever it stands, in
    the largest ``doc_id`` that holds it. A null or empty text is one empty line,
    and comes out empty; so does a text that loses all its lines. Texts of any
    length are taken whole, an empty table stays empty. All columns are kept; those
    with the new names are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col("text").cast("string")
    shared = shared_lines(docs.select("doc_id", text.alias("text")), least_docs, least_chars)
    small = shared.limit(BROADCAST_BYTES // LINE_BYTES + 1).count() <= BROADCAST_BYTES // LINE_BYTES
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    if small:
        held = spark.sparkContext.broadcast({bytes(r["key"]): r["keeper"] for r in shared.collect()})

        @F.pandas_udf("text string, n_lines long, n_dropped long")
        def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for ids, texts in batches:
                goes = lambda key, doc_id: key in held.value and str(held.value[key]) != doc_id
                yield _kept([(t, lambda k, d=d: goes(k, d)) for d, t in zip(ids, texts, strict=True)], least_chars)

        told = docs.select(*own, kept(F.col("doc_id").cast("string"), text).alias("_kept"))
    else:
        # Too many lines to send to every task: each document gets the list of its own.
        again = F.explode(_line_keys(text, least_chars)).alias("key")
        losing = docs.select("doc_id", again).distinct().join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        lists = losing.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("key").alias("_gone"))

        @F.pandas_udf("text string, n_lines long, n_dropped long")
        def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for gone, texts in batches:
                sets = [frozenset() if g is None else {bytes(k) for k in g} for g in gone]
                yield _kept([(t, s.__contains__) for s, t in zip(sets, texts, strict=True)], least_chars)

        joined = docs.select(*own, text.alias("text")).join(lists, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        told = joined.select(*own, kept("_gone", "text").alias("_kept"))
    return told.select(*own, "_kept.text", "_kept.n_lines", "_kept.n_dropped").select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def _kept(rows: list, least_chars: int) -> pd.DataFrame:
    out = []
    for text, goes in rows:
        lines = (text or "").split("\n")
        stay = [line for line, key in zip(lines, keys_of(text, least_chars), strict=True) if key is None or not goes(key)]
        out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def _line_keys(text, least_chars: int):
    @F.pandas_udf("array<binary>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list({k for k in keys_of(t, least_chars) if k is not None}))

    return run(text)
