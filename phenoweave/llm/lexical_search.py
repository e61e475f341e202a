"""Ranked lexical search by the Best Position Algorithm, on shards of the documents.

A shard is what one task holds of the documents: for every asked term the list of
its documents by falling impact, and for every document the places it has in
these lists. A query reads its lists from the top, in blocks that double; each
document met is scored at once by direct accesses, which also mark its places in
the other lists. The best position of a list is the end of its marked beginning.
No document that is not yet met can score more than the impacts at the best
positions together, so a query ends once that is strictly below its k-th score.
Shards return their best documents, and the best of these are the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenoweave.llm.common import slices, word_hashes
from phenoweave.session import ship_package, stored

TOP = 20
#: Postings that a shard holds at most (one batch of documents at least), and entries a list is first read by.
SHARD_POSTINGS, FIRST_READ = 1 << 21, 64
#: Terms, with repeats, that are asked for in one pass over the documents.
PASS_TERMS = 1 << 18

#: Bytes of terms, ASCII letters and digits and all of longer characters; the constants of the score.
_IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_SCALE, _LENGTH_SHARE, _SATURATION = 1_000_000_000, 25, 12


def term_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the terms of a text in order, ASCII letters in lower case."""
    return word_hashes((text or "").encode().lower(), _IS_TERM)


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, counts`` of every row: its number of terms, and the asked ones among them, by their place in ``terms``."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, ("text",)):
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                found = term_hashes(text)
                at = np.minimum(np.searchsorted(held.value, found), max(0, len(held.value) - 1))
                at = at[held.value[at] == found] if len(held.value) else at[:0]
                own, times = np.unique(at, return_counts=True)
                out.append((doc_id, len(found), own.astype(np.int32).tobytes(), times.astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "counts"])

    # Ids travel as text, since a null among them would make pandas turn them into doubles.
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(count, "doc_id string, n long, terms binary, counts binary")


def document_counts(held: DataFrame, terms: int) -> np.ndarray:
    """In how many rows each asked term occurs; one row per term and task is shuffled."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(terms, np.int64)
        for frame in frames:
            total += np.bincount(np.frombuffer(b"".join(frame["terms"]), np.int32), minlength=terms)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    out = np.zeros(terms, np.int64)
    for r in held.select("terms").mapInPandas(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the asked terms
        out[r["term"]] = r["df"]
    return out


@dataclass
class Queries:
    """Asked terms of every query, with weights times repeats; ``number`` names the query."""

    number: list[int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]


class Shard:
    """Documents of one task in both directions: lists by impact, and entries by document."""

    def __init__(self, ids: list[str | None], n: np.ndarray, terms: list[bytes], counts: list[bytes], n_terms: int, docs: int, tokens: int):
        sizes = np.array([len(t) // 4 for t in terms], np.int64)
        self.ids, self.starts = ids, np.concatenate([[0], np.cumsum(sizes)])
        self.term = np.frombuffer(b"".join(terms), np.int32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), sizes)
        tf = np.frombuffer(b"".join(counts), np.int32).astype(np.int64)
        m = 100 - _LENGTH_SHARE + (_LENGTH_SHARE * n * docs) // max(1, tokens)
        self.impact = (_SCALE * tf) // (1000 * tf + _SATURATION * m[self.doc])
        order = np.lexsort((self.doc, -self.impact, self.term))
        self.lists = order  # entries, list after list, by falling impact
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=n_terms))])
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order)) - self.ends[self.term[order]]

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All entries of some documents and whose they are, as places in ``docs``."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        owner = np.repeat(np.arange(len(docs)), sizes)
        first = np.cumsum(sizes) - sizes
        return np.arange(len(owner)) - first[owner] + self.starts[docs][owner], owner

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, scratch: np.ndarray, block: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the best ``k`` above 0, and more on equal terms; how many were scored.

        ``scratch`` holds -1 for every term and is given back so.
        """
        lengths = self.ends[terms + 1] - self.ends[terms]
        there = lengths > 0
        terms, weights, lengths = terms[there], weights[there], lengths[there]
        found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not len(terms):
            return found[0], scores[0], 0
        scratch[terms] = np.arange(len(terms))
        marks = [np.zeros(length, bool) for length in lengths]
        met = np.zeros(len(self.ids), bool)
        best, read = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        while True:
            parts = []
            for i, term in enumerate(terms):
                start = max(read[i], best[i])  # what is marked has been met
                read[i] = min(lengths[i], start + block)
                parts.append(self.doc[self.lists[self.ends[term] + start : self.ends[term] + read[i]]])
            new = np.unique(np.concatenate(parts))
            new = new[~met[new]]
            met[new] = True
            entry, owner = self.entries(new)
            list_of = scratch[self.term[entry]]
            asked = list_of >= 0
            entry, owner, list_of = entry[asked], owner[asked], list_of[asked]
            total = np.zeros(len(new), np.int64)
            np.add.at(total, owner, weights[list_of] * self.impact[entry])
            found.append(new)
            scores.append(total)
            order = np.argsort(list_of, kind="stable")
            cuts = np.searchsorted(list_of[order], np.arange(len(terms) + 1))
            bound = 0
            for i, term in enumerate(terms):
                marks[i][self.place[entry[order[cuts[i] : cuts[i + 1]]]]] = True
                rest = marks[i][read[i] :]
                best[i] = read[i] + (int(rest.argmin()) if not rest.all() else len(rest))
                if best[i] < lengths[i]:
                    bound += int(weights[i]) * int(self.impact[self.lists[self.ends[term] + best[i] - 1]])
            everything = np.concatenate(scores)
            if bound == 0 or (len(everything) >= k and bound < np.partition(everything, len(everything) - k)[len(everything) - k]):
                break
            block *= 2
        scratch[terms] = -1
        docs = np.concatenate(found)
        if len(docs) > k:
            kth = np.partition(everything, len(docs) - k)[len(docs) - k]
            top = everything >= kth
            docs, everything = docs[top], everything[top]
        return docs[everything > 0], everything[everything > 0], int(met.sum())


def _searched(held: DataFrame, queries: Queries, n_terms: int, docs: int, tokens: int, k: int) -> DataFrame:
    """``query, doc_id, score``: the best ``k`` documents of every shard for every query."""
    asked, most = held.sparkSession.sparkContext.broadcast(queries), SHARD_POSTINGS

    def answers(part: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(part, ignore_index=True)
        shard = Shard(frame["doc_id"].tolist(), frame["n"].to_numpy(np.int64), frame["terms"].tolist(), frame["counts"].tolist(), n_terms, docs, tokens)
        # Equal scores go by id, null last.
        order = np.array([(1 << 63) - 1 if d is None else int(d) for d in shard.ids])
        scratch, rows = np.full(n_terms, -1, np.int64), {"query": [], "doc_id": [], "score": []}
        for number, terms, weights in zip(asked.value.number, asked.value.terms, asked.value.weights, strict=True):
            found, score, _ = shard.best(terms, weights, k, scratch)
            for j in np.lexsort((order[found], -score))[:k]:
                rows["query"].append(number)
                rows["doc_id"].append(shard.ids[found[j]])
                rows["score"].append(int(score[j]))
        return pd.DataFrame(rows, dtype=object)  # an empty column of strings cannot be handed on

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, size = [], 0
        for frame in frames:
            part.append(frame)
            size += int(frame["terms"].map(len).sum()) // 4
            if size >= most:
                yield answers(part)
                part, size = [], 0
        if part:
            yield answers(part)

    return held.mapInPandas(run, "query long, doc_id string, score long").withColumn("doc_id", F.col("doc_id").cast("long"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item above score 0, equal ones by ``doc_id``, null last.

    Terms of null texts there are none; an item without terms, or whose terms no
    document holds, has no rows. Every row is a document, and every row of
    ``items`` an item, of its own, so equal ids may show repeatedly (items: with
    ranks of their own). Items are asked in passes of about PASS_TERMS terms; in a
    pass each document's counts of the asked terms are written once, then searched
    where they lie. Texts count whole, whatever their length; without documents
    there are no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    # Items are asked for in blocks, so that what is sent to the tasks stays within PASS_TERMS.
    numbered = stored(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("_n", F.monotonically_increasing_id()), "items")
    size = numbered.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-size // (4 * PASS_TERMS)))
    out = None
    for number in range(passes):
        rows = numbered.where(F.pmod(F.xxhash64("_n"), F.lit(passes)) == number).select("_n", "text").collect()
        found = _one_pass(docs, [(r["_n"], term_hashes(r["text"])) for r in rows], k)
        out = found if out is None else out.union(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = out.withColumn("rank", rank).where(F.col("rank") <= k)
    named = ranked.join(numbered.select(F.col("_n").alias("query"), "item_id"), "query")
    return named.select("item_id", "rank", "doc_id", "score")


def _one_pass(docs: DataFrame, items: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    every = [hashes for _, hashes in items] or [np.empty(0, np.uint64)]
    terms = np.unique(np.concatenate(every))
    held = stored(postings(docs, terms), "postings")
    there = held.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    n_docs, tokens = there["docs"], there["tokens"] or 0
    df = document_counts(held, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    queries = Queries([], [], [])
    for number, hashes in items:
        own, times = np.unique(np.searchsorted(terms, hashes), return_counts=True)
        queries.number.append(number)
        queries.terms.append(own)
        queries.weights.append(weight[own] * times)
    return stored(_searched(held, queries, len(terms), n_docs, tokens, k), "answers")
