"""Toxicity scores by a convolutional text classifier, with a threshold per language."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoweave.llm import langid
from phenoweave.llm.common import hash_sample, hashes_of_words, held_out, sized_join, slices
from phenoweave.session import ship_package, stored

#: Labelled documents, about, that the classifier is first trained on and that make a shard of all; one in CALIBRATION_SHARE chooses thresholds.
SAMPLE_ROWS, CALIBRATION_SHARE = 8000, 4
BUCKETS, DIMENSIONS, FILTERS, WIDTHS = 1 << 40, 16, 12, (1, 2, 3)
#: A word is also known by its first bytes. A bucket is learnt when it occurs in so many training documents.
PREFIX, LEAST_DOCS = 4, 3
EPOCHS, BATCH, RATE, DECAY, START = 4, 32, 0.05, 1e-5, 1e-4
#: A score of DECISION means exactly the threshold of the text's language.
DECISION = 0.7
#: Words that are convolved at a time.
WINDOW = 1 << 16
#: Embedding rows that make a part of the network, and bins of logits in a unit.
PART_ROWS, BINS = 1 << 13, 64
#: Parts of a network in training, see State.
STATE = "part int, shard int, at binary, numbers binary"

#: Letters and digits of ASCII and all bytes of longer characters make words.
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def buckets_of(text: str | None) -> np.ndarray:
    """Two hash buckets of every word, of the whole and of its beginning."""
    raw = (text or "").lower().encode()
    whole, beginning = hashes_of_words(raw, _IS_WORD, (None, PREFIX))
    return np.stack([whole % np.uint64(BUCKETS), beginning % np.uint64(BUCKETS) | np.uint64(BUCKETS)], axis=1).astype(np.int64)


@dataclass
class Network:
    """Hashed word embeddings, filters of several widths, their maxima over the text, one output.

    Only learnt buckets have a row; all others share the last, which stays zero.
    """

    buckets: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    offset: float
    _places: Callable[[np.ndarray], np.ndarray] | None = None

    @classmethod
    def new(cls, buckets: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        embedding = np.empty((len(buckets) + 1, DIMENSIONS), np.float32)
        for a in range(0, len(embedding), PART_ROWS):
            embedding[a : a + PART_ROWS] = draw(0.01, len(embedding[a : a + PART_ROWS]), DIMENSIONS)
        embedding[-1] = 0
        filters = [draw(0.3, w * DIMENSIONS, FILTERS) for w in WIDTHS]
        return cls(buckets, embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(0.3, len(WIDTHS) * FILTERS), 0.0)

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """The embedding row of every bucket."""
        if self._places is None:
            self._places = self.places(self.buckets)
        return self._places(buckets)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None}

    @staticmethod
    def places(known: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """Looks up where buckets stand among the known ones, which ascend; all others get the place after the last."""

        index = pd.Index(known)

        def found(buckets: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.zeros(buckets.shape, np.int64)
            at = index.get_indexer(buckets.ravel()).reshape(buckets.shape)
            return np.where(at < 0, len(known), at)

        return found

    def _windows(self, words: np.ndarray, width: int) -> np.ndarray:
        """Embeddings of every run of ``width`` words; the end is filled with zeros."""
        e = np.zeros((len(words) + width - 1, DIMENSIONS), np.float32)
        e[: len(words)] = self.embedding[words].sum(axis=1)
        return np.hstack([e[k : k + len(words)] for k in range(width)])

    def pooled(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of each filter over a text and the place of it; zeros for a text without words."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        place = np.zeros(len(WIDTHS) * FILTERS, np.int64)
        reach = max(WIDTHS) - 1
        for start in range(0, len(words), WINDOW):
            part = words[start : start + WINDOW + reach]
            for k, width in enumerate(WIDTHS):
                found = self._windows(part, width)[: WINDOW if len(part) > WINDOW else len(part)] @ self.filters[k] + self.biases[k]
                at = found.argmax(axis=0)
                top = np.maximum(found[at, np.arange(FILTERS)], 0)
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                higher = top > best[own]
                best[own] = np.where(higher, top, best[own])
                place[own] = np.where(higher, at + start, place[own])
        return best, place

    def maxima(self, texts: list[np.ndarray]) -> np.ndarray:
        """The maximum of each filter over each text, for texts side by side as far as WINDOW words reach; as :meth:`pooled`."""
        best = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        part, size = [], 0
        for d, text in enumerate(texts):
            if len(text) > WINDOW:
                best[d] = self.pooled(text)[0]
            elif len(text):
                if size + len(text) > WINDOW:
                    best[part] = self._together([texts[i] for i in part])
                    part, size = [], 0
                part.append(d)
                size += len(text)
        if part:
            best[part] = self._together([texts[i] for i in part])
        return best

    def _together(self, texts: list[np.ndarray]) -> np.ndarray:
        """Maxima of texts that have words: one product with all parts of all filters, whose results are shifted and added."""
        reach = max(WIDTHS)
        gap = np.full((reach, 2), len(self.buckets), np.int64)
        rows = np.concatenate([x for t in texts for x in (t, gap)])
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths + reach) - lengths - reach
        cells = np.stack([starts, starts + lengths], axis=1).ravel()
        filters = [f[s * DIMENSIONS : (s + 1) * DIMENSIONS] for f, width in zip(self.filters, WIDTHS, strict=True) for s in range(width)]
        products = (self.embedding[rows[:, 0]] + self.embedding[rows[:, 1]]) @ np.hstack(filters)
        count, best, at = len(rows) - reach + 1, [], 0
        for k, width in enumerate(WIDTHS):
            found = products[:count, at : at + FILTERS].copy()
            for s in range(1, width):
                found += products[s : s + count, at + s * FILTERS : at + (s + 1) * FILTERS]
            best.append(np.maximum(np.maximum.reduceat(found, cells)[::2] + self.biases[k], 0))
            at += width * FILTERS
        return np.hstack(best)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.maxima(texts).astype(np.float64) @ self.output.astype(np.float64) + self.offset

    def logit(self, words: np.ndarray) -> float:
        return float(self.pooled(words)[0] @ self.output) + self.offset


def _pooled_batch(net: Network, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, apart by zeros: their rows, maxima and the places of these. Beyond WINDOW words text by text."""
    gap = np.full((max(WIDTHS), 2), len(net.buckets), np.int64)
    rows = np.concatenate([x for t in texts for x in (t, gap)])
    ends = np.cumsum([len(t) + len(gap) for t in texts]) - len(gap)
    best = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
    place = np.zeros(best.shape, np.int64)
    if len(rows) > WINDOW:
        for d, (text, end) in enumerate(zip(texts, ends, strict=True)):
            best[d], at = net.pooled(text)
            place[d] = at + end - len(text)
        return rows, best, place
    e = net.embedding[rows].sum(axis=1)
    for k, width in enumerate(WIDTHS):
        count = len(rows) - width + 1
        found = np.hstack([e[s : s + count] for s in range(width)]) @ net.filters[k] + net.biases[k]
        for d, (text, end) in enumerate(zip(texts, ends, strict=True)):
            if len(text):
                part = found[end - len(text) : end]
                at = part.argmax(axis=0)
                best[d, k * FILTERS : (k + 1) * FILTERS] = np.maximum(part[at, np.arange(FILTERS)], 0)
                place[d, k * FILTERS : (k + 1) * FILTERS] = at + end - len(text)
    return rows, best, place


class _Scaled:
    """Steps divided by the root of the summed squares of past gradients."""

    def __init__(self, like: np.ndarray):
        self.squares = np.full(like.shape, START, np.float32)

    def step(self, value: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        self.squares[rows] += gradient**2
        value[rows] -= RATE * gradient / np.sqrt(self.squares[rows])


@dataclass
class State:
    """A network in training: what it has learnt and the past gradients of all of it."""

    network: Network
    scaled: dict

    @classmethod
    def of(cls, net: Network) -> State:
        return cls(net, {"embedding": _Scaled(net.embedding), "output": _Scaled(net.output), **{k: (_Scaled(net.filters[k]), _Scaled(net.biases[k])) for k in range(len(WIDTHS))}})

    def copy(self) -> State:
        return pickle.loads(pickle.dumps(self))

    def _small(self) -> list[np.ndarray]:
        """All numbers but the embedding's and the offset."""
        net, scaled, of = self.network, self.scaled, range(len(WIDTHS))
        return [net.output, *net.filters, *net.biases, scaled["output"].squares, *(scaled[k][i].squares for k in of for i in range(2))]

    def _rows(self, at: np.ndarray) -> np.ndarray:
        return np.hstack([self.network.embedding[at], self.scaled["embedding"].squares[at]])

    def parts(self, shard: int, before: State | None = None) -> pd.DataFrame:
        """``part, shard, at, numbers``: embedding rows in parts of PART_ROWS, all else as part -1; with a state before only what differs, less that."""
        squares = self.scaled["embedding"].squares
        old = before.scaled["embedding"].squares if before else np.float32(START)
        moved = np.flatnonzero((squares != old).any(axis=1))
        rest = np.concatenate([*(x.ravel() for x in self._small()), [self.network.offset]])
        if before:
            rest = rest - np.concatenate([*(x.ravel() for x in before._small()), [before.network.offset]])
        out = [(-1, shard, np.zeros(1, np.int64).tobytes(), rest.astype(np.float32).tobytes())]
        for own in np.split(moved, np.flatnonzero(np.diff(moved // PART_ROWS)) + 1) if len(moved) else []:
            numbers = self._rows(own) - before._rows(own) if before else self._rows(own)
            out.append((int(own[0] // PART_ROWS), shard, own.astype(np.int64).tobytes(), numbers.astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["part", "shard", "at", "numbers"])

    def take(self, rows: DataFrame, added: bool = False) -> None:
        """Put parts in their places, or add them; the driver gets few at a time."""
        kept = stored(rows, "state")
        net, squares = self.network, self.scaled["embedding"].squares
        for r in kept.repartition(1 + len(net.embedding) // (8 * PART_ROWS), "part").toLocalIterator():
            numbers = np.frombuffer(r["numbers"], np.float32)
            if r["part"] < 0:
                for x in self._small():
                    x[...] = numbers[: x.size].reshape(x.shape) + (x if added else 0)
                    numbers = numbers[x.size :]
                net.offset = float(numbers[0]) + (net.offset if added else 0.0)
                continue
            at, numbers = np.frombuffer(r["at"], np.int64), numbers.reshape(-1, 2 * DIMENSIONS)
            net.embedding[at] = numbers[:, :DIMENSIONS] + (net.embedding[at] if added else 0)
            squares[at] = numbers[:, DIMENSIONS:] + (squares[at] if added else 0)
        net.embedding[-1] = 0


def train(net: Network, texts: list[np.ndarray], y: np.ndarray, state: State | None = None, epochs: int = EPOCHS, mean: float | None = None, seed=5) -> Network:
    """Logistic loss with both labels weighed alike, by small batches in a fixed order; only maxima carry gradients.

    Texts are rows of the embedding, two for each word. With ``state`` the network
    is the one in it and goes on from past gradients; ``mean`` is the share of the
    label in all rows, where these are some of them.
    """
    if mean is None and (not len(y) or y.min() == y.max()):
        net.output[:] = 0
        net.offset = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        return net
    mean = y.mean() if mean is None else mean
    weight = np.where(y > 0, 0.5 / mean, 0.5 / (1 - mean))
    scaled = (state or State.of(net)).scaled
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            rows, best, place = _pooled_batch(net, [texts[i] for i in batch])
            error = weight[batch] * (1 / (1 + np.exp(-np.clip(best @ net.output + net.offset, -30, 30))) - y[batch]) / len(batch)
            doc, cell = np.nonzero(best > 0)
            slope = (error[doc] * net.output[cell]).astype(np.float32)
            touched, slopes, steps = [], [], []
            for k, width in enumerate(WIDTHS):
                own = cell // FILTERS == k
                at = place[doc[own], cell[own]][:, None] + np.arange(width)
                j, up = cell[own] % FILTERS, slope[own][:, None]
                gradient = np.zeros_like(net.filters[k].T)
                np.add.at(gradient, j, up * net.embedding[rows[at]].sum(axis=2).reshape(len(at), -1))
                steps.append((gradient.T, np.bincount(j, slope[own], FILTERS).astype(np.float32)))
                touched.append(rows[at].reshape(-1))
                slopes.append(np.repeat((up * net.filters[k].T[j]).reshape(-1, DIMENSIONS), 2, axis=0))
            scaled["output"].step(net.output, (error @ best + DECAY * net.output).astype(np.float32))
            net.offset -= RATE * float(error.sum())
            for k, (for_filters, for_biases) in enumerate(steps):
                scaled[k][0].step(net.filters[k], for_filters + DECAY * net.filters[k])
                scaled[k][1].step(net.biases[k], for_biases)
            used, where = np.unique(np.concatenate(touched), return_inverse=True)
            gradient = np.zeros((len(used), DIMENSIONS), np.float32)
            np.add.at(gradient, where, np.concatenate(slopes))
            scaled["embedding"].step(net.embedding, gradient, used)
            net.embedding[-1] = 0
    return net


@dataclass
class Classifier:
    network: Network
    languages: langid.LanguageModel
    thresholds: dict[str, float]
    common: float

    def scores(self, texts: list[str | None], scorer: langid.Scorer) -> np.ndarray:
        """Sigmoids of the logits, moved so that DECISION stands at the threshold of each text's predicted language."""
        langs = langid.predicted(scorer, texts)[0]
        limits = np.array([self.thresholds.get(lang, self.common) for lang in langs])
        logits = self.network.logits([self.network.rows(buckets_of(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(logits - limits + np.log(DECISION / (1 - DECISION)), -30, 30)))


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which the fewest documents are judged wrongly; of equal gaps the widest."""
    order = np.argsort(logits, kind="stable")
    logits, y = logits[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[logits[0] - 2], logits, [logits[-1] + 2]])
    gaps = np.diff(edges)
    gaps[wrong > wrong.min()] = -1
    k = int(gaps.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def learn(docs: DataFrame, labels: DataFrame, label: str, vocabulary_path: str, folds: int = 3, kept: int = 1, limit: int = SAMPLE_ROWS) -> Classifier:
    """Train on all labelled documents outside the held-out fold but one in four, which choose the thresholds.

    About ``limit`` of them, taken by hash, are trained on first and in one task;
    what they give is where all of them start from, in shards of about as many
    (:func:`_refined`). Languages are told apart by a model learnt from all
    documents of the same folds, and only from text when a score is made. A null
    label counts as none; of several labels of one document the highest holds. A
    language without both labels in the calibration part takes the threshold of all.
    """
    spark = docs.sparkSession
    learnt = ~held_out("doc_id", folds, kept)
    languages = langid.learn(docs, vocabulary_path, learnt, None)
    known = stored(labels.where(F.col(label).isNotNull() & learnt).groupBy("doc_id").agg((F.max(label).cast("double") > 0).cast("double").alias("_label")), "known")
    first = hash_sample(known, "doc_id", limit).select("doc_id", F.lit(True).alias("first"))
    marked = stored(sized_join(known, first, "doc_id", "left"), "marked")
    rows = sized_join(docs.select("doc_id", F.col("text").cast("string").alias("text")), marked, "doc_id", "inner")
    rows = rows.select(F.col("_label").alias("y"), F.xxhash64("doc_id").alias("order"), F.coalesce("first", F.lit(False)).alias("first"), "text")
    rows = rows.withColumn("apart", F.pmod("order", F.lit(CALIBRATION_SHARE)) == 0)

    ship_package(spark)
    counted = rows.where(~F.col("apart")).select("text").mapInPandas(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    learnable = counted.where(F.col("n") >= LEAST_DOCS).select("bucket").mapInPandas(_joined, "buckets binary").collect()
    buckets = np.sort(np.concatenate([np.frombuffer(r["buckets"], np.int64) for r in learnable] or [np.empty(0, np.int64)]))
    held = spark.sparkContext.broadcast((buckets, languages))

    @F.pandas_udf("words binary, lang string")
    def hashed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        """Rows of the embedding; the language of texts that choose thresholds."""
        places, scorer = Network.places(held.value[0]), langid.Scorer(held.value[1])
        for texts, apart in batches:
            langs = np.full(len(texts), None, object)
            if apart.any():
                langs[apart] = langid.predicted(scorer, texts[apart].tolist())[0]
            yield pd.DataFrame({"words": [places(buckets_of(t)).astype(np.int32).tobytes() for t in texts], "lang": langs})

    cut = stored(rows.select("y", "order", "first", "apart", hashed("text", "apart").alias("_")).select("y", "order", "first", "apart", "_.*"), "hashed")
    held.destroy()
    training, calibration = cut.where(~F.col("apart")), cut.where("apart")
    count, positive, rest = training.agg(F.count("*"), F.sum("y"), F.count(F.when(~F.col("first"), 1))).first()
    state = State.of(Network.new(buckets))
    if not count or positive in (0, count):
        state.network.output[:] = 0
        state.network.offset = math.log(((positive or 0) + 1) / (count - (positive or 0) + 1))
    else:
        state.take(_begun(training.where("first"), buckets))
        if rest:
            _refine(training, state, math.ceil(count / max(1, limit)), positive / count)
    network = state.network
    return Classifier(network, languages, *_thresholds(calibration, network))


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts each bucket occurs."""
    for part in slices(frames, ("text",)):
        found, n = np.unique(np.concatenate([np.unique(buckets_of(t)) for t in part["text"]]), return_counts=True)
        yield pd.DataFrame({"bucket": found, "n": n})


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"buckets": [frame["bucket"].to_numpy(np.int64).tobytes()]})


def _in_order(frame: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    frame = frame.sort_values("order", kind="stable")
    return [np.frombuffer(w, np.int32).reshape(-1, 2) for w in frame["words"]], frame["y"].to_numpy(float)


def _begun(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """What a new network is like after training on the rows, which are bounded, in one task; nothing where they have one label."""
    held = rows.sparkSession.sparkContext.broadcast(buckets)

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, y = _in_order(pd.concat([pd.DataFrame({"y": [], "order": [], "words": []}), *frames]))
        if len(y) and y.min() < y.max():
            state = State.of(Network.new(held.value))
            train(state.network, texts, y, state)
            yield state.parts(0)

    return rows.select("y", "order", "words").repartition(1).mapInPandas(fitted, STATE)


def _refine(rows: DataFrame, state: State, shards: int, mean: float) -> None:
    """Pass EPOCHS times over all rows.

    In a pass every shard, which is a share of the rows by hash, goes over its
    rows from the same network, and the means of what the shards changed are
    added: of an embedding row over the shards that changed it, of all else over
    all shards. A task holds one shard and one network, the driver one network.
    """
    dealt = rows.select("y", "order", "words", F.pmod(F.xxhash64("order"), F.lit(shards)).cast("int").alias("shard"))
    for epoch in range(EPOCHS):
        held = rows.sparkSession.sparkContext.broadcast(state)
        changes = dealt.groupBy("shard").applyInPandas(_pass(held, mean, epoch), STATE)
        state.take(changes.groupBy("part").applyInPandas(_mean_changes, STATE), added=True)
        held.destroy()


def _pass(held: Broadcast, mean: float, epoch: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def passed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = held.value.copy()
        train(own.network, *_in_order(frame), own, 1, mean, (5, epoch, int(key[0])))
        return own.parts(int(key[0]), held.value)

    return passed


def _mean_changes(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The changes of one part of the network: places that any shard changed, and the means over those that did."""
    frame = frame.sort_values("shard")
    places = [np.frombuffer(a, np.int64) for a in frame["at"]]
    at, into = np.unique(np.concatenate(places), return_inverse=True)
    changes = np.concatenate([np.frombuffer(c, np.float32).reshape(len(a), -1) for a, c in zip(places, frame["numbers"], strict=True)])
    total = np.zeros((len(at), changes.shape[1]))
    np.add.at(total, into, changes)
    mean = total / np.bincount(into, minlength=len(at))[:, None]
    return pd.DataFrame({"part": [key[0]], "shard": [0], "at": [at.tobytes()], "numbers": [mean.astype(np.float32).tobytes()]})


def _thresholds(rows: DataFrame, network: Network) -> tuple[dict[str, float], float]:
    """The threshold of every language with both labels among the rows, and that of all: as :func:`_threshold`, which no task gives all rows.

    Logits are counted in bins. Where a bin may hold the best cut its rows are
    looked at, bin by bin.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(network)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [np.frombuffer(w, np.int32).reshape(-1, 2) for w in frame["words"]]
            yield frame[["y", "order", "lang"]].assign(logit=held.value.logits(texts))

    found = stored(rows.mapInPandas(scored, "y double, order long, lang string, logit double").withColumn("bin", F.floor(F.col("logit") * BINS)), "logits")
    held.destroy()
    each = found.groupBy("lang", "bin").agg(F.sum("y").alias("y"), F.count("*").alias("n"), F.min("logit").alias("low"), F.max("logit").alias("high")).toPandas()
    tables = {name: own.sort_values("bin") for name, own in each.groupby("lang")}
    tables[None] = each.groupby("bin", as_index=False).agg({"y": "sum", "n": "sum", "low": "min", "high": "max"}).sort_values("bin")
    best, looked = {}, []
    for name, bins in tables.items():
        if not 0 < bins["y"].sum() < bins["n"].sum():
            continue
        y, n = bins["y"].to_numpy(), bins["n"].to_numpy()
        below, above = np.cumsum(y) - y, (n - y).sum() - np.cumsum(n - y)
        nearest = np.append(bins["low"].to_numpy()[1:], bins["high"].iloc[-1] + 2)
        best[name] = [((n - y).sum(), bins["low"].iloc[0] - 2, bins["low"].iloc[0])]
        least = min((below + y + above).min(), best[name][0][0])
        kept = np.flatnonzero(below + above <= least)
        looked += [(name, int(bins["bin"].iloc[i]), float(below[i]), float(above[i]), float(nearest[i])) for i in kept]
    if looked:
        wanted = F.broadcast(spark.createDataFrame(looked, "name string, bin long, below double, above double, nearest double"))
        of = F.col("name").isNull() | (F.col("name") == F.col("lang"))
        cuts = found.join(wanted, "bin").where(of).groupBy("name", "bin").applyInPandas(_best_cut, "name string, wrong double, low double, high double")
        for r in cuts.collect():  # one per bin that may hold the best cut
            best[r["name"]].append((r["wrong"], r["low"], r["high"]))
    limits = {}
    for name, cuts in best.items():
        _, low, high = min(cuts, key=lambda c: (c[0], c[1] - c[2], c[1]))
        limits[name] = float((low + high) / 2)
    common = limits.pop(None, float(np.log(DECISION / (1 - DECISION))))
    return limits, common


def _best_cut(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the cuts above each row of a bin the one at which the fewest rows of all bins are judged wrongly, of equal ones the widest."""
    frame = frame.sort_values(["logit", "order"], kind="stable")
    y, logits = frame["y"].to_numpy(), frame["logit"].to_numpy()
    wrong = frame["below"].iloc[0] + np.cumsum(y) + frame["above"].iloc[0] + (1 - y).sum() - np.cumsum(1 - y)
    edges = np.append(logits, frame["nearest"].iloc[0])
    gaps = np.diff(edges)
    gaps[wrong > wrong.min()] = -1
    k = int(gaps.argmax())
    return pd.DataFrame({"name": [frame["name"].iloc[0]], "wrong": [wrong[k]], "low": [edges[k]], "high": [edges[k + 1]]})


def toxicity(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Every row with ``toxicity_score``, 0 to 1; DECISION and more means toxic.

    The whole text is convolved, in windows that overlap by the widest filter. A
    null text counts as empty; repeated rows stay and an empty table stays empty;
    all columns are kept, one with the new name is replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = langid.Scorer(held.value.languages)
        for batch in batches:
            parts = [held.value.scores(part["text"].tolist(), scorer) for part in slices([pd.DataFrame({"text": batch})], ("text",))]
            yield pd.Series(np.concatenate(parts or [np.empty(0)]))

    own = [c for c in docs.columns if c != "toxicity_score"]
    return docs.select(*own, run(F.col("text").cast("string")).alias("toxicity_score"))
