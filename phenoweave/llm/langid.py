"""Language identification: unigram piece models, each text scored over all its segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoweave.llm.common import hash_sample, slices
from phenoweave.session import ship_package, stored

#: Documents, about, that each language is learnt from.
SAMPLE_DOCS = 1000
#: Words up to so many letters are scored many at a time; longer ones one by one, with sums carried along and rescaled.
SIDE_BY_SIDE = 24
#: Letters after which carried sums are rescaled.
RESCALED = 16
ROUNDS, SMOOTHING = 4, 0.1
#: Words whose scores a worker remembers, and words scored at a time; fewer beyond FULL_LANGUAGES languages.
REMEMBERED, WORDS_AT_ONCE, FULL_LANGUAGES = 1 << 18, 8192, 64

SPACE = "▁"
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case words; none if no character of the text is a letter."""
    found = _WORDS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for word in found for c in word) else []


def vocabulary(path: str) -> list[str]:
    """Pieces of the public vocabulary made of lower-case letters, with or without a word start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    fit = (p for p in pieces if (p == SPACE or (p.removeprefix(SPACE).isalpha() and p.lower() == p)))
    return sorted(dict.fromkeys(fit))


class Lattice:
    """Every place where a piece of the vocabulary matches, for many words of one length at once or for a single word."""

    def __init__(self, pieces: list[str]):
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.places, self.size = pd.Index(keys[order].view(np.int64)), order, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.row = {p: i for i, p in enumerate(pieces)}

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        return value

    def edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, piece) in order of start; a letter that is no piece is the piece ``size``."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
        codes = np.ascontiguousarray(codes.T, np.uint64) + np.uint64(1)
        length = len(codes)
        for start in range(length):
            value = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                value = value * _BASE + codes[end - 1]
                at = self.keys.get_indexer(value.view(np.int64))
                known = at >= 0
                if end == start + 1:
                    yield start, end, np.arange(len(words)), np.where(known, self.places[at], self.size)
                elif known.any():
                    rows = np.flatnonzero(known)
                    yield start, end, rows, self.places[at[rows]]

    def pieces_at(self, word: str, start: int) -> list[tuple[int, int]]:
        """(end, piece) of all pieces that begin at a place of a word."""
        out = [(start + 1, self.row.get(word[start], self.size))]
        for end in range(start + 2, min(len(word), start + self.longest) + 1):
            piece = self.row.get(word[start:end])
            if piece is not None:
                out.append((end, piece))
        return out


def _bounded(words: int, languages: int) -> int:
    """So many words that their scores take no more memory than ``words`` of FULL_LANGUAGES languages."""
    return max(1, words * FULL_LANGUAGES // max(FULL_LANGUAGES, languages))


def _by_length(words: list[str], most: int = WORDS_AT_ONCE) -> Iterator[np.ndarray]:
    """Places of words of one length, as many as are scored at a time; words beyond SIDE_BY_SIDE letters one by one."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        if length > SIDE_BY_SIDE + 1:
            yield from np.flatnonzero(lengths == length)[:, None]
            continue
        rows = np.flatnonzero(lengths == length)
        for k in range(0, len(rows), most):
            yield rows[k : k + most]


def _long_scores(word: str, p: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Logs of the forward sums of a long word, a column per language; only sums that a piece still reaches are held."""
    held, logs = np.zeros((lattice.longest + 1, p.shape[1])), np.zeros(p.shape[1])
    held[0] = 1
    for start in range(len(word)):
        at = start % len(held)
        for end, piece in lattice.pieces_at(word, start):
            held[end % len(held)] += held[at] * p[piece]
        held[at] = 0
        if start % RESCALED == RESCALED - 1:
            largest = held.max(axis=0)
            held /= largest
            logs += np.log(largest)
    return np.log(held[len(word) % len(held)]) + logs


def _long_expected(word: str, p: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Pieces used in a long word and how often each is expected, over all segmentations."""
    edges = [(start, end, piece) for start in range(len(word)) for end, piece in lattice.pieces_at(word, start)]
    logs = np.log(p)
    ahead, behind = np.full(len(word) + 1, -np.inf), np.full(len(word) + 1, -np.inf)
    ahead[0] = behind[len(word)] = 0.0
    for start, end, piece in edges:
        ahead[end] = np.logaddexp(ahead[end], ahead[start] + logs[piece])
    for start, end, piece in reversed(edges):
        behind[start] = np.logaddexp(behind[start], logs[piece] + behind[end])
    start, end, piece = np.array(edges).T
    return piece, np.exp(ahead[start] + logs[piece] + behind[end] - ahead[len(word)])


@dataclass
class LanguageModel:
    """Piece probabilities, one column per language; the last row is for letters that are no piece."""

    pieces: list[str]
    languages: list[str]
    probabilities: np.ndarray
    #: Log likelihood per letter, by language, halfway between the learnt words and words of letters by chance.
    floors: np.ndarray | None = None

    def word_scores(self, words: list[str], lattice: Lattice) -> np.ndarray:
        """Log probability of each word in each language: the forward sum over its segmentations."""
        marked = [SPACE + w for w in words]
        out = np.zeros((len(words), len(self.languages)))
        for rows in _by_length(marked, _bounded(WORDS_AT_ONCE, len(self.languages))):
            part = [marked[r] for r in rows]
            if len(part[0]) > SIDE_BY_SIDE + 1:
                out[rows[0]] = _long_scores(part[0], self.probabilities, lattice)
                continue
            ways = np.zeros((len(part[0]) + 1, len(part), len(self.languages)))
            ways[0] = 1
            for start, end, at, piece in lattice.edges(part):
                ways[end, at] += ways[start, at] * self.probabilities[piece]
            out[rows] = np.log(np.maximum(ways[-1], 1e-300))
        return out


def _expected(words: list[str], counts: np.ndarray, p: np.ndarray, lattice: Lattice) -> np.ndarray:
    """How often each piece is expected to be used over all segmentations of counted words."""
    marked = [SPACE + w for w in words]
    used = np.zeros(lattice.size + 1)
    for rows in _by_length(marked):
        part = [marked[r] for r in rows]
        length = len(part[0])
        if length > SIDE_BY_SIDE + 1:
            piece, times = _long_expected(part[0], p, lattice)
            used += np.bincount(piece, times * counts[rows[0]], lattice.size + 1)
            continue
        edges = list(lattice.edges(part))
        ahead, behind = np.zeros((length + 1, len(part))), np.zeros((length + 1, len(part)))
        ahead[0] = behind[length] = 1
        for start, end, at, piece in edges:
            ahead[end, at] += ahead[start, at] * p[piece]
        for start, end, at, piece in reversed(edges):
            behind[start, at] += p[piece] * behind[end, at]
        share = counts[rows] / np.maximum(ahead[length], 1e-300)
        for start, end, at, piece in edges:
            used += np.bincount(piece, ahead[start, at] * p[piece] * behind[end, at] * share[at], lattice.size + 1)
    return used


def _matches(words: list[str], counts: np.ndarray, lattice: Lattice) -> np.ndarray:
    """How often each piece matches in counted words."""
    marked = [SPACE + w for w in words]
    found = np.zeros(lattice.size + 1)
    for rows in _by_length(marked):
        part = [marked[r] for r in rows]
        if len(part[0]) > SIDE_BY_SIDE + 1:
            pieces = [piece for start in range(len(part[0])) for _, piece in lattice.pieces_at(part[0], start)]
            found += np.bincount(pieces, minlength=lattice.size + 1) * counts[rows[0]]
            continue
        for _, _, at, piece in lattice.edges(part):
            found += np.bincount(piece, counts[rows][at], lattice.size + 1)
    return found


def _chance_words(count: int = 1000) -> list[str]:
    """Fixed words of three to nine letters that have nothing to do with each other."""
    rng = np.random.default_rng(7)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(3, 10, count)]


def _floor(words: list[str], counts: np.ndarray, p: np.ndarray, lattice: Lattice, pieces: list[str]) -> float:
    """The middle of the log likelihoods per letter, a word's start counted as one, of counted words and of chance words."""
    model = LanguageModel(pieces, [""], p[:, None])

    def per_letter(words: list[str], counts: np.ndarray) -> float:
        return float(counts @ model.word_scores(words, lattice)[:, 0]) / float(counts @ np.array([len(w) + 1 for w in words]))

    chance = _chance_words()
    return (per_letter(words, counts) + per_letter(chance, np.ones(len(chance)))) / 2


def fit_one(words: dict[str, int], lattice: Lattice, pieces: list[str]) -> tuple[np.ndarray, float]:
    """Expectation maximisation of one language over its word counts, from how often each piece matches; with its floor."""
    known = sorted(words)
    counts = np.array([words[w] for w in known], float)
    used = _matches(known, counts, lattice)
    for _ in range(ROUNDS):
        p = (used + SMOOTHING) / (used.sum() + SMOOTHING * len(used))
        used = _expected(known, counts, p, lattice)
    p = (used + SMOOTHING) / (used.sum() + SMOOTHING * len(used))
    return p, _floor(known, counts, p, lattice, pieces)


def learn(docs: DataFrame, path: str, learnt, limit: int | None = SAMPLE_DOCS) -> LanguageModel:
    """Fit on about ``limit`` documents of every language among the rows where ``learnt`` holds, or on all of them without a limit.

    Null texts and null languages teach nothing. With a limit every language is
    fitted in a task of its own, on the words of its share of the sample; without
    one the words of all languages are dealt over tasks and a round is a pass over
    them. Only probabilities, some 180 KB a language, reach the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnt)
    texts = rows.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    sample = texts if limit is None else hash_sample(texts, "doc_id", limit, "lang")
    pieces = vocabulary(path)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, ("text",)):
            found: dict[str, Counter] = {}
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in found.items():
                if words:
                    yield pd.DataFrame({"lang": lang, "word": list(words), "n": list(words.values())})

    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(pieces)

    def fitted(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        words = frame.groupby("word")["n"].sum().to_dict()
        p, floor = fit_one(words, Lattice(held.value), held.value)
        return pd.DataFrame({"lang": [key[0]], "p": [p.tobytes()], "floor": [floor]})

    counted = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    if limit is None:
        held.destroy()
        return _fitted_together(counted, pieces)
    found = sorted(counted.groupBy("lang").applyInPandas(fitted, "lang string, p binary, floor double").collect(), key=lambda r: r["lang"])
    held.destroy()
    columns = [np.frombuffer(r["p"]) for r in found]
    floors = np.array([r["floor"] for r in found])
    return LanguageModel(pieces, [r["lang"] for r in found], np.stack(columns, axis=1) if columns else np.empty((len(pieces) + 1, 0)), floors)


def _fitted_together(counted: DataFrame, pieces: list[str]) -> LanguageModel:
    """:func:`fit_one` for all languages of a table ``lang, word, n``, of any number of words: sums over words are taken by tasks."""
    spark = counted.sparkSession
    words = stored(counted.sortWithinPartitions("lang", F.length("word")), "words")  # words of one length are worked on together

    def total(step: Callable[[str, list[str], np.ndarray, Lattice], np.ndarray]) -> dict[str, np.ndarray]:
        """The sums of every language; a task holds those of one language."""

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice, now, sums = Lattice(pieces), None, None
            for frame in frames:
                for lang, own in frame.groupby("lang"):
                    found = step(lang, own["word"].tolist(), own["n"].to_numpy(float), lattice)
                    if lang != now and now is not None:
                        yield pd.DataFrame({"lang": [now], "sums": [sums.tobytes()]})
                    sums = sums + found if lang == now else found
                    now = lang
            if now is not None:
                yield pd.DataFrame({"lang": [now], "sums": [sums.tobytes()]})

        def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            parts = np.stack([np.frombuffer(s) for s in frame["sums"]])
            return pd.DataFrame({"lang": [key[0]], "sums": [np.sort(parts, axis=0).sum(axis=0).tobytes()]})  # the same in any order

        rows = words.mapInPandas(part, "lang string, sums binary").groupBy("lang").applyInPandas(added, "lang string, sums binary").collect()
        return {r["lang"]: np.frombuffer(r["sums"]) for r in sorted(rows)}

    used = total(lambda lang, known, counts, lattice: _matches(known, counts, lattice))
    for left in range(ROUNDS, -1, -1):
        p = {lang: (u + SMOOTHING) / (u.sum() + SMOOTHING * len(u)) for lang, u in used.items()}
        held = spark.sparkContext.broadcast(p)
        if left:
            used = total(lambda lang, known, counts, lattice, held=held: _expected(known, counts, held.value[lang], lattice))
        else:

            def letters(lang: str, known: list[str], counts: np.ndarray, lattice: Lattice) -> np.ndarray:
                scores = LanguageModel(pieces, [""], held.value[lang][:, None]).word_scores(known, lattice)[:, 0]
                return np.array([counts @ scores, counts @ np.array([len(w) + 1 for w in known])])

            sums = total(letters)
        held.destroy()
    columns = np.stack(list(p.values()), axis=1) if p else np.empty((len(pieces) + 1, 0))
    model = LanguageModel(pieces, list(p), columns)
    chance = _chance_words()
    by_chance = model.word_scores(chance, Lattice(pieces)).sum(axis=0) / sum(len(w) + 1 for w in chance)
    model.floors = (np.array([sums[lang][0] / sums[lang][1] for lang in p]) + by_chance) / 2
    return model


class Scorer:
    """Log probabilities of texts; remembers words within a bound."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)), np.float32)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the sum over its words in each language, and the number of letters, a word's start counted as one."""
        lists = [words_of(t) for t in texts]
        found = [list(map(self.known.get, words)) for words in lists]
        open_texts = [k for k, rows in enumerate(found) if None in rows]
        new = list(dict.fromkeys(w for k in open_texts for w, row in zip(lists[k], found[k], strict=True) if row is None))
        table = self.table
        if new:
            table = np.vstack([table, self.model.word_scores(new, self.lattice).astype(np.float32)])
            fresh = {w: len(self.table) + k for k, w in enumerate(new)}
            for k in open_texts:
                found[k] = [fresh[w] if row is None else row for w, row in zip(lists[k], found[k], strict=True)]
            if len(self.known) + len(new) <= _bounded(REMEMBERED, len(self.model.languages)):
                self.known.update(fresh)
                self.table = table
        out = np.zeros((len(texts), len(self.model.languages)))
        for k, rows in enumerate(found):
            if rows:
                out[k] = table[rows].sum(axis=0, dtype=np.float64)
        return out, np.array([sum(map(len, words)) + len(words) for words in lists], np.int64)


def predicted(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The likeliest language of each text, its share of the total likelihood, all languages weighed alike, and how far its log likelihood per letter is above the floor."""
    languages = scorer.model.languages
    if not languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    logs, n = scorer.texts(texts)
    best = logs.argmax(axis=1)
    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    names = [languages[b] if m else UNDETERMINED for b, m in zip(best, n, strict=True)]
    floors = scorer.model.floors[best] if scorer.model.floors is not None else 0.0
    return names, np.where(n > 0, share, 0.0), np.where(n > 0, logs.max(axis=1) / np.maximum(n, 1) - floors, 0.0)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Every row with ``lang_pred``, ``score``, 0 to 1, and ``likeness``.

    The score compares the learnt languages with each other. The likeness tells
    whether a text is like any of them: its log likelihood per letter, less the
    middle between the learnt words' and that of letters by chance. A text that is null or has no letter is ``und`` with score 0, as is every
    text when no language was learnt; of equal languages the first by name is
    taken. Only the text is read, whole and of any length; an empty table stays
    empty. Input columns with the new names are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, likeness double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for batch in batches:
            parts = [predicted(scorer, part["text"].tolist()) for part in slices([pd.DataFrame({"text": batch})], ("text",))]
            langs, scores, letters = zip(*parts, strict=True) if parts else ([], [np.empty(0)], [np.empty(0)])
            yield pd.DataFrame({"lang_pred": [x for names in langs for x in names], "score": np.concatenate(scores), "likeness": np.concatenate(letters)})

    own = [c for c in docs.columns if c not in ("lang_pred", "score", "likeness")]
    found = docs.select(*own, run(F.col("text").cast("string")).alias("_language"))
    return found.select(*own, "_language.lang_pred", "_language.score", "_language.likeness")
