"""Quality scores by a sparse ensemble of rules, compiled into Spark columns."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoweave.llm.common import hash_sample, held_out, sized_join
from phenoweave.llm.quality_rules import MEASURES, measured
from phenoweave.session import ship_package

#: Labelled documents, about, that the ensemble is fitted on.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LEAST_LEAF, THRESHOLDS = 24, 3, 20, 32
#: Weight of the lasso penalty and steps of its solver.
PENALTY, STEPS = 0.002, 400


def statistics(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows with statistics of their text as columns, and the names of these columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    counted = docs.select(
        "*",
        F.length(text).alias("_chars"),
        without("\\p{Lu}+").alias("_upper"),
        without("[!?.,;:]+").alias("_marks"),
        without("[0-9]+").alias("_digits"),
        F.size(F.array_distinct(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"))).alias("_distinct"),
    )
    rows = measured(counted)
    over = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    made = {
        "log_words": F.log1p("n_words"),
        "word_chars_mean": over("word_chars", "n_words"),
        "symbols": over("n_symbols", "n_words"),
        "stop_words": over("n_stop_words", "n_words") * F.sqrt("n_words"),
        "distinct_words": over("_distinct", "n_words") * F.log1p("n_words"),
        "distinct_share": over("_distinct", "n_words"),
        "repeats": over("n_repeat_words", "n_words"),
        "dup_lines": over("n_dup_lines", "n_lines"),
        "bullets": over("n_bullet_lines", "n_lines"),
        "ellipses": over("n_ellipsis_lines", "n_lines"),
        "words_a_line": over("n_words", "n_lines"),
        "upper": over("_upper", "_chars"),
        "marks": over("_marks", "n_words"),
        "digits": over("_digits", "_chars"),
    }
    own = [c for c in docs.columns if c not in made and c not in MEASURES]
    return rows.select(*own, *[value.cast("double").alias(name) for name, value in made.items()]), tuple(made)


@dataclass
class Ensemble:
    """Conjunctions of (statistic, below or not, threshold) with weights; the sum is the log-odds of label 1."""

    intercept: float
    rules: list[tuple[tuple[str, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, below, threshold in rule:
                holds = holds & ((F.col(name) <= threshold) if below else (F.col(name) > threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _split(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]) -> tuple | None:
    """The statistic and threshold that lower the squared error of the residuals most."""
    best, y = None, residual[rows]
    whole = y.sum() ** 2 / len(rows)
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        place = np.searchsorted(edges, x[rows, j], side="left")
        n = np.cumsum(np.bincount(place, minlength=len(edges) + 1))[:-1]
        s = np.cumsum(np.bincount(place, weights=y, minlength=len(edges) + 1))[:-1]
        fair = (n >= LEAST_LEAF) & (len(rows) - n >= LEAST_LEAF)
        if fair.any():
            gain = np.where(fair, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - whole, -1)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, float(edges[k]))
    return best


def _grow(x, residual, rows, cuts, depth, path, found) -> np.ndarray:
    """Predictions of a regression tree for ``rows``; every path below the root is added to ``found``."""
    best = _split(x, residual, rows, cuts) if depth else None
    if path:
        found.append(tuple(path))
    if best is None:
        return np.full(len(rows), residual[rows].mean())
    _, j, cut = best
    below = x[rows, j] <= cut
    out = np.empty(len(rows))
    for side in (True, False):
        part = below == side
        out[part] = _grow(x, residual, rows[part], cuts, depth - 1, [*path, (j, side, cut)], found)
    return out


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, below, cut in rule:
        out &= (x[:, j] <= cut) == below
    return out


def _lasso(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights under an absolute-value penalty, by accelerated proximal gradients; the intercept is free."""
    n, k = r.shape
    full = np.hstack([np.ones((n, 1), np.float32), r.astype(np.float32)])
    step = 4 * n / max(float(np.linalg.norm(full.T @ full, 2)), 1e-9)
    w = ahead = np.zeros(k + 1)
    momentum = 1.0
    for _ in range(STEPS):
        gradient = full.T @ (1 / (1 + np.exp(-np.clip(full @ ahead, -30, 30))) - y) / n
        moved = ahead - step * gradient
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * PENALTY, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = moved + (momentum - 1) / following * (moved - w)
        w, momentum = moved, following
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Ensemble:
    """Boosted shallow trees give the rules, the lasso their weights. Without both labels only the prior is left."""
    if len(y) == 0:
        return Ensemble(0.0)
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    if y.min() == y.max() or len(y) < 2 * LEAST_LEAF:
        return Ensemble(base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, THRESHOLDS + 2)[1:-1])) for j in range(x.shape[1])]
    found, odds, rng = [], np.full(len(y), base), np.random.default_rng(7)
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-odds))
        rows = np.sort(rng.choice(len(y), max(2 * LEAST_LEAF, len(y) // 2), replace=False))
        paths: list = []
        _grow(x, residual, rows, cuts, DEPTH, [], paths)
        found.extend(paths)
        leaves = [p for p in paths if not any(q[: len(p)] == p and len(q) > len(p) for q in paths)]
        for path in leaves:
            inside = _holds(x, path)
            if inside.any():
                odds[inside] += 1.5 * residual[inside].mean() / max(0.05, float(np.mean(np.abs(residual[inside]) * (1 - np.abs(residual[inside])))))
    rules = [rule for rule in dict.fromkeys(tuple(sorted(set(p))) for p in found)]
    matrix = np.stack([_holds(x, rule) for rule in rules], axis=1) if rules else np.empty((len(y), 0), bool)
    intercept, weights = _lasso(matrix, y)
    used = [k for k in range(len(rules)) if weights[k] != 0]
    return Ensemble(intercept, [tuple((names[j], below, cut) for j, below, cut in rules[k]) for k in used], [float(weights[k]) for k in used])


def learn(docs: DataFrame, labels: DataFrame, label: str, folds: int = 4, kept: int = 2, limit: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on about ``limit`` labelled documents outside the held-out fold.

    A null label counts as none; a document labelled more than once is a 1 if any label is.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out("doc_id", folds, kept)).groupBy("doc_id").agg(F.max(label).cast("double").alias("_label"))
    rows = sized_join(docs.select("doc_id", F.col("text").cast("string").alias("text")), hash_sample(known, "doc_id", limit), "doc_id", "inner")
    found, names = statistics(rows)
    ship_package(docs.sparkSession)

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            frame = pd.concat(parts).sort_values(["_order", *names])
            ensemble = fit(frame[list(names)].to_numpy(float), (frame["_label"].to_numpy(float) > 0).astype(float), names)
            yield pd.DataFrame({"model": [pickle.dumps(ensemble)]})

    # One task fits the sample, which is bounded; the driver gets the rules alone.
    sample = found.select("_label", *names, F.xxhash64("doc_id").alias("_order"))
    made = sample.repartition(1).mapInPandas(fitted, "model binary").first()
    return pickle.loads(made["model"]) if made else fit(np.empty((0, len(names))), np.empty(0), names)


def quality(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """The rows with ``quality_score``, 0 to 1, of label 1; a null text counts as empty, repeated rows stay.

    All columns are kept; one with the new name is replaced. The score is one
    expression over statistics, without user functions. Texts of any length are
    measured whole, an empty table stays empty.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    rows, _ = statistics(packed)
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "quality_score"]
    return rows.select(*own, ensemble.column().alias("quality_score"))
