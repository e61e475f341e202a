"""Non-negative factorization ``V = W H`` on distributed entries.

``W`` is ``(eid, w)`` and ``H`` is ``(featureName, h)`` with arrays of
``runs * k`` numbers. While a feature factor is small enough to be broadcast,
rounds run in :mod:`ensemble`; wider matrices are factorized by joins, where only
k x k Gram matrices and the error reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from phenoweave.functions.arrays import (
    argmax_first,
    dot_text,
    hashed_units,
    matrix_text,
    number_text,
    vector_text,
)
from phenoweave.functions.names import PERSON
from phenoweave.operators.matrix import (
    QUOTIENT_EPSILON,
    Matrix,
    column_products,
    feature_side,
    gram,
    held,
    local_products,
    row_products,
)
from phenoweave.operators.blocks import lay_out
from phenoweave.operators.ensemble import Ensemble, Rules, Setting, batches, factorize_all, widest
from phenoweave.operators.svd import truncated_svd
from phenoweave.session import cut_lineage, large_rows

# Fixed values of the stop rules.
ERROR_TOLERANCE = 1e-4
GRADIENT_SHARE = 1e-4
MAX_ITERATIONS = 200

Start = Callable[[str, int], Column]  # key column and width give the start array


@dataclass
class Factors:
    """Result of a factorization; ``errors[i][r]`` is half the squared error of
    run ``r`` after iteration ``i + 1``."""

    w: DataFrame
    h: DataFrame
    k: int
    runs: int = 1
    errors: list[list[float]] = field(default_factory=list)

    def run(self, index: int) -> Factors:
        """One run of several."""
        first = index * self.k + 1
        return Factors(
            self.w.select(PERSON, F.slice("w", first, self.k).alias("w")),
            self.h.select("featureName", F.slice("h", first, self.k).alias("h")),
            self.k,
            1,
            [[e[index]] for e in self.errors],
        )

    def best_run(self) -> int:
        """Index of the run with the least final error."""
        return int(np.argmin(self.errors[-1]))

    @property
    def half_squared_error(self) -> float:
        return self.errors[-1][0]

    @property
    def frobenius_error(self) -> float:
        return float(np.sqrt(max(0.0, 2 * self.errors[-1][0])))


# One row's update as SQL text, given the row `x`, its products with the other
# factor, and that factor's Gram matrix.


def _multiplicative(x: str, product: str, g: np.ndarray, l1: float, l2: float) -> str:
    """``x * product / (x G + penalties)``, entry by entry."""
    below = f"transform({matrix_text(g)}, row -> {dot_text(x, 'row')})"
    if l1 or l2:
        below = f"zip_with({below}, {x}, (d, a) -> d + {number_text(l1)} + {number_text(l2)} * a)"
    above = f"zip_with({x}, {product}, (a, p) -> a * p)"
    return f"zip_with({above}, {below}, (a, d) -> a / (d + {number_text(QUOTIENT_EPSILON)}))"


def _coordinate(x: str, product: str, g: np.ndarray, l1: float, l2: float) -> str:
    """Minimize over one coordinate after the other, the earlier ones already renewed."""
    penalized = np.asarray(g) + l2 * np.eye(len(g))
    steps = ", ".join(
        f"struct({t} AS t, {vector_text(row)} AS row, {number_text(row[t])} AS curve)"
        for t, row in enumerate(penalized)
    )
    slope = f"{dot_text('now', 'step.row')} - {product}[step.t] + {number_text(l1)}"
    renewed = f"greatest(0D, value - ({slope}) / step.curve)"
    return (
        f"aggregate(array({steps}), {x}, (now, step) -> transform(now, (value, i) -> "
        f"CASE WHEN i = step.t AND step.curve > 0 THEN {renewed} ELSE value END))"
    )


UPDATES = {"multiplicative": _multiplicative, "coordinate": _coordinate}


def _update(column: str, method: str, g: np.ndarray, k: int, runs: int, l1: float, l2: float) -> Column:
    parts = []
    for r in range(runs):
        inside = slice(r * k, (r + 1) * k)
        x, product = column, "s"
        if runs > 1:
            x, product = (f"slice({c}, {r * k + 1}, {k})" for c in (column, "s"))
        parts.append(UPDATES[method](x, product, g[inside, inside], l1, l2))
    return F.expr(f"concat({', '.join(parts)})" if runs > 1 else parts[0])


def _half_squared_errors(
    total: float, h: DataFrame, g_w: np.ndarray, g_h: np.ndarray, k: int, runs: int
) -> list[float]:
    """``½(ΣV² - 2 ΣH∘WᵀV + Σ(WᵀW)∘(HHᵀ))`` per run, from small sums only."""
    inner = h.selectExpr("array(" + ", ".join(f"sum(inner[{r}])" for r in range(runs)) + ") AS x").first()["x"]
    both = g_w * g_h
    out = []
    for r in range(runs):
        inside = slice(r * k, (r + 1) * k)
        out.append(float(0.5 * (total - 2 * inner[r] + both[inside, inside].sum())))
    return out


def _start_tables(m: Matrix, width: int, w_start: Start, h_start: Start, laid: bool = True) -> tuple[DataFrame, DataFrame]:
    """Start vectors of all persons and features; ``laid`` where joins go on from them, by person like the entries."""
    entries = m.entries if laid else m.kept
    persons = entries.select(PERSON).distinct()
    features = entries.select("featureName").distinct()
    return (
        persons.select(PERSON, w_start(PERSON, width).alias("w")),
        features.select("featureName", h_start("featureName", width).alias("h")),
    )


def factorize_held(
    m: Matrix,
    k: int,
    max_iter: int = MAX_ITERATIONS,
    tol: float = ERROR_TOLERANCE,
    runs: int = 1,
    seed: int = 0,
    w_start: Start | None = None,
    h_start: Start | None = None,
    initial: tuple[DataFrame, DataFrame] | None = None,
    method: str = "multiplicative",
    l1: float = 0.0,
    l2: float = 0.0,
    relative_stop: float | None = None,
) -> Factors:
    """Alternate the two half-steps until the error is at most ``tol``.

    ``relative_stop`` also ends a run once the projected gradient that a round of
    coordinate descent meets, summed over both factors, is at most that share of
    the first round's.
    """
    in_blocks = local_products(m, runs * k)
    start = initial or _start_tables(
        m, runs * k, w_start or partial(hashed_units, 2 * seed), h_start or partial(hashed_units, 2 * seed + 1), not in_blocks
    )
    if not in_blocks:
        return joined_rounds(m, k, start, max_iter, tol, runs, method, l1, l2, relative_stop)
    settings = [Setting(k, l1, l2, first=r * k) for r in range(runs)]
    done = factorize_all(m, settings, Rules(method, max_iter, tol, relative_stop), start, columns=runs * k)
    return factors_of(done, list(range(runs)))


def factors_of(e: Ensemble, settings: list[int]) -> Factors:
    """Settings of one group as runs of one result; an earlier end keeps its last error."""
    rounds = max(len(e.errors[i]) for i in settings)
    with large_rows(e.state.sparkSession):
        w = cut_lineage(e.person_factor(settings))
    return Factors(
        w,
        e.feature_factor(settings),
        e.settings[settings[0]].k,
        len(settings),
        [[e.errors[i][min(n, len(e.errors[i]) - 1)] for i in settings] for n in range(rounds)],
    )


def joined_rounds(
    m: Matrix,
    k: int,
    start: tuple[DataFrame, DataFrame],
    max_iter: int,
    tol: float,
    runs: int = 1,
    method: str = "multiplicative",
    l1: float = 0.0,
    l2: float = 0.0,
    relative_stop: float | None = None,
) -> Factors:
    """The rounds as joins and sums, for any number of features.

    Each half-step is one job over the held entries; its result is checkpointed,
    so plans stay short and a lost executor costs no more than the running job.
    ``relative_stop`` here ends the loop once an iteration lowers the error by
    less than that share of the first error.
    """
    width = runs * k
    w, h = start
    local = local_products(m, width)
    w, h = cut_lineage(w, keep_layout=local), cut_lineage(h)
    g_h = gram(h, "h", width, k)
    errors: list[list[float]] = []
    for _ in range(max_iter):
        products = row_products(m, h, width)
        w = cut_lineage(
            products.join(w.hint("merge"), PERSON).select(
                PERSON, _update("w", method, g_h, k, runs, l1, l2).alias("w")
            ),
            keep_layout=local,
        )
        g_w = gram(w, "w", width, k)
        renewed = (
            column_products(m, w, width)
            .join(feature_side(h, m.features, width), "featureName")
            .select("featureName", "s", _update("h", method, g_w, k, runs, l1, l2).alias("h"))
        )
        inner = F.expr(
            "array("
            + ", ".join(
                dot_text(f"slice(h, {r * k + 1}, {k})", f"slice(s, {r * k + 1}, {k})") for r in range(runs)
            )
            + ")"
        )
        h = cut_lineage(renewed.select("featureName", "h", inner.alias("inner")))
        g_h = gram(h, "h", width, k)
        errors.append(_half_squared_errors(m.squares, h, g_w, g_h, k, runs))
        if max(errors[-1]) <= tol:
            break
        if relative_stop is not None and len(errors) > 1:
            gains = [a - b for a, b in zip(errors[-2], errors[-1])]
            if all(gain <= relative_stop * first for gain, first in zip(gains, errors[0])):
                break
    return Factors(w, h.select("featureName", "h"), k, runs, errors)


def factorize(entries: DataFrame, k: int, **options) -> Factors:
    """Factorize the absolute values of the entries; options as :func:`factorize_held`."""
    with held(entries.withColumn("value", F.abs("value"))) as m:
        return factorize_held(m, k, **options)


def svd_start(m: Matrix, k: int, fill: bool = False) -> tuple[DataFrame, DataFrame]:
    """Start from the leading singular vectors, each cut to its stronger sign part.

    ``fill`` replaces zeros by the matrix mean, as multiplicative updates need.
    """
    w, h, _ = _svd_start(m, k)
    if fill:
        persons = w.count()
        mean = (m.entries.agg(F.sum("value")).first()[0] or 0.0) / (persons * m.features)
        filled = lambda x: F.when(x > 0, x).otherwise(F.lit(float(mean)))
        w = w.withColumn("w", F.transform("w", filled))
        h = h.withColumn("h", F.transform("h", filled))
    return w, h


def _svd_start(m: Matrix, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`svd_start`, and what the entries are multiplied with to give its person side before that is cut at 0."""
    svd = truncated_svd(m, k)
    u, v = svd.scores, svd.right  # scores = U * S

    def norms(df, column):
        x = F.col(column)
        parts = []
        for t in range(k):
            parts += [
                F.sqrt(F.sum(F.pow(F.greatest(x[t], F.lit(0.0)), F.lit(2.0)))),
                F.sqrt(F.sum(F.pow(F.least(x[t], F.lit(0.0)), F.lit(2.0)))),
            ]
        return np.array(df.agg(F.array(*parts).alias("n")).first()["n"]).reshape(k, 2)

    u_norms, v_norms = norms(u, "s"), norms(v, "v")
    w_parts, h_parts, scales = [], [], []
    for t in range(k):
        sigma = svd.singular[t]
        if sigma <= 0:
            w_parts.append(F.lit(0.0))
            h_parts.append(F.lit(0.0))
            scales.append(0.0)
            continue
        # scores carry sigma, so a part's product of norms already is sigma times the unit one
        strength = u_norms[t] * v_norms[t]
        side = 0 if strength[0] >= strength[1] else 1
        sign = 1.0 if side == 0 else -1.0
        if t == 0:  # the leading pair has one sign
            scale_w, scale_h = 1 / np.sqrt(sigma), np.sqrt(sigma)
            w_parts.append(F.abs(F.col("s")[t]) * F.lit(float(scale_w)))
            h_parts.append(F.abs(F.col("v")[t]) * F.lit(float(scale_h)))
            scales.append(scale_w)
            continue
        root = np.sqrt(strength[side])
        scale_w = sign * root / u_norms[t][side] if u_norms[t][side] else 0.0
        scale_h = sign * root / v_norms[t][side] if v_norms[t][side] else 0.0
        w_parts.append(F.greatest(F.lit(0.0), F.col("s")[t] * F.lit(float(scale_w))))
        h_parts.append(F.greatest(F.lit(0.0), F.col("v")[t] * F.lit(float(scale_h))))
        scales.append(scale_w)
    w = u.select(PERSON, F.array(*w_parts).alias("w"))
    h = v.select("featureName", F.array(*h_parts).alias("h"))
    return w, h, v.select("featureName", F.array(*[F.col("v")[t] * F.lit(float(x)) for t, x in enumerate(scales)]).alias("q"))


def regularized_held(
    m: Matrix,
    k: int,
    alpha: float = 0.0,
    l1_ratio: float = 0.0,
    max_iter: int = MAX_ITERATIONS,
    relative_stop: float | None = GRADIENT_SHARE,
) -> Factors:
    """Penalized factorization by coordinate descent from an SVD-based start.

    Minimizes half the squared error plus ``alpha * l1_ratio`` times the entry
    sums plus half of ``alpha * (1 - l1_ratio)`` times the entry squares of
    both factors. It ends after ``max_iter`` rounds or when the projected
    gradient has fallen to ``relative_stop`` of the first round's. Nothing in it is random.
    """
    return factorize_held(
        m,
        k,
        max_iter=max_iter,
        initial=svd_start(m, k),
        method="coordinate",
        l1=alpha * l1_ratio,
        l2=alpha * (1 - l1_ratio),
        relative_stop=relative_stop,
    )


def regularized_all(
    m: Matrix,
    settings: list[tuple[int, float, float]],
    max_iter: int = MAX_ITERATIONS,
    relative_stop: float | None = GRADIENT_SHARE,
) -> list[tuple[Ensemble, list[int]]]:
    """:func:`regularized_held` for many ``(k, alpha, l1_ratio)`` at once, from one SVD.

    The start of a smaller k is the leading part of the start of the largest. One
    ensemble for as many settings as can be broadcast together, each with the
    positions of its settings in the list.
    """
    start = tuple(map(cut_lineage, _svd_start(m, max(k for k, _, _ in settings))))
    wanted = [Setting(k, alpha * ratio, alpha * (1 - ratio)) for k, alpha, ratio in settings]
    rules, out, left = Rules("coordinate", max_iter, 0.0, relative_stop), [], list(range(len(wanted)))
    blocks = lay_out(m, widest(wanted))
    for batch in batches(wanted, m.features):
        places = []
        for setting in batch:  # equal settings are different rows of the result
            places.append(next(i for i in left if wanted[i] == setting))
            left.remove(places[-1])
        out.append((factorize_all(m, batch, rules, start, blocks), places))
    return out


def factorize_regularized(entries: DataFrame, k: int, **options) -> Factors:
    with held(entries) as m:
        return regularized_held(m, k, **options)


def assign(factors: Factors, persons: DataFrame | None = None) -> DataFrame:
    """Each person's strongest component, the first one on ties.

    With ``persons`` every one of them is labelled: who has no entry, and so no
    weight in any component, takes the first.
    """
    found = factors.w.select(PERSON, argmax_first(F.col("w")).alias("label"))
    if persons is None:
        return found
    joined = persons.select(PERSON).distinct().join(found, PERSON, "left")
    return joined.select(PERSON, F.coalesce("label", F.lit(0)).cast(found.schema["label"].dataType).alias("label"))


def spread(df: DataFrame, column: str, k: int) -> DataFrame:
    """Array column as ``k`` numbered columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.col(column)[t].alias(f"{column}{t}") for t in range(k)])


def component_weights(factors: Factors) -> DataFrame:
    """``H`` in long form: ``label, featureName, weight``; the label is the component's index."""
    return factors.h.select("featureName", F.posexplode("h").alias("label", "weight")).select(
        "label", "featureName", "weight"
    )


def error_curve(entries: DataFrame, k: int, iterations: list[int] | None = None, **options) -> DataFrame:
    """``iteration, error`` (Frobenius norm) at the given iteration counts of one run."""
    wanted = iterations or list(range(10, 300, 10))
    factors = factorize_regularized(entries, k, max_iter=max(wanted), relative_stop=None, **options)
    last = len(factors.errors)
    rows = [
        (i, float(np.sqrt(max(0.0, 2 * factors.errors[min(i, last) - 1][0])))) for i in wanted
    ]
    return entries.sparkSession.createDataFrame(rows, "iteration int, error double")
