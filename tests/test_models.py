from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoweave.functions.arrays import hashed_units
from phenoweave.operators import blocks, clusters, ensemble, features, matrix, nmf, quality, stability, svd, sweeps

ENTRY = "eid string, featureName string, value double"


def to_entries(spark, a, keep_zeros=False):
    return spark.createDataFrame(
        [(f"p{i:03d}", f"f{j:02d}", float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])
         if keep_zeros or a[i, j]],
        ENTRY,
    )


def dense(df, key, column):
    return np.array([r[column] for r in df.orderBy(key).collect()])


@pytest.fixture(scope="module")
def random():
    rng = np.random.default_rng(5)
    a = rng.random((40, 9)) * (rng.random((40, 9)) < 0.6)
    a[:, 0] += 0.1
    return a


def test_products(spark, random):
    m = matrix.hold(to_entries(spark, random))
    h = np.arange(18.0).reshape(9, 2)
    hf = spark.createDataFrame([(f"f{j:02d}", h[j].tolist()) for j in range(9)], "featureName string, h array<double>")
    assert np.allclose(dense(matrix.row_products(m, hf, 2), "eid", "s"), random @ h)
    w = np.linspace(0, 1, 80).reshape(40, 2)
    wf = spark.createDataFrame([(f"p{i:03d}", w[i].tolist()) for i in range(40)], "eid string, w array<double>")
    assert np.allclose(dense(matrix.column_products(m, wf, 2), "featureName", "s"), random.T @ w)
    assert np.allclose(matrix.gram(wf, "w", 2), w.T @ w)
    m.release()


def test_elementwise_and_transpose(spark, rows):
    a = spark.createDataFrame([(0, 1, 6.0)], "row int, col int, value double")
    b = spark.createDataFrame([(0, 1, 3.0), (1, 1, 4.0)], "row int, col int, value double")
    assert rows(matrix.elementwise(a, b, "product")) == [(0, 1, 18.0)]
    assert rows(matrix.elementwise(a, b, "quotient")) == [(0, 1, 2.0)]
    assert rows(matrix.transpose_entries(a)) == [(1, 0, 6.0)]
    assert rows(matrix.multiply_entries(a, b)) == [(0, 1, 24.0)]
    with pytest.raises(ValueError):
        matrix.elementwise(a, b, "sum")


def numpy_rounds(v, w, h, rounds, method, l1, l2):
    """Dense counterpart of both update rules."""
    for _ in range(rounds):
        for side in range(2):
            x, y, t = (w, h.T, v) if side == 0 else (h.T, w, v.T)
            product, g = t @ y, y.T @ y
            if method == "multiplicative":
                x[:] = x * product / (x @ g + l1 + l2 * x + 2e-15)
            else:
                g = g + l2 * np.eye(len(g))
                for c in range(x.shape[1]):
                    if g[c, c] > 0:
                        x[:, c] = np.maximum(0, x[:, c] - (x @ g[:, c] - product[:, c] + l1) / g[c, c])
    return w, h


@pytest.mark.parametrize("method,l1,l2", [("multiplicative", 0, 0), ("multiplicative", 0.2, 0.1), ("coordinate", 0.1, 0.2)])
def test_updates_match_dense_algebra(spark, random, method, l1, l2):
    k, runs = 3, 2
    start_w = np.linspace(0.1, 1, 40 * 6).reshape(40, 6)
    start_h = np.linspace(1, 0.2, 9 * 6).reshape(9, 6)
    initial = (
        spark.createDataFrame([(f"p{i:03d}", start_w[i].tolist()) for i in range(40)], "eid string, w array<double>"),
        spark.createDataFrame([(f"f{j:02d}", start_h[j].tolist()) for j in range(9)], "featureName string, h array<double>"),
    )
    out = nmf.factorize(to_entries(spark, random), k, max_iter=3, runs=runs, initial=initial, method=method, l1=l1, l2=l2)
    for r in range(runs):
        part = slice(r * k, (r + 1) * k)
        w, h = numpy_rounds(random, start_w[:, part].copy(), start_h[:, part].T.copy(), 3, method, l1, l2)
        mine = out.run(r)
        assert np.allclose(dense(mine.w, "eid", "w"), w)
        assert np.allclose(dense(mine.h, "featureName", "h").T, h)
        assert np.isclose(mine.half_squared_error, 0.5 * ((random - w @ h) ** 2).sum())


def test_iterations_do_not_shuffle_entries_or_person_factor(spark, random):
    """Both stay where they are; only sums per feature move."""
    m = matrix.hold(to_entries(spark, random))
    start = nmf._start_tables(m, 2, partial(hashed_units, 0), partial(hashed_units, 1))
    out = nmf.joined_rounds(m, 2, start, 2, 0.0)
    layout = out.w._jdf.queryExecution().executedPlan().outputPartitioning().toString()
    assert layout.startswith("hashpartitioning(eid")
    step = matrix.column_products(m, out.w, 2)._jdf.queryExecution().executedPlan().toString()
    outside = "\n".join(line for line in step.splitlines() if "REPARTITION_BY_NUM" not in line)
    assert "hashpartitioning(eid" not in outside and "SortMergeJoin" in outside
    assert outside.count("Exchange") == 1
    m.release()


def test_rank_one_and_iteration_limit(spark):
    a = np.outer(np.arange(1, 9.0), np.array([1.0, 2.0, 0.0, 4.0]))
    out = nmf.factorize(to_entries(spark, a, keep_zeros=True), 1, max_iter=4, tol=1e-6)
    errors = [e[0] for e in out.errors]
    assert errors[-1] < 1e-6 and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    h = {r["featureName"]: r["h"][0] for r in out.h.collect()}
    assert h["f02"] == 0.0
    assert len(nmf.factorize(to_entries(spark, np.eye(4) + 0.5), 2, max_iter=2).errors) == 2


def test_start_does_not_depend_on_partitions(spark, random):
    entries = to_entries(spark, random)
    one = nmf.factorize(entries.repartition(1), 2, max_iter=2, seed=3)
    many = nmf.factorize(entries.repartition(7), 2, max_iter=2, seed=3)
    assert np.allclose(dense(one.w, "eid", "w"), dense(many.w, "eid", "w"), atol=1e-9)


def test_argmax_takes_the_first_of_equals(spark, rows):
    w = spark.createDataFrame([("a", [0.5, 0.5, 0.1])], "eid string, w array<double>")
    assert rows(nmf.assign(nmf.Factors(w, w, 3))) == [("a", 0)]


def test_svd_and_pca(spark, random):
    entries = to_entries(spark, random)
    u, s, vt = np.linalg.svd(random, full_matrices=False)
    m = matrix.hold(entries)
    out = svd.truncated_svd(m, 3)
    assert np.allclose(out.singular, s[:3])
    sign = np.sign([row[np.argmax(np.abs(row))] for row in vt[:3]])
    assert np.allclose(dense(out.right, "featureName", "v"), (vt[:3].T * sign), atol=1e-6)
    assert np.allclose(dense(out.scores, "eid", "s"), u[:, :3] * s[:3] * sign, atol=1e-6)
    m.release()
    labels = entries.select("eid").distinct().withColumn("label", F.lit(0))
    plane = svd.pca_entries(entries, labels).orderBy("eid").collect()
    _, _, axes = np.linalg.svd(random - random.mean(0), full_matrices=False)
    expected = np.abs(random @ axes[:2].T)
    assert np.allclose(np.abs([[r["x"], r["y"]] for r in plane]), expected, atol=1e-5)
    by_ml = clusters.pca_project(features.to_vectors(entries), labels).orderBy("eid").collect()
    assert np.allclose(np.abs([[r["x"], r["y"]] for r in by_ml]), expected, atol=1e-6)


def test_persons_without_entries_keep_their_rows(spark):
    entries = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 1.5), ("c", "f", 9.0)], "eid string, featureName string, value double")
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("z", 0)], "eid string, label int")
    x, own = {"a": 1.0, "b": 1.5, "c": 9.0, "z": 0.0}, {"a": 0, "b": 0, "c": 1, "z": 0}

    def silhouette(p, distance):
        mean = {g: [distance(x[p], x[q]) for q in x if own[q] == g and q != p] for g in (0, 1)}
        if not mean[own[p]]:
            return 0.0
        a, b = np.mean(mean[own[p]]), np.mean(mean[1 - own[p]])
        return (b - a) / max(a, b)

    for metric, distance in (("euclidean", lambda a, b: abs(a - b)), ("sqeuclidean", lambda a, b: (a - b) ** 2)):
        got = {r.eid: r.silhouette for r in quality.silhouette_persons(entries, labels, metric).collect()}
        assert got == pytest.approx({p: silhouette(p, distance) for p in x})
    assert quality.silhouette_self_inclusive(entries, labels).count() == 4
    assert quality.silhouette_persons(entries, labels, "cosine").count() == 3
    plane = {r.eid: (r.x, r.y) for r in svd.pca_entries(entries, labels).collect()}
    assert plane["z"] == (0.0, 0.0) and len(plane) == 4


def nndsvd(a, k):
    """The published start from singular vectors, densely."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    w, h = np.zeros((a.shape[0], k)), np.zeros((k, a.shape[1]))
    w[:, 0], h[0] = np.sqrt(s[0]) * abs(u[:, 0]), np.sqrt(s[0]) * abs(vt[0])
    for t in range(1, k):
        best = None
        for sign in (1, -1):
            x, y = np.maximum(sign * u[:, t], 0), np.maximum(sign * vt[t], 0)
            weight = np.linalg.norm(x) * np.linalg.norm(y)
            if best is None or weight > best[0]:
                best = (weight, x / np.linalg.norm(x), y / np.linalg.norm(y))
        w[:, t], h[t] = (np.sqrt(s[t] * best[0]) * x for x in best[1:])
    return w, h


def test_regularized_matches_dense_reference(spark, random):
    out = nmf.factorize_regularized(to_entries(spark, random), 3, alpha=0.1, l1_ratio=0.5, max_iter=4, relative_stop=None)
    w, h = numpy_rounds(random, *nndsvd(random, 3), 4, "coordinate", 0.05, 0.05)
    assert np.allclose(dense(out.w, "eid", "w"), w, atol=1e-5)
    assert np.allclose(dense(out.h, "featureName", "h").T, h, atol=1e-5)


def test_error_curve_falls(spark, random):
    curve = [r["error"] for r in nmf.error_curve(to_entries(spark, random), 3, [1, 2, 4]).orderBy("iteration").collect()]
    assert curve == sorted(curve, reverse=True)


def test_weights_keep_names_after_selection(spark, rows):
    entries = spark.createDataFrame([("a", "f1", 1.0), ("a", "f3", 2.0), ("b", "f3", 1.0)], ENTRY)
    out = nmf.factorize(entries, 1, max_iter=2)
    assert rows(nmf.component_weights(out), "label", "featureName") == [(0, "f1"), (0, "f3")]


def points(spark, values, labels):
    """Persons on a line, with a constant second coordinate so that none is zero."""
    entries = spark.createDataFrame(
        [(f"p{i}", f, v) for i, x in enumerate(values) for f, v in (("x", float(x)), ("y", 1.0)) if v], ENTRY
    )
    return entries, spark.createDataFrame([(f"p{i}", c) for i, c in enumerate(labels)], "eid string, label int")


@pytest.mark.parametrize("second", [1, 2])
def test_self_inclusive_silhouette(spark, second):
    out = {r["eid"]: r for r in quality.silhouette_self_inclusive(
        *points(spark, [0, 2, 10, 12], [0, 0, second, second])).collect()}
    assert (out["p0"]["a"], out["p0"]["b"]) == pytest.approx((2, 122))
    assert (out["p1"]["a"], out["p1"]["b"]) == pytest.approx((2, 82))
    assert sum(r["score"] for r in out.values()) / 4 == pytest.approx(0.9796, abs=5e-5)


def brute(a, labels, metric):
    if metric == "cosine":
        unit = a / np.linalg.norm(a, axis=1, keepdims=True)
        d = 1 - unit @ unit.T
    else:
        d = ((a[:, None] - a[None]) ** 2).sum(-1)
        d = np.sqrt(d) if metric == "euclidean" else d
    out = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(labels)) != i)
        if not same.any():
            out.append(0.0)
            continue
        b = min(d[i, labels == c].mean() for c in set(labels) - {own})
        x = d[i, same].mean()
        out.append((b - x) / max(x, b))
    return out


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean", "euclidean"])
def test_standard_silhouette(spark, random, metric, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_ROWS", 7)
    labels = np.arange(40) % 3
    labels[0] = 9  # a cluster of one
    frame = spark.createDataFrame([(f"p{i:03d}", int(c)) for i, c in enumerate(labels)], "eid string, label int")
    out = quality.silhouette_persons(to_entries(spark, random), frame, metric).orderBy("eid").collect()
    assert np.allclose([r["silhouette"] for r in out], brute(random, labels, metric))
    assert [r["label"] for r in out] == labels.tolist()


def test_euclidean_silhouette_meets_whole_blocks(spark, random, monkeypatch):
    """Persons without entries, without label and of several blocks; nobody travels once per block."""
    monkeypatch.setattr(quality, "BLOCK_ROWS", 7)
    monkeypatch.setattr(quality, "TILE", (3, 4))
    a = random.copy()
    a[5] = 0
    labels = np.arange(40) % 3
    named = [(f"p{i:03d}", None if i == 8 else int(c)) for i, c in enumerate(labels)]
    frame = spark.createDataFrame(named, "eid string, label int")
    out = {r["eid"]: r["silhouette"] for r in quality.silhouette_persons(to_entries(spark, a), frame, "euclidean").collect()}
    kept = np.arange(40) != 8
    expected = brute(a[kept], labels[kept], "euclidean")
    assert out.pop("p008") is None and np.allclose([out[p] for p in sorted(out)], expected)
    monkeypatch.setattr(quality, "DENSE_FEATURES", 2)
    rows_ = {r["eid"]: r["silhouette"] for r in quality.silhouette_persons(to_entries(spark, a), frame, "euclidean").collect()}
    assert rows_.pop("p008") is None and np.allclose([rows_[p] for p in sorted(out)], [out[p] for p in sorted(out)])

    def refused(*_):
        raise AssertionError("every row sent to every block")

    monkeypatch.setattr(quality, "DENSE_FEATURES", 2048)
    monkeypatch.setattr(quality, "_between_rows", refused)
    assert quality.silhouette_persons(to_entries(spark, a), frame, "euclidean").count() == 40


@pytest.mark.parametrize("persons", [4096, 9])
def test_estimated_silhouette(spark, random, monkeypatch, persons):
    """Exact where clusters are taken whole; from samples the errors tell how far scores are off; nobody is left out."""
    monkeypatch.setattr(blocks, "BLOCK_PERSONS", persons)
    monkeypatch.setattr(blocks, "WIDER", 1)
    a = np.vstack([random, random[::-1] + 0.3])
    a[7] = 0
    labels = np.arange(80) % 3
    labels[0] = 9
    frame = spark.createDataFrame([(f"p{i:03d}", int(c)) for i, c in enumerate(labels)], "eid string, label int")
    exact = brute(a, labels, "euclidean")
    out = quality.silhouette_estimated(to_entries(spark, a), frame).orderBy("eid").collect()
    assert np.allclose([r["silhouette"] for r in out], exact) and max(r["error"] for r in out) == 0
    part = quality.silhouette_estimated(to_entries(spark, a), frame, per_cluster=12).orderBy("eid").collect()
    assert [r["label"] for r in part] == labels.tolist()
    off = np.array([r["silhouette"] for r in part]) - exact
    errors = np.array([r["error"] for r in part])
    assert off.any() and np.mean(np.abs(off) <= 2.5 * errors + 1e-12) > 0.85 and errors.max() < 0.3
    one = quality.silhouette_estimated(to_entries(spark, a), frame.withColumn("label", F.lit(1))).collect()
    assert len(one) == 80 and all(r["silhouette"] is None for r in one)


def test_cosine_score(spark, random):
    labels = np.arange(40) % 3
    frame = spark.createDataFrame([(f"p{i:03d}", int(c)) for i, c in enumerate(labels)], "eid string, label int")
    unit = random / np.linalg.norm(random, axis=1, keepdims=True)
    cosine = unit @ unit.T
    a = np.array([cosine[i, labels == c].mean() for i, c in enumerate(labels)])
    b = np.array([np.mean([cosine[i, labels == o].mean() for o in set(labels) - {c}]) for i, c in enumerate(labels)])
    out = quality.cosine_persons(to_entries(spark, random), frame).orderBy("eid").collect()
    assert np.allclose([r["score"] for r in out], (a - b) / np.maximum(a, b))


def test_sample_keeps_labels(spark, random):
    labels = spark.createDataFrame([(f"p{i:03d}", i) for i in range(40)], "eid string, label int")
    out = quality.silhouette_persons(to_entries(spark, random), labels, "euclidean", sample=11).collect()
    assert len(out) == 11 and all(int(r["eid"][1:]) == r["label"] for r in out)


def test_dissimilarity(spark, random):
    w = spark.createDataFrame([(f"p{i}", random[i, :3].tolist()) for i in range(40)], "eid string, w array<double>")
    swapped = w.select("eid", F.reverse("w").alias("w"))
    for other in (w, swapped):
        assert stability.dissimilarity(w, other, 3).first()[0] == pytest.approx(0, abs=1e-9)
    noise = spark.createDataFrame([(f"p{i}", random[i, 3:6].tolist()) for i in range(40)], "eid string, w array<double>")
    c = np.corrcoef(random[:, :3].T, random[:, 3:6].T)[:3, 3:]
    expected = abs(6 - c.max(0).sum() - c.max(1).sum()) / 3
    assert stability.dissimilarity(w, noise, 3).first()[0] == pytest.approx(expected)
    assert stability.dissimilarity(w, noise, 3, halved=True).first()[0] == pytest.approx(expected / 2)


@pytest.mark.parametrize("persons", [4096, 11])
def test_stability_equals_dense_runs(spark, random, monkeypatch, persons):
    """Every run, its errors, all pairs of runs and the pick, against plain numpy; in one block and in several."""
    monkeypatch.setattr(blocks, "BLOCK_PERSONS", persons)
    monkeypatch.setattr(blocks, "WIDER", 1)
    monkeypatch.setattr(blocks, "FAN", 2)
    monkeypatch.setattr(ensemble, "GROUP_COLUMNS", 4)
    names, features_ = [f"p{i:03d}" for i in range(40)], [f"f{j:02d}" for j in range(9)]
    found, expected, least = {}, {}, {}
    with matrix.held(to_entries(spark, random)) as m:
        done = stability.repeated_runs(m, (2, 3), runs=3, max_iter=5)
        for k in (2, 3):
            runs = []
            for r in range(3):
                setting = [ensemble.Setting(k, seed=r)]
                w, h = ensemble.drawn(names, setting, 0)[0], ensemble.drawn(features_, setting, 1)[0]
                runs.append(numpy_rounds(random, w, h.T.copy(), 5, "multiplicative", 0, 0))
            c = [[np.corrcoef(a[0].T, b[0].T)[:k, k:] for b in runs] for a in runs]
            expected[k] = sum(abs(2 * k - x.max(0).sum() - x.max(1).sum()) / k for row in c for x in row)
            least[k] = min(runs, key=lambda r: ((random - r[0] @ r[1]) ** 2).sum())
        totals = stability.total_dissimilarity(done)
        assert totals == pytest.approx(expected, abs=1e-7)
        assert stability.total_dissimilarity(done, halved=True) == pytest.approx({k: v / 2 for k, v in expected.items()}, abs=1e-7)
        for k in (2, 3):
            best = stability.best_factors(done, k)
            assert np.allclose(dense(best.w, "eid", "w"), least[k][0]) and np.allclose(dense(best.h, "featureName", "h").T, least[k][1])
            assert np.isclose(best.half_squared_error, 0.5 * ((random - least[k][0] @ least[k][1]) ** 2).sum())
    table = {r["k"]: r["dissimilarity"] for r in stability.stability_table(to_entries(spark, random), (2, 3), runs=3, max_iter=5).collect()}
    assert table == pytest.approx(expected, abs=1e-7)


def settled_rounds(v, k, alpha, ratio, share, most=200):
    """Dense coordinate descent that ends by its projected gradient."""
    w, h = nndsvd(v, k)
    l1, l2, first = alpha * ratio, alpha * (1 - ratio), None
    for n in range(1, most + 1):
        size = 0.0
        for x, y, t in ((w, h.T, v), (h.T, w, v.T)):
            product, g = t @ y, y.T @ y + l2 * np.eye(k)
            for c in range(k):
                slope = x @ g[:, c] - product[:, c] + l1
                size += np.abs(np.where(x[:, c] > 0, slope, np.minimum(slope, 0))).sum()
                if g[c, c] > 0:
                    x[:, c] = np.maximum(0, x[:, c] - slope / g[c, c])
        first = first or size
        if size <= share * first:
            break
    return w, h, n


@pytest.mark.parametrize("persons, share", [(4096, 1e-3), (11, 0.1)])
def test_settings_equal_dense_descent(spark, random, monkeypatch, persons, share):
    """Rounds and factors of many settings in one run, against one dense descent each; in one block and in several."""
    monkeypatch.setattr(blocks, "BLOCK_PERSONS", persons)
    monkeypatch.setattr(blocks, "WIDER", 1)
    entries = to_entries(spark, random)
    settings = [(k, a, r) for k in (2, 4) for a in (0.0, 0.3) for r in (0.0, 1.0)]
    with matrix.held(entries) as m:
        rounds = []
        for e, places in nmf.regularized_all(m, settings, relative_stop=share):
            for i, place in enumerate(places):
                w, h, n = settled_rounds(random, *settings[place], share)
                mine = nmf.factors_of(e, [i])
                assert len(e.errors[i]) == n
                assert np.allclose(dense(mine.w, "eid", "w"), w, atol=1e-7) and np.allclose(e.weights(i).T, h, atol=1e-7)
                rounds.append(n)
        assert len(set(rounds)) > 2 and max(rounds) < 200


def test_searches_equal_dense_descent(spark, random):
    """Grid figures, silhouettes and chart rows of the default searches, against one dense descent per setting."""
    entries = to_entries(spark, random)
    grid = sweeps.grid_search(entries, (2, 4), (0.0, 0.3), (0.0, 1.0), threshold=0.5, relative_stop=1e-3).collect()
    for r in grid:
        w, h, _ = settled_rounds(random, r["k"], r["alpha"], r["l1_ratio"], 1e-3)
        assert (r["num_labels"], r["avg_nonzero_feature_count"]) == (len(set(w.argmax(1))), (h > 0.5).sum(1).mean())
    curve = {r["k"]: r["silhouette_avg"] for r in sweeps.silhouette_by_k(entries, (2, 4, 5)).collect()}
    charts = sweeps.silhouette_charts(entries, (2, 4, 5)).collect()
    assert len(charts) == 120
    for k in (2, 4, 5):
        labels = settled_rounds(random, k, 0.0, 0.0, 1e-4)[0].argmax(1)
        scores = brute(random, labels, "cosine")
        assert curve[k] == pytest.approx(np.mean(scores))
        own = sorted((r for r in charts if r["k"] == k), key=lambda r: r["eid"])
        assert [r["label"] for r in own] == labels.tolist() and np.allclose([r["silhouette"] for r in own], scores)
        heights = sorted((label, s, r["eid"], r["y"]) for label, s, r in zip(labels, [r["silhouette"] for r in own], own, strict=True))
        gaps = {c: (i + 1) * sweeps.CHART_GAP for i, c in enumerate(sorted(set(labels)))}
        assert [y for *_, y in heights] == [n + gaps[c] for n, (c, *_) in enumerate(heights)]
    assert sweeps.optimal_k(entries, (2, 4, 5)).first()["k"] == max(curve, key=curve.get)


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean"])
def test_scores_of_many_labellings_equal_single_ones(spark, random, metric):
    a = random.copy()
    a[3] = 0
    entries = to_entries(spark, a, keep_zeros=True)
    with matrix.held(entries) as m:
        for e, _ in nmf.regularized_all(m, [(1, 0.0, 0.0), (3, 0.0, 0.0)], max_iter=3):
            table = ensemble.silhouettes(e, metric)
            for i in range(2):
                labels = nmf.assign(nmf.factors_of(e, [i]))
                single = {r["eid"]: r["silhouette"] for r in quality.silhouette_persons(m, labels, metric).collect()}
                mine = {r["eid"]: r["silhouette"] for r in table.where(F.col("setting") == i).collect()}
                assert mine.keys() == single.keys()
                assert all(v is None if single[p] is None else abs(v - single[p]) < 1e-9 for p, v in mine.items())


@pytest.mark.parametrize("cells, share", [(1 << 18, 8), (0, 0)])
def test_products_of_a_block(random, monkeypatch, cells, share):
    monkeypatch.setattr(blocks, "DENSE_CELLS", cells)
    monkeypatch.setattr(blocks, "DENSE_SHARE", share)
    monkeypatch.setattr(blocks, "SPARSE_CELLS", 300)
    at = [np.flatnonzero(row) for row in random]
    rows_ = blocks.Rows(np.cumsum([0] + [len(x) for x in at]), np.concatenate(at), random[random != 0], 9)
    assert (rows_.dense is None) == (cells == 0)
    right, left = np.arange(45.0).reshape(9, 5), np.arange(120.0).reshape(40, 3)
    assert np.allclose(rows_.times(right), random @ right) and np.allclose(rows_.transposed_times(left), random.T @ left)
    assert np.allclose(np.linalg.norm(rows_.unit().times(np.eye(9)), axis=1), 1)


@pytest.mark.parametrize("different", [1, 300, 1 << 17])
def test_numbers_of_a_block_are_packed_without_loss(different):
    numbers = np.random.default_rng(1).permutation(np.arange(1 << 17) % different) / 7 - 3
    numbers[:2] = 0.0, -0.0
    packed = blocks._packed(numbers)
    assert blocks._unpacked(packed).tobytes() == numbers.tobytes()
    assert len(packed) <= 8 + numbers.nbytes and (different > 300 or 3 * len(packed) < numbers.nbytes)


def test_rounds_hand_over_one_unit_at_a_time(spark, random, monkeypatch):
    """A unit is as large as a block's part of 512 columns; tasks must not gather theirs, and settings come back."""
    monkeypatch.setattr(blocks, "BLOCK_PERSONS", 5)
    monkeypatch.setattr(blocks, "WIDER", 1)
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.enableVectorizedReader"]
    before = [spark.conf.get(n) for n in names]
    real = ensemble._step

    def step(*options):
        run = real(*options)

        def checked(frames):
            def single():
                for frame in frames:
                    assert len(frame) <= 1, "units gathered"
                    yield frame

            yield from run(single())

        return checked

    monkeypatch.setattr(ensemble, "_step", step)
    with matrix.held(to_entries(spark, random)) as m:
        e = ensemble.factorize_all(m, [ensemble.Setting(2, seed=s) for s in range(6)], ensemble.Rules("multiplicative", 2, 0.0, None), columns=2)
        assert e.blocks.count > 4 and len(e.groups) == 6
    assert [spark.conf.get(n) for n in names] == before


def test_blocks_and_carried_entries_change_no_number(spark, random, monkeypatch):
    """Entries that travel with a wide factor, entries that stay, and another number of partitions: the very same numbers."""
    monkeypatch.setattr(blocks, "BLOCK_PERSONS", 6)
    monkeypatch.setattr(blocks, "WIDER", 1)
    settings = [ensemble.Setting(2, seed=1), ensemble.Setting(2, seed=2)]
    rules = ensemble.Rules("multiplicative", 4, 0.0, None)
    out = []
    for parts, per_person in ((1, 0.0), (5, 1e9)):
        with matrix.held(to_entries(spark, random).repartition(parts)) as m:
            laid = blocks.lay_out(m)
            laid.entries_per_person = per_person
            e = ensemble.factorize_all(m, settings, rules, None, laid)
            assert laid.count > 3
            out.append((dense(e.person_factor([0, 1]), "eid", "w"), dense(e.feature_factor([0, 1]), "featureName", "h"), e.errors))
    assert np.array_equal(out[0][0], out[1][0]) and np.array_equal(out[0][1], out[1][1]) and out[0][2] == out[1][2]


def test_joined_rounds_equal_blocks(spark, random):
    with matrix.held(to_entries(spark, random)) as m:
        start = nmf._start_tables(m, 3, partial(hashed_units, 0), partial(hashed_units, 1))
        joined, packed = nmf.joined_rounds(m, 3, start, 3, 0.0), nmf.factorize_held(m, 3, max_iter=3)
        assert np.allclose(dense(joined.w, "eid", "w"), dense(packed.w, "eid", "w")) and np.allclose(joined.errors, packed.errors)


def test_no_entries_give_empty_factors(spark):
    out = nmf.factorize(spark.createDataFrame([], ENTRY), 2, max_iter=3)
    assert out.w.count() == 0 and out.h.count() == 0


def test_picks():
    assert stability.least_error_run([5, 3, 4]) == 1
    assert stability.least_total_k({2: 0.8, 3: 0.1, 4: 0.4}) == 3
    assert sweeps.mean_score([0.1, 0.2, 0.6]) == pytest.approx(0.3)


def test_best_of_prefers_larger_k_on_ties(spark, rows):
    table = spark.createDataFrame([(2, 0.5), (6, 0.5), (10, 0.1)], "k int, silhouette_avg double")
    assert rows(sweeps.best_of(table)) == [(6, 0.5)]


def test_grid_tables(spark, rows):
    data = [(4, a, l, 3, n) for (a, l), n in zip([(1.0, 0.0), (1.0, 1.0), (5.0, 0.0), (5.0, 1.0)], [4.0, 5.0, 10.0, 11.0])]
    grid = spark.createDataFrame(data, "k int, alpha double, l1_ratio double, num_labels int, avg_nonzero_feature_count double")
    assert rows(sweeps.accepted(grid), "avg_nonzero_feature_count") == [(10.0,), (5.0,)]
    assert rows(sweeps.grid_pivot(grid, 4, [0.0, 1.0])) == [(1.0, 4.0, 5.0), (5.0, 10.0, 11.0)]


def test_bands(spark):
    persons = spark.createDataFrame(
        [("a", 0, 0.3), ("b", 0, 0.1), ("c", 2, 0.9), ("d", 2, -0.2), ("e", 2, 0.0)], "eid string, label int, silhouette double"
    )
    got = {r["eid"]: r["y"] for r in sweeps.silhouette_bands(persons).collect()}
    assert got == {"b": 10, "a": 11, "d": 22, "e": 23, "c": 24}


def test_bisecting_kmeans(spark):
    rng = np.random.default_rng(1)
    a = np.vstack([rng.normal(c, 0.1, (10, 2)) for c in ((1, 1), (5, 5))])
    vectors = features.to_vectors(to_entries(spark, a))
    model = clusters.bisecting_kmeans(vectors, 2)
    labels = [r["label"] for r in clusters.assignments(model, vectors).orderBy("eid").collect()]
    assert len(set(labels[:10])) == 1 and labels[0] != labels[10]
    centred = sum(((a[i : i + 10] - a[i : i + 10].mean(0)) ** 2).sum() for i in (0, 10))
    assert clusters.cost(model) == pytest.approx(centred)
    table = clusters.error_by_k(vectors, (2, 4)).orderBy("k").collect()
    assert table[1]["error"] < table[0]["error"]


def test_split_tree(spark):
    """Costs equal squared distances recomputed from the labels, never grow with k, and clusters of all k are nested."""
    rng = np.random.default_rng(3)
    a = np.vstack([rng.normal(c, 0.3, (n, 3)) for c, n in (((0, 0, 0), 40), ((5, 5, 1), 20), ((9, 0, 4), 12), ((-4, 6, 2), 8))])
    vectors = features.to_vectors(to_entries(spark, a)).repartition(3)
    tree = clusters.split_tree(vectors, 9)
    before, errors = None, []
    for k in range(1, 10):
        labels = np.array([r["label"] for r in tree.labels(vectors, k).orderBy("eid").collect()])
        assert sorted(set(labels)) == list(range(k))
        errors.append(sum(((a[labels == c] - a[labels == c].mean(0)) ** 2).sum() for c in range(k)))
        assert tree.error(k) == pytest.approx(errors[-1])
        if before is not None:
            assert sum(len(set(labels[before == c])) for c in set(before)) == k
            split = [c for c in set(before) if len(set(labels[before == c])) == 2]
            assert (before == split[0]).sum() == max((before == c).sum() for c in set(before))
        before = labels
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.1 * errors[0]
    same = spark.createDataFrame([(f"p{i}", "f", 2.0) for i in range(5)], ENTRY)
    assert [r["error"] for r in clusters.error_by_k(features.to_vectors(same), (2, 4)).collect()] == [0.0, 0.0]


def test_searches_run(spark, random):
    entries = to_entries(spark, random)
    assert sweeps.optimal_k(entries, (2, 3), max_iter=2).count() == 1
    grid = sweeps.grid_search(entries, (2,), (1.0,), (0.0,), max_iter=2).first()
    assert grid["num_labels"] <= 2
    chart = sweeps.silhouette_chart(entries, 2, max_iter=2)
    assert chart.count() == 40 and chart.select("y").distinct().count() == 40
    factors, totals = stability.stable_factorization(entries, (2,), runs=2, max_iter=2)
    assert factors.k == 2 and set(totals) == {2}


@pytest.mark.parametrize("exact", [1024, 0])
def test_axes_of_a_nearly_flat_spectrum(spark, monkeypatch, exact):
    monkeypatch.setattr(svd, "EXACT_FEATURES", exact)
    rng = np.random.default_rng(6)
    u, v = (np.linalg.qr(rng.normal(size=(n, 64)))[0] for n in (200, 64))
    spectrum = np.concatenate([[1.08, 1.04], np.linspace(1.0, 0.9, 62)]) if exact else np.concatenate([[2.0, 1.6], np.linspace(1.0, 0.9, 62)])
    u -= u.mean(0)
    a = np.linalg.qr(u)[0] * spectrum @ v.T
    entries = to_entries(spark, a)
    labels = entries.select("eid").distinct().withColumn("label", F.lit(0))
    for project in (svd.svd_project, svd.pca_entries):
        plane = project(entries, labels).orderBy("eid").collect()
        expected = np.abs(a @ np.linalg.svd(a)[2][:2].T)
        assert np.allclose(np.abs([[r["x"], r["y"]] for r in plane]), expected, atol=1e-6)


def test_singular_vectors_that_do_not_settle_are_an_error(spark, random, monkeypatch):
    monkeypatch.setattr(svd, "EXACT_FEATURES", 0)
    with matrix.held(to_entries(spark, random)) as m, pytest.raises(RuntimeError):
        svd.truncated_svd(m, 2, oversample=0, max_iter=2)


def test_kept_units_and_rounds_as_jobs_are_the_same_numbers(spark, random, monkeypatch):
    """Units that tasks keep through all rounds, in one stage or in several, and rounds as jobs; settings end at different rounds."""
    monkeypatch.setattr(blocks, "BLOCK_PERSONS", 6)
    monkeypatch.setattr(blocks, "WIDER", 1)
    settings = [ensemble.Setting(k, l1=k / 4, seed=s) for k in (2, 3) for s in range(3)]
    rules = ensemble.Rules("coordinate", 12, 0.0, 0.02)
    jobs, real = [], ensemble._by_rounds
    monkeypatch.setattr(ensemble, "_by_rounds", lambda *a: jobs.append(1) or real(*a))
    out = []
    with matrix.held(to_entries(spark, random)) as m:
        laid = blocks.lay_out(m)
        assert laid.count > 3
        for held, exchanged in ((256 << 20, 16 << 20), (256 << 20, 8 * (9 * 4 + 8 + 2) * laid.count), (0, 16 << 20)):
            monkeypatch.setattr(ensemble, "HELD_BYTES", held)
            monkeypatch.setattr(ensemble, "EXCHANGED_BYTES", exchanged)
            e = ensemble.factorize_all(m, settings, rules, None, laid, columns=4)
            assert len(jobs) == (held == 0) and len(e.groups) == 5
            out.append(([e.weights(i) for i in range(6)], [dense(e.person_factor([i]), "eid", "w") for i in range(6)], e.errors))
    assert len({len(x) for x in out[0][2]}) > 1
    for other in out[1:]:
        assert all(np.array_equal(a, b) for part in (0, 1) for a, b in zip(out[0][part], other[part], strict=True))
        assert out[0][2] == other[2]


def test_dense_units_of_many_persons_are_kept():
    """5.4 million persons of 31 features, 25 entries each, are 1.3 GB as dense blocks: twelve tasks of 256 MB keep them."""
    laid = blocks.Blocks(None, 258, 5_400_000, [f"f{i}" for i in range(31)], 1.0, 25.0)
    assert ensemble._kept_together(laid, [np.zeros((1, 31, 3))], 12) == [[0]]
    assert ensemble._kept_together(laid, [np.zeros((1, 31, 3))], 5) == []


def test_factorization_in_blocks_lays_nothing_out_by_person(spark, random, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_PERSONS", 6)
    monkeypatch.setattr(blocks, "WIDER", 1)
    with matrix.held(to_entries(spark, random)) as m:
        nmf.factorize_held(m, 2, max_iter=2)
        assert m.laid is None
        first = matrix.feature_gram(m)
        assert m.laid is not None and matrix.feature_gram(m) is first
        assert np.allclose(first[1], random.T @ random)


def test_blocks_hold_every_entry(spark, monkeypatch):
    """Persons in the order of their names, entries by feature, undefined values as zeros, squares added up."""
    rows = [("ä", "g", 2.0), ("b", "f", None), ("b", "g", float("nan")), ("10", "h", 4.0), ("9", "f", 1.0), ("b", "h", 3.0), ("10", "f", 0.5)]
    with matrix.held(spark.createDataFrame(rows, ENTRY)) as m:
        laid = blocks.lay_out(m)
    block = laid.table.first()
    assert laid.count == 1 and laid.names == ["f", "g", "h"] and laid.squares == block.squares == 30.25
    assert block.persons == ["10", "9", "b", "ä"]
    held = blocks.Rows.of(block.starts, block.columns, block.numbers, 3)
    assert np.array_equal(held.times(np.eye(3)), [[0.5, 0, 4], [1, 0, 0], [0, 0, 3], [0, 2, 0]])


@pytest.mark.parametrize("rows", [7, 8192])
def test_coordinate_descent_in_parts_of_the_rows(rows, monkeypatch):
    """Against a plain loop over settings, rows and columns; one column of the other factor is empty."""
    monkeypatch.setattr(ensemble, "RENEWED_ROWS", rows, raising=False)
    draw = np.random.default_rng(5)
    x, product, other = draw.random((2, 40, 3)), draw.random((2, 40, 3)), draw.random((2, 9, 3))
    other[1, :, 2] = 0
    gram, l1, l2 = other.transpose(0, 2, 1) @ other, np.array([0.1, 0.0]), np.array([0.2, 0.0])
    found, moved = ensemble._coordinate(x.copy(), product, gram, l1, l2)
    expected, total = x.copy(), np.zeros(2)
    for s in range(2):
        for row, wanted in zip(expected[s], product[s], strict=True):
            for t in range(3):
                slope, curve = gram[s, t] @ row - wanted[t] + l1[s] + l2[s] * row[t], gram[s, t, t] + l2[s]
                total[s] += abs(slope) if row[t] > 0 else abs(min(slope, 0.0))
                row[t] = max(0.0, row[t] - slope / curve) if curve > 0 else row[t]
    assert np.allclose(found, expected) and np.allclose(moved, total)


def test_settings_run_alone_with_all_entries(spark, monkeypatch):
    """Runs and penalized settings in tasks of their own equal those of one barrier stage; where a setting is too wide they do not run alone."""
    rng = np.random.default_rng(8)
    cells = [(f"p{i:03d}", f"f{j}", float(rng.integers(1, 9))) for i in range(300) for j in range(12) if rng.random() < 0.6]
    entries = spark.createDataFrame(cells, "eid string, featureName string, value double")
    monkeypatch.setattr(blocks, "BLOCK_PERSONS", 32)
    monkeypatch.setattr(blocks, "WIDER", 1)
    monkeypatch.setattr(blocks, "TILE_CELLS", 64)
    monkeypatch.setattr(blocks, "LEAST_TILE", 7)
    monkeypatch.setattr(ensemble, "ALONE_COLUMNS", 1)
    slots = ensemble._slots(spark)
    alone = ensemble._alone
    found, used = [], []
    monkeypatch.setattr(ensemble, "_alone", lambda *a: used.append(1) or alone(*a))
    with matrix.held(entries) as m:
        laid = blocks.lay_out(m)
        grid = [(k, float(a), 0.5) for k in (2, 3) for a in range(2 * slots)]
        runs = [ensemble.Setting(k, seed=s) for k in (2, 3) for s in range(2 * slots)]
        for most in (ensemble.ALONE_BYTES, 0):
            monkeypatch.setattr(ensemble, "ALONE_BYTES", most)
            drawn = ensemble.factorize_all(m, runs, ensemble.Rules("multiplicative", 6, 0.0, None), None, laid)
            (given, places), = nmf.regularized_all(m, grid, max_iter=9)
            assert laid.count > 1 and places == list(range(len(grid)))
            w = {r["eid"]: r["w"] for r in given.person_factor([3]).collect()}
            totals = ensemble.total_dissimilarities(drawn)
            found.append((drawn.errors, [drawn.weights(i) for i in range(len(runs))], totals, given.errors, [given.weights(i) for i in range(len(grid))], w))
    assert used == [1, 1]
    one, other = found
    assert one[5].keys() == other[5].keys() and all(np.allclose(v, other[5][p]) for p, v in one[5].items())
    for a, b in zip(one[:2] + one[3:5], other[:2] + other[3:5], strict=True):
        assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))
    assert one[2] == pytest.approx(other[2])
