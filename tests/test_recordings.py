"""Recording operators against brute-force and dense versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.kernels import numeric
from tracewell.operators import events, factors, models, populations, signals, voxels
from tracewell.plans import jobs
from tracewell.session import broadcast_if_small, materialize


@pytest.fixture(scope="module", name="three")
def three_factors(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(160, 3)) * [3, 2, 1]) @ rng.normal(size=(3, 30)) + rng.normal(size=(160, 30)) * 0.5 + 7
    return materialize(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, trace array<double>"), "cells"), x


def test_principal_components(three):
    cells, x = three
    rows = sorted(models.principal_components(cells, "cell", 30, 3).collect())
    mean = x.mean(0)
    v = np.linalg.svd(x - mean, full_matrices=False)[2][:3]
    back = (x - mean) @ v.T @ v + mean
    assert np.allclose([r.explained for r in rows], 1 - np.square(back - x).sum(1) / np.square(x).sum(1), atol=1e-6)
    assert np.allclose(np.abs(np.array([r.scores for r in rows])), np.abs((x - mean) @ v.T), atol=1e-2)


def test_factor_model_rebuilds_correlations(three):
    cells, x = three
    loads, scores = models.factor_model(cells, "cell", 30, 3)
    rows = sorted(loads.collect())
    a, z = np.array([r.loadings for r in rows]), (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    assert len(rows) == 160 and np.abs((z @ z.T / 30 - a @ a.T)[np.triu_indices(160, 1)]).mean() < 0.02
    assert np.abs(numeric.varimax(a) - np.eye(3)).max() < 0.02  # already rotated
    assert (a[np.abs(a).argmax(0), range(3)] > 0).all()
    assert np.allclose(models.least_squares_scores(loads, cells, "cell", 30, 3), np.linalg.lstsq(a, x, rcond=None)[0])
    got = np.array([r.loadings for r in sorted(models.least_squares_loadings(cells, "cell", scores).collect())])
    assert np.allclose(got, np.linalg.lstsq(scores.T, x.T, rcond=None)[0].T)


def test_rotation_by_passes_equals_that_by_moments(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = materialize(spark.createDataFrame([(0, v.tolist()) for v in rng.normal(size=(90, 4)) * [3, 1, 2, 1]], "g int, loadings array<double>"), "loadings")
    one = factors.varimax(rows, {0: 4})[0]
    monkeypatch.setattr(factors, "MOMENTS", 0)
    assert np.allclose(one, factors.varimax(rows, {0: 4})[0], atol=1e-8)


def _by_hand(x, k):
    """Maximum-likelihood loadings of cells (rows) by dense algebra, rotated, the largest positive."""
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    psi = np.ones(len(z))
    for _ in range(3000):
        v = np.linalg.eigh((z / psi[:, None]).T @ z)[1][:, ::-1][:, :k]
        new = np.maximum(1 - np.square(z @ v).sum(1) / z.shape[1], 1e-6)
        if np.abs(np.log(new / psi)).max() < 1e-9:
            break
        psi = new
    loads = z @ v / np.sqrt(z.shape[1])
    loads = loads @ numeric.varimax(loads)
    return loads * np.where(-loads.min(0) > loads.max(0), -1, 1)


def _matched(a, b):
    """The columns of b in the order that fits a best."""
    return b[:, np.argmax(np.abs(a.T @ b), 1)]


@pytest.mark.parametrize("sample", [4096, 200])
def test_grouped_factors_equal_those_by_hand(spark, monkeypatch, sample):
    """Three groups in the same passes, each as if it were alone; the sample only says where the passes start."""
    monkeypatch.setattr(factors, "SAMPLE", sample)
    monkeypatch.setattr(factors._sampled, "__defaults__", (sample, "cell"))
    rng = np.random.default_rng(1)
    data = {g: (rng.normal(size=(n, k)) * [5, 3, 2, 1.5][:k]) @ rng.normal(size=(k, 40)) + rng.normal(size=(n, 40)) for g, n, k in ((3, 900, 3), (7, 500, 2), (9, 60, 1))}
    rows = [(g, g * 10_000 + i, v.tolist()) for g, x in data.items() for i, v in enumerate(x)]
    cells = spark.createDataFrame(rows, "label int, cell long, trace array<double>").repartition(4)
    loads, scores = factors.factor_models(cells, "label", "cell", 40, {3: 3, 7: 2, 9: 1}, 60)
    got = sorted(loads.collect(), key=lambda r: r.cell)
    for g, k in ((3, 3), (7, 2), (9, 1)):
        a, want = np.array([r.loadings for r in got if r.label == g]), _by_hand(data[g], k)
        assert a.shape == want.shape and np.abs(_matched(want, a) - want).max() < 5e-3
        z = (data[g] - data[g].mean(1, keepdims=True)) / data[g].std(1, keepdims=True)
        assert np.allclose(a, z @ scores[g].T / 40, atol=1e-5)


def test_baseline_and_subclusters_by_hand(spark):
    """Seeds, templates, assignment and refined means, recomputed from the components and loadings."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4, 60))
    x = np.stack([base[i % 4] * (1 + i % 3) + 0.3 * rng.normal(size=60) for i in range(200)])
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "cell long, cluster int, trace array<double>").repartition(3)
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    got, means = jobs.baseline_clusters(rows, "cell", 60, 4, 0.6, 5, 0.5, least_explained=0.5)
    v = np.linalg.svd(z - z.mean(0), full_matrices=False)[2][:4]
    v *= np.where(v[range(4), np.abs(v).argmax(1)] < 0, -1, 1)[:, None]
    scores = (z - z.mean(0)) @ v.T
    back = scores @ v + z.mean(0)
    kept = 1 - np.square(back - z).sum(1) / np.square(z).sum(1) > 0.5
    top, one = np.abs(scores).argmax(1), (np.abs(scores) > 0.6 * np.abs(scores).max(1, keepdims=True)).sum(1) == 1
    side = 2 * top + (scores[range(200), top] > 0)
    templates = [back[kept & one & (side == s)].mean(0) for s in range(8) if (kept & one & (side == s)).sum() > 5]
    r = numeric.rank_correlations(back, np.stack(templates))
    want = np.where(kept & (r.max(1) >= 0.5), r.argmax(1), -1)
    found = {q.cell: -1 if q.label is None else q.label for q in got.collect()}
    assert len(templates) > 1 and [found[i] for i in range(200)] == want.tolist()
    for q in means.collect():
        assert q.n == (want == q.label).sum() and np.allclose(q["mean"], back[want == q.label].mean(0), atol=1e-5)

    sub = {q.cell: q.sub for q in jobs.factor_subclusters(rows, "cluster", "cell", 60, 2, 0.3, 5, 0.4).collect()}
    loads, _ = factors.factor_models(rows, "cluster", "cell", 60, {0: 2, 1: 2})
    by = {q.cell: np.array(q.loadings) for q in loads.collect()}
    offset = 0
    for g in (0, 1):
        of = np.arange(g, 200, 2)
        a = np.stack([by[i] for i in of])
        sides = [a[:, c] * s > 0.3 for c in range(2) for s in (-1, 1)]
        own = numeric.rank_correlations(z[of], np.stack([z[of][m].mean(0) for m in sides if m.sum() > 5]))
        local = np.where(own.max(1) < 0.4, -1, own.argmax(1))
        local = local + (local.min() < 0)
        assert [sub[i] for i in of] == (local + offset).tolist()
        offset += local.max() + 1


def _labels(loads, least_cells, least_weight, large):
    w = np.concatenate([np.maximum(loads, 0), -np.minimum(loads, 0)], 1)
    w[w < least_weight] = 0
    w = w[:, (w > 0).sum(0) > least_cells]
    for _ in range(3):
        if w.shape[1]:
            w = w[:, np.bincount(w.argmax(1), minlength=w.shape[1]) > least_cells]
    if not w.shape[1]:
        return np.zeros(len(loads), int)
    w = w[:, np.argsort(-np.bincount(w.argmax(1), minlength=w.shape[1]), kind="stable")]
    label = w.argmax(1)
    other = (w[:, 1:] > 0).any(1) & (label == 0)
    if w.shape[1] > 1 and (label == 0).mean() > large and other.mean() > 0.5:
        label[other] = w[other, 1:].argmax(1) + label.max()
    return label


@pytest.mark.parametrize(("scale", "least"), [([1, 1, 1], 5), ([9, 1, 1], 3), ([1, 1, 1], 500), ([1, 0.2, 0.1], 8)])
def test_cluster_labels(spark, scale, least):
    loads = np.random.default_rng(2).normal(size=(120, 3)) * scale
    loads[:, 0] = np.abs(loads[:, 0])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(loads)], "cell long, loadings array<double>")
    got = sorted(models.cluster_labels(rows, "cell", 3, least, 0.2, 0.8).collect())
    assert [r.label for r in got] == _labels(loads, least, 0.2, 0.8).tolist()


def test_filters():
    w = np.exp(1j * np.pi * np.array([0.02, 0.1, 0.2, 0.3, 0.6]))
    gain = np.abs(np.prod([np.polyval(b, w) / np.polyval(a, w) for b, a in numeric.band_sections(5, 0.1, 0.3)], axis=0))
    assert np.allclose(gain[[1, 3]], math.sqrt(0.5), atol=1e-6) and np.isclose(gain[2], 1, atol=1e-3) and gain[0] < 1e-3 and gain[4] < 5e-3
    x = np.random.default_rng(1).normal(size=(2, 50))
    b, a = numeric.butterworth_low(3, 0.2)
    want = np.zeros_like(x)
    for t in range(50):
        want[:, t] = sum(b[k] * x[:, t - k] for k in range(4) if t >= k) - sum(a[k] * want[:, t - k] for k in range(1, 4) if t >= k)
    assert np.allclose(numeric.causal_low_pass(x, 0.2, 3), want)
    t = np.arange(2000)
    mixed = np.sin(np.pi * 0.2 * t)[None] + 5 + np.sin(np.pi * 0.7 * t)[None]
    assert np.abs(numeric.zero_phase_band_pass(mixed, 0.1, 0.3)[0, 500:1500] - np.sin(np.pi * 0.2 * t)[500:1500]).max() < 0.02


def test_anova(spark):
    rng = random.Random(0)
    rows = [(c, a, b, a * 2.0 + b + rng.gauss(0, 1)) for c in ("x", "y") for a in range(3) for b in range(5) for _ in range(3) if (c, a, b) != ("x", 1, 2)]
    got = {(r.condition, r.term): r for r in populations.two_way_anova(spark.createDataFrame(rows, "c string, a int, b int, v double"), "a", "b", "v", "c").collect()}
    means = {}
    for c, a, b, v in rows:
        means.setdefault((c, a, b), []).append(v)
    table = [(a, b, float(np.mean(v))) for (c, a, b), v in means.items() if c == "x"]
    y = np.array([v for *_, v in table])

    def left(*on):
        x = np.array([[1.0, *[float(row[k] == level) for k, levels in on for level in levels]] for row in table])
        return np.square(y - x @ np.linalg.lstsq(x, y, rcond=None)[0]).sum()

    one, two = (0, [1, 2]), (1, [1, 2, 3, 4])
    full = left(one, two)
    assert math.isclose(got["x", "a"].sum_sq, left(two) - full) and math.isclose(got["x", "b"].sum_sq, left(one) - full)
    assert math.isclose(got["x", "error"].sum_sq, full) and got["x", "error"].df == 14 - 1 - 2 - 4
    assert math.isclose(got["x", "a"].f, (left(two) - full) / 2 / (full / 7)) and 0 < got["x", "a"].p < 1e-3
    assert got["combined", "error"].df == 8 and got["y", "error"].df == 8
    assert populations.two_way_anova(spark.createDataFrame([], "c string, a int, b int, v double"), "a", "b", "v", "c").filter("f is not null").count() == 0


@pytest.mark.parametrize("swap", [False, True])
def test_anova_of_many_units(spark, swap):
    """Unbalanced, with null levels and non-finite values; either factor may be the larger."""
    rng = random.Random(4)
    rows = [("x", a, f"u{b}" if b else None, a + b % 5 + rng.gauss(0, 1)) for b in range(400) for a in range(4) if rng.random() < 0.7] + [("x", 1, "u9", math.nan), ("x", 2, "u9", math.inf), ("x", 2, "u9", None)]
    df = spark.createDataFrame(rows, "c string, a int, b string, v double")
    names = ("b", "a") if swap else ("a", "b")
    got = {r.term: r for r in populations.two_way_anova(df, *names, "v").collect()}
    means = {}
    for _, a, b, v in rows:
        if v is not None and math.isfinite(v):
            means.setdefault((a, b), []).append(v)
    y = np.array([np.mean(v) for v in means.values()])
    dummies = lambda k: np.array([[float(x[k] == level) for level in sorted({z[k] for z in means}, key=str)[1:]] for x in means])

    def left(*parts):
        x = np.concatenate([np.ones((len(y), 1)), *parts], 1)
        return np.square(y - x @ np.linalg.lstsq(x, y, rcond=None)[0]).sum()

    a, b = (dummies(1), dummies(0)) if swap else (dummies(0), dummies(1))
    full = left(a, b)
    assert math.isclose(got["a"].sum_sq, left(b) - full, rel_tol=1e-8) and math.isclose(got["b"].sum_sq, left(a) - full, rel_tol=1e-8)
    assert math.isclose(got["error"].sum_sq, full, rel_tol=1e-8) and got["error"].df == len(y) - 1 - a.shape[1] - b.shape[1]


def test_p_values_are_those_of_the_distributions():
    """Closed forms: t with 1, 2 and 4 degrees of freedom, F with 2 and any."""
    rs = np.linspace(-0.999, 0.999, 41)
    t = lambda r, n: abs(r) * math.sqrt((n - 2) / (1 - r * r))
    assert np.allclose(numeric.spearman_p(rs, 3), [1 - 2 / math.pi * math.atan(t(r, 3)) for r in rs])
    assert np.allclose(numeric.spearman_p(rs, 4), [1 - t(r, 4) / math.sqrt(2 + t(r, 4) ** 2) for r in rs])
    assert np.isnan(numeric.spearman_p(np.array([0.5, np.nan]), np.array([2, 9]))).all() and (numeric.spearman_p(np.array([1.0, -1.0]), 9) == 0).all()
    assert all(math.isclose(numeric.f_p(f, 2, m), (1 + 2 * f / m) ** (-m / 2), rel_tol=1e-9) for f in (0.1, 1.0, 7.5) for m in (1, 6, 500))
    assert np.allclose(numeric._log_gamma(np.array([0.5, 1, 3.3, 14.9, 150.5])), [math.lgamma(x) for x in (0.5, 1, 3.3, 14.9, 150.5)], rtol=1e-13, atol=1e-13)


def _bursts(x, block, width, top, gap):
    d = np.diff(x)
    peaks = np.flatnonzero((d[:-1] > 0) & (d[1:] < 0))
    edges = np.arange(round(top / width) + 1) * width
    level = np.zeros(len(x))
    last = 0
    for i in range(0, len(x) - block, block):
        bins = np.minimum(np.floor(x[peaks[peaks < i + block]] / width).astype(int), len(edges) - 2)
        counts = np.bincount(bins, minlength=len(edges) - 1)
        mode = int(counts.argmax())
        low = np.flatnonzero(counts[:mode] < counts[mode] / 200)
        floor = int(low.max()) if len(low) else 0
        level[i:] = mode * width + 2.5 * (mode - floor) * width
        last = i
    bursts, bouts = [int(p) for p in peaks if x[p] > level[p]], []
    for p in bursts:
        if bouts and p - bouts[-1][1] <= gap:
            bouts[-1][1] = p
        else:
            bouts.append([p, p])
    return [(s, e) for s, e in bouts if s != e], last


def test_burst_bouts(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key in range(3):
        x = np.abs(rng.normal(0.01, 0.003, 640)) + np.convolve((rng.random(640) < 0.06) * rng.random(640) * 0.06, [0.8, 1, 0.8], "same")
        rows += [(key, i, float(v)) for i, v in enumerate(x)]
        want[key] = _bursts(x, 100, 1e-3, 0.1, 30)[0]
    got = events.burst_bouts(spark.createDataFrame(rows, "key int, i int, v double"), ["key"], "i", "v", 100, 1e-3, gap=30).collect()
    for key in range(3):
        assert sorted((r.start, r.end) for r in got if r.key == key) == want[key] and want[key]


@pytest.mark.parametrize("values", [[], [1.0], [5.0] * 40, [float(i % 7) for i in range(500)], [random.Random(1).gauss(0, 1) for _ in range(2000)]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = signals.exact_quantiles(df, "v", [0, 0.1, 0.37, 0.99, 1], bins=16, few=5)
    assert got == [None] * 5 if not values else np.allclose(got, np.quantile(values, [0, 0.1, 0.37, 0.99, 1]))
    assert voxels.normalise_intensity(df, "v", 0.1, 0.9).count() == len(values) + 1


def test_quantiles_of_odd_values(spark):
    """Infinities are the ends, NaN and nulls do not count; values over all magnitudes narrow down too."""
    run = lambda values, shares: signals.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", shares, bins=16, few=5)
    nan, inf = math.nan, math.inf
    assert run([*map(float, range(100)), inf], [0, 0.5, 0.9, 1]) == [0.0, 50.0, 90.0, inf]
    assert run([-inf, *map(float, range(99)), inf], [0, 0.5, 1]) == [-inf, 49.0, inf]
    assert np.allclose(run([*map(float, range(101)), nan, None, nan], [0.5, 0.9]), [50, 90])
    assert run([nan, None], [0.5]) == [None] and run([inf, inf, inf], [0.2]) == [inf]
    wide = [2.0**k for k in range(-1000, 1000, 5)] + [-(2.0**k) for k in range(-1000, 1000, 5)]
    assert run(wide, [0.25, 0.6, 0.75]) == list(np.quantile(wide, [0.25, 0.6, 0.75]))
    assert run([-1.7e308, *([3.0] * 50), 1.7e308], [0.0, 0.5, 1.0]) == [-1.7e308, 3.0, 1.7e308]


def test_grid_of_odd_values(spark):
    rows = [("a", v) for v in (0.1, 0.7, 0.3, 0.30000000000000004)] + [("a", math.nan), ("a", math.inf), ("a", None), ("b", 5.0), ("b", 5.0), ("c", math.nan)]
    got = signals.ecdf_grid(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 7).orderBy("k", "i").collect()
    assert {r.k for r in got} == {"a", "b"} and all(r.ecdf == 1 for r in got if r.i == 6 or r.k == "b")
    values = [0.1, 0.7, 0.3, 0.30000000000000004]
    assert [r.ecdf for r in got if r.k == "a"] == [np.mean(np.array(values) <= r.x) for r in got if r.k == "a"]
    assert [r.x for r in got if r.k == "a"][-1] == 0.7


def test_oxygen_bins_without_clamping(spark):
    cells = spark.createDataFrame([(i, 0, [math.sin(i + t) for t in range(9)]) for i in range(4)], "cell int, rec int, trace array<double>")
    times = spark.createDataFrame([(0, [float(t) for t in range(12)])], "rec int, sec array<double>")
    curve = spark.createDataFrame([(t, float(t * t % 7)) for t in range(7)], "sec int, value double")
    for clamp, n in ((True, 7), (False, 5)):
        rows = jobs.oxygen_correlations(cells, times, curve, "cell", "rec", 0.5, 7.5, clamp).collect()
        assert {len(r.inside) for r in rows} == {n}
        for r in rows:
            known = [float(t * t % 7) if t < 7 else 1.0 for t in range(1, n + 1)]
            assert math.isclose(r.r, numeric.rank_correlations(np.array([r.trace[1 : n + 1]]), np.array([known]))[0, 0]) and 0 <= r.p <= 1


def test_places_and_pairs(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "k int, t int, v double")
    kept = signals.exclude_places(df, ["k"], ["t"], spark.createDataFrame([(1, 0), (1, 3), (2, 1)], "k int, place int"))
    assert sorted(r.t for r in kept.collect()) == [1, 2, 4]
    cells = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0])], "rec int, trace array<double>")
    times = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, 0.2])], "rec int, sec array<double>")
    got = {r.rec: (r.trace, r.sec) for r in signals.pair_times(cells, times, "rec").collect()}
    assert got == {1: ([1.0, 2.0], [0.1, 0.2]), 2: ([4.0], [0.1])}
    inside = signals.within(signals.pair_times(cells, times, "rec"), 0.1, 0.3).collect()
    assert {r.rec: r.trace for r in inside} == {1: [2.0], 2: []}


def test_broadcasts_are_bounded_by_bytes(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    wide = materialize(spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("t")), "wide")
    assert "strategy=broadcast" in plan(spark.range(9).join(broadcast_if_small(wide, 100), "id"))
    assert "strategy=broadcast" not in plan(spark.range(9).join(broadcast_if_small(wide, 100, 10_000), "id"))
    assert "strategy=broadcast" not in plan(spark.range(9).join(broadcast_if_small(wide, 10), "id"))


def test_jobs_over_a_catalog(spark, tmp_path):
    from tracewell.__main__ import main
    from tracewell.plans import recording_jobs

    rng = np.random.default_rng(8)
    lines = ["recording_id,cohort,dir,save_root,registration_root"]
    for k in range(2):
        root = tmp_path / f"rec{k}"
        lines.append(f"{k},a,d,{root},None")
        swim = np.abs(rng.normal(size=330))
        traces = [np.convolve(np.sqrt(np.maximum(swim - np.percentile(swim[:320], 70), 0)), [0, 1, 0.5])[:320] + 0.05 * rng.normal(size=320) for _ in range(6)]
        spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(traces)], "cell int, trace array<double>").write.parquet(str(root / "cells.parquet"))
        flags = [(0, True, None, None), (1, False, False, None), (2, False, True, False), (3, False, True, True), (4, False, True, True), (5, False, True, True)]
        spark.createDataFrame(flags, "cell int, invalid boolean, explained boolean, active boolean").write.parquet(str(root / "flags.parquet"))
        spark.createDataFrame([(i, 10.0 * i, float(s)) for i, s in enumerate(swim)], "frame int, sec double, swim double").write.parquet(str(root / "frames.parquet"))
    (tmp_path / "list.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "o2.csv").write_text("sec,value\n" + "\n".join(f"{t},{math.sin(t / 300)}" for t in range(1, 3301)) + "\n")
    catalog, out = str(tmp_path / "list.csv"), str(tmp_path / "fits")
    states = {"normoxia": (600.0, 1200.0), "hypoxia": (1800.0, 2400.0)}
    assert recording_jobs.swim_fit_job(spark, catalog, out, 0, 0, states=states, lags=(2, 4)) == [0]
    assert recording_jobs.swim_fit_job(spark, catalog, out, states=states, lags=(2, 4)) == [1]  # 0 is finished
    assert recording_jobs.swim_fit_job(spark, catalog, out, states=states, lags=(2, 4)) == []
    fits = spark.read.parquet(out).collect()
    assert {(r.recording_id, r.cell, r.state) for r in fits} == {(k, c, s) for k in (0, 1) for c in (3, 4, 5) for s in states}
    assert all(r.r2 > 0.8 for r in fits if not r.skipped) and not all(r.skipped for r in fits)
    assert main(["oxygen", "--catalog", catalog, "--out", str(tmp_path / "ox"), "--oxygen-file", str(tmp_path / "o2.csv"), "--max-index", "0"]) == [0]
    assert sorted(r.cell for r in spark.read.parquet(str(tmp_path / "ox")).collect()) == [1, 2, 3, 4, 5]
    cells = spark.createDataFrame([(i, rng.normal(size=20).tolist()) for i in range(30)], "cell int, trace array<double>")
    loads, scores = models.factor_model(materialize(cells, "few"), "cell", 20, 2)
    recording_jobs.save_factors(loads, scores, str(tmp_path / "model"))
    again, same = recording_jobs.load_factors(spark, str(tmp_path / "model"))
    assert np.allclose(same, scores) and sorted(map(tuple, again.collect())) == sorted(map(tuple, loads.collect()))


def test_triggers_and_swim_by_frame(spark):
    rng = np.random.default_rng(1)
    cam = np.where(np.arange(200) % 23 < 3, 5.0, 0.0)
    swim, back = rng.normal(size=200), rng.normal(size=200)
    samples = spark.createDataFrame([(0, i, float(c), float(s), float(b)) for i, (c, s, b) in enumerate(zip(cam, swim, back, strict=True))], "k int, i int, cam double, s double, b double")
    triggers = jobs.camera_triggers(samples, ["k"], "i", "cam")
    at = [i for i in range(1, 200) if cam[i - 1] < 3.8 < cam[i]]
    assert [(r.frame, r.sample_idx) for r in triggers.orderBy("frame").collect()] == list(enumerate(at))
    above = np.maximum(swim - back, 0)
    want = [sum(above[t - n] for n in range(23) if t >= n) for t in at]
    got = jobs.swim_by_frame(samples, triggers, "k", "i", "s", "b").orderBy("frame").collect()
    assert np.allclose([r.swim for r in got], want)
    odd = samples.withColumn("s", F.when(F.col("i") == 50, F.lit(math.nan)).otherwise(F.col("s")))
    again = jobs.swim_by_frame(odd, triggers, "k", "i", "s", "b").orderBy("frame").collect()
    of = next(j for j, t in enumerate(at) if t - 23 < 50 <= t)
    assert [j for j, r in enumerate(again) if math.isnan(r.swim)] == [of]
    one = jobs.swim_by_frame(samples, triggers.filter("frame = 2"), "k", "i", "s", "b").collect()
    assert len(one) == 1 and math.isclose(one[0].swim, above[: at[2] + 1].sum())


def test_a_configured_master_stays(tmp_path):
    """A session of its own process: what spark-submit sets is not overridden."""
    import subprocess
    import sys

    code = "from tracewell.session import get_session; s = get_session(cores='3'); print('MASTER', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'))"
    for given, want in (("--master local[2] --conf spark.sql.shuffle.partitions=77", "local[2] 77"), ("", "local[3] 8")):
        env = {**__import__("os").environ, "PYSPARK_SUBMIT_ARGS": f"{given} pyspark-shell"}
        out = subprocess.run([sys.executable, "-c", code], env=env, cwd=str(__import__("pathlib").Path(__file__).parent.parent), capture_output=True, text=True, timeout=180)
        assert f"MASTER {want}" in out.stdout, out.stderr[-500:]


def test_bout_bins(spark):
    values = np.random.default_rng(2).normal(size=400)
    samples = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k int, i int, v double")
    spans = [(5, 8), (90, 95), (150, 160), (200, 210), (260, 270), (380, 390)]
    bouts = spark.createDataFrame([(0, j, s, e) for j, (s, e) in enumerate(spans)], "k int, bout int, start int, end int")
    got = {(r.bout, r.bin): r for r in jobs.bout_bins(bouts, samples, "k", "i", ["v"], 7, 20, 30).collect()}
    kept = [j for j, (s, _) in enumerate(spans) if s > 40 and s + 60 < 400][:-1]
    assert {j for j, _ in got} == set(kept) and {b for _, b in got} == set(range(7))
    for j in kept:
        s, e = spans[j]
        for b in range(7):
            r = got[j, b]
            assert math.isclose(r.v, values[s - 20 + 7 * b : s - 13 + 7 * b].mean()) and (r.duration, r.gap_before, r.gap_after) == (e - s, s - spans[j - 1][1], spans[j + 1][0] - e)


def test_files(spark, tmp_path):
    from tracewell.sources import files, sinks

    files.register(spark)
    x = np.arange(60, dtype=np.float32).reshape(12, 5)
    np.savez(tmp_path / "a.npz", x=x, y=x[:, 0])
    np.savez_compressed(tmp_path / "b.npz", x=x)
    np.save(tmp_path / "c.npy", x)
    for name, key in (("a.npz", "x"), ("b.npz", "x"), ("c.npy", "x")):
        rows = spark.read.format("npy").option("path", str(tmp_path / name)).option("key", key).option("rows", 5).load().orderBy("row").collect()
        assert [r["values"] for r in rows] == x.tolist()
    rows = spark.read.format("npy").option("path", str(tmp_path / "a.npz")).option("key", "y").load().orderBy("row").collect()
    assert [r["values"] for r in rows] == x[:, :1].tolist()
    (tmp_path / "cam.xml").write_text("<r><action a='3' z=\"9\"/><info a=\"1\" b='two words'/>\n<info b=\"2\"/></r>")
    assert {r.name: r.value for r in files.read_camera_info(spark, str(tmp_path / "cam.xml")).collect()} == {"a": "3", "b": "2", "z": "9"}
    assert files.find_file("c.npy", ["/nowhere", str(tmp_path)]) == str(tmp_path / "c.npy")
    with pytest.raises(FileNotFoundError):
        files.find_file("d.npy", [str(tmp_path)])
    channels = spark.createDataFrame([("swim1", 0, 1.0), ("visualInput1", 0, 2.0), ("visualInput3", 0, 3.0), ("swim3", 0, 4.0)], "channel string, sample_idx int, value double")
    named = files.rename_channels(channels, {"gain": "visualInput3", "velocity": "visualInput3"})
    assert sorted((r.signal, r.value) for r in named.collect()) == [("camTicks", 2.0), ("gain_trace", 3.0), ("swim1", 1.0), ("velocity_trace", 3.0)]
    sinks.write_runs(channels, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 4
    totals = sinks.cohort_totals(spark.createDataFrame([("a", 0, 5, True), ("a", 0, 6, False), ("b", 1, 7, True)], "cohort string, recording_id int, bytes long, present boolean"))
    assert sorted(map(tuple, totals.collect())) == [("a", 1, 11, 1), ("b", 1, 7, 0)]
    sinks.write_report(totals, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 2
    sinks.write_markdown(totals, str(tmp_path / "md"), "Cohorts")
    assert "".join(p.read_text() for p in (tmp_path / "md").glob("part-*")) == "# Cohorts\n\n| cohort | recordings | bytes | incomplete |\n|---|---|---|---|\n| a | 1 | 11 | 1 |\n| b | 1 | 7 | 0 |\n"


def test_large_groups_are_fitted_by_sums(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g, n in (("hot", 400), (None, 300), ("flat", 250), ("split", 260), ("small", 60)):
        k = 3 if g == "hot" else 2
        for _ in range(n):
            x = rng.normal(size=k)
            y = 1.0 if g == "flat" else float(x[0] > 0) if g == "split" else float(rng.random() < 1 / (1 + np.exp(-x.sum() - 0.3)))
            rows.append((g, x.tolist(), y))
    rows += [("hot", None, 1.0), ("hot", [1.0, None, 2.0], 0.0), ("hot", [1.0, 1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "g string, x array<double>, y double").filter("x is not null").repartition(3)
    one = {r.g: r for r in models.logistic_fits(df, ["g"], "x", "y").collect()}
    two = {r.g: r for r in models.logistic_fits(df, ["g"], "x", "y", most=100).collect()}
    assert one.keys() == two.keys() == {"hot", None, "flat", "split", "small"}
    for g, a in one.items():
        b = two[g]
        assert (a.n, a.separated) == (b.n, b.separated) and (a.params is None) == (b.params is None)
        if a.params is not None and not a.separated:
            assert np.allclose(a.params, b.params, atol=1e-6) and all(math.isclose(a[c], b[c], rel_tol=1e-6, abs_tol=1e-8) for c in ("r2", "aic", "llf"))
    assert one["flat"].params is None and two["flat"].n == 250
