"""Whole analyses on small made-up recordings with known answers."""

import math

import numpy as np
from pyspark.sql import functions as F

from tracewell.kernels import numeric
from tracewell.operators import models, signals
from tracewell.plans import jobs
from tracewell.plans.queries import QUERIES


def cells(spark, *traces):
    return spark.createDataFrame([(i, [float(x) for x in t]) for i, t in enumerate(traces)], "cell_id long, trace array<double>")


def test_fits_by_state_screen_and_recover_the_ratio(spark):
    rng = np.random.default_rng(0)
    signal = rng.normal(size=200)
    x = jobs.swim_regressor(signal)
    driven = np.r_[x[:100], 4 * x[100:]]
    fits = jobs.swim_fits(cells(spark, driven, np.ones(200), rng.normal(size=200)), "cell_id", signal, {"a": (0, 100), "b": (100, 200)}, lags=(2, 4), least=0.5)
    rows = {(r.cell_id, r.state): r for r in fits.collect()}
    assert len(rows) == 6 and not rows[0, "a"].skipped and rows[1, "a"].skipped and rows[2, "b"].skipped
    assert rows[1, "a"].spearman_r is None and rows[1, "a"].r2 is None and rows[0, "a"].r2 > 0.99
    (ratio,) = jobs.beta_ratios(fits, "cell_id", "a", "b", 0.5).collect()
    assert math.isclose(ratio.ratio, 2, abs_tol=0.05)


def test_regressor_keeps_what_exceeds_its_percentile():
    x = jobs.swim_regressor(np.arange(11.0), 70)
    assert x[:8].max() == 0 and math.isclose(x[-1], math.sqrt(3))


def test_lag_specs_order_and_drop_short_histories(spark):
    rows = spark.createDataFrame([(1, i, float(i), float(10 * i)) for i in range(4)], "k int, i int, a double, b double")
    got = jobs.lag_specs(rows, ["k"], ["i"], {"o2": "a", "swim": "b"}, [{"o2": 2}, {"o2": 1, "swim": 2}]).collect()
    assert {(r.spec_label, r.i): r.x for r in got} == {
        ("o2:2", 2): [0.0, 1.0], ("o2:2", 3): [1.0, 2.0], ("o2:1, swim:2", 2): [1.0, 0.0, 10.0], ("o2:1, swim:2", 3): [2.0, 10.0, 20.0],
    }


def test_runs_draw_negatives_alike_every_time(spark):
    rows = spark.range(4000).select("id", F.lit(0).alias("spec_idx"), F.lit("s").alias("spec_label"), F.lit(1).alias("fish"), F.lit("n").alias("c"), (F.pmod("id", F.lit(10)) == 0).alias("y"), F.array(F.rand(1)).alias("x"))
    rows = rows.cache()
    a = jobs.behaviour_runs(rows, "fish", "c", "y", 2, identity=["id"]).orderBy("run_idx").collect()
    b = jobs.behaviour_runs(rows.repartition(7), "fish", "c", "y", 2, identity=["id"]).orderBy("run_idx").collect()
    assert [r.n for r in a] == [r.n for r in b] and a[0].n != a[1].n
    assert all(abs((r.n - 400) / 3600 - jobs.NEGATIVES) < 0.03 for r in a)


def test_edge_guard_drops_the_last_bout(spark):
    bouts = spark.createDataFrame([(1, s, s + 5) for s in (10, 30, 50, 95)], "k int, s long, e long")
    assert sorted(r.s for r in jobs.guard_edges(bouts, ["k"], "s", "e", 8, 8, 100).collect()) == [30]


def _model_bins(spark, n=260):
    rng = np.random.default_rng(8)
    rows = []
    for f in range(3):
        o2, swim = rng.normal(size=n), rng.normal(size=n)
        for i in range(n):
            y = rng.random() < 1 / (1 + np.exp(-(o2[i - 1] - swim[i - 2]))) if f < 2 else i % 26 == 5  # the last fish has ten positives
            rows.append((f, "h" if i % 2 else "n", i, float(o2[i]), float(swim[i]) if f < 2 else float(i % 26 == 4), bool(y)))
    return spark.createDataFrame(rows, "fish int, cond string, i int, o2 double, swim double, y boolean"), rows


_SPECS = [{"o2": 2}, {"swim": 1}, {"o2": 1, "swim": 3}]


def test_fits_of_many_groups_together_equal_single_ones():
    """Groups of uneven sizes, one without rows, one with dependent columns, one separated, filled up to the largest."""
    rnd = np.random.default_rng(5)
    sizes = np.array([40, 0, 33, 60, 25, 41])
    x, y, chosen = np.zeros((6, 60, 3)), np.zeros((6, 60)), np.zeros((6, 5, 60), bool)
    for g, n in enumerate(sizes):
        x[g, :n] = np.column_stack([np.ones(n), rnd.normal(size=(n, 2))])
        y[g, :n] = rnd.random(n) < 0.4
        chosen[g, :, :n] = rnd.random((5, n)) < 0.8
    x[2, :, 2] = x[2, :, 1]
    y[4, :25] = x[4, :25, 1] > 0
    got = numeric.grouped_logistic_fits(x, y, chosen)
    for g in (0, 2, 3, 4, 5):
        for r in range(5):
            one = numeric.logistic_fit(x[g][chosen[g, r]], y[g][chosen[g, r]])
            assert abs(got["llf"][g, r] - one["llf"]) < 1e-6 and got["separated"][g, r] == one["separated"] and got["n"][g, r] == chosen[g, r].sum()
            assert one["separated"] or np.allclose(x[g] @ got["params"][g, r], x[g] @ one["params"], atol=1e-5)
    assert np.isnan(got["llf"][1]).all() and got["separated"][4].all()
    pieces = jobs._alike(sizes, 90)
    assert sorted(np.concatenate(pieces).tolist()) == list(range(6)) and all(len(p) == 1 or len(p) * sizes[p].max() <= 90 for p in pieces)


def test_model_runs_by_hand(spark):
    """Each fit redone alone from its own draw; separated ones used all their tries; large groups give the same form."""
    df, rows = _model_bins(spark)
    got = jobs.model_runs(df.repartition(5), "fish", "cond", ["i"], "y", {"o2": "o2", "swim": "swim"}, _SPECS, 4, 7, 3, ["fish", "i"], ["o2"]).collect()
    ids = {(r.fish, r.i): r.h for r in df.select("fish", "i", F.xxhash64("fish", "i").alias("h")).collect()}
    assert len(got) == 3 * 4 * 3 * 2 and len({(r.spec_idx, r.run_idx, r.fish, r.cond) for r in got}) == len(got)
    series = {f: {i: (o, s) for g, _, i, o, s, _ in rows if g == f} for f in range(3)}
    for r in got:
        spec, x, y, h = _SPECS[r.spec_idx], [], [], []
        for f, c, i, *_, out in rows:
            back = max(max(spec.values()), 0)
            if f != r.fish or c != r.cond or any(i - k < 0 for k in spec.values()):
                continue
            assert back >= 0
            x.append([1.0, *[series[f][i - j][0] for j in range(spec.get("o2", 0), -1, -1) if "o2" in spec], *[series[f][i - j][1] for j in range(spec.get("swim", 0), 0, -1)]])
            y.append(float(out))
            h.append(ids[f, i])
        x, y, h = np.array(x), np.array(y), np.array(h, np.int64)
        keep = (y > 0) | (jobs._uniform(h, 7, r.run_idx, r.tries - 1) < jobs.NEGATIVES)
        if 0 < y[keep].sum() < keep.sum():
            want = numeric.logistic_fit(x[keep], y[keep])
            assert r.n == keep.sum() and r.separated == want["separated"]
            if not want["separated"]:
                assert np.allclose(r.params, want["params"], atol=1e-4) and math.isclose(r.llf, want["llf"], rel_tol=1e-6)
        else:
            assert r.llf is None and r.params is None
        assert r.tries == 3 if r.separated else 1 <= r.tries <= 3
    forced = [r for r in got if r.fish == 2 and "swim" in _SPECS[r.spec_idx] and r.cond == "h"]  # a bin of swimming comes before every positive
    assert forced and all(r.separated and r.tries == 3 for r in forced)
    some = jobs.model_runs(df, "fish", "cond", ["i"], "y", {"o2": "o2", "swim": "swim"}, _SPECS[:1], 2, 7, 2, ["fish", "i"], ["o2"], most=100).collect()
    assert len(some) == 2 * 3 * 2 and all(r.tries == (2 if r.separated else r.tries) for r in some)


def test_cluster_activity_and_places(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 12)) + 5
    label = [0] * 12 + [1] * 3 + [2] * 12 + [-1, -1, None]
    traces = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell int, trace array<double>").repartition(3)
    labels = spark.createDataFrame(list(enumerate(label)), "cell int, label int")
    centers = spark.createDataFrame([(i, float(i), 1.0, 2.0) for i in range(29)], "cell int, z double, x double, y double")
    activity, places = jobs.cluster_activity(traces, labels, "cell", centers, 10)
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    got = {r.label: r for r in activity.collect()}
    assert set(got) == {0, 2} and all(r.n == 12 for r in got.values())
    assert all(np.allclose(got[c].activity, z[[i for i in range(30) if label[i] == c]].mean(0)) for c in got)
    assert {(r.label, r.cell, r.z) for r in places.collect()} == {(label[i], i, float(i)) for i in range(30) if label[i] in (0, 2)}


def test_ratio_maps_are_written_with_their_settings(spark, tmp_path):
    fits = spark.createDataFrame([(i, s, False, b, 0.5) for i in range(6) for s, b in (("a", 1.0), ("b", 2.0 if i < 4 else 0.5))], "cell int, state string, skipped boolean, beta double, r2 double")
    centers = spark.createDataFrame([(i, i % 2, 3.0, 3.0, 3.0) for i in range(6)], "cell int, fish int, z double, x double, y double")
    raw = jobs.beta_ratios(fits, "cell", "a", "b", mode="raw")
    assert sorted(r.ratio for r in raw.collect()) == [0.5, 0.5, 2.0, 2.0, 2.0, 2.0]
    logged = jobs.beta_ratios(fits, "cell", "a", "b")
    jobs.export_ratio_map(logged, centers, ["cell"], str(tmp_path), (8, 8, 8), (1, 1, 1), 2, "positive", animal="fish")
    (made,) = spark.read.parquet(f"{tmp_path}/provenance").collect()
    assert (made.cells, made.animals, made.sign, made["mode"], made.least, made.radius, made.least_r2) == (4, 2, "positive", "log2", 2, [1, 1, 1], None)
    rows = spark.read.parquet(f"{tmp_path}/map").collect()
    whole = jobs.ratio_map(logged, centers, ["cell"], (8, 8, 8), (1, 1, 1), 2, "positive").collect()
    assert rows and sorted(rows) == sorted(whole)


def test_bouts_are_selected(spark):
    rows = [(1, 5.0, 9.0, 0.0), (2, 5.1, 9.0, 0.0), (3, 19.9, 3.0, 0.0), (4, 35.0, 3.1, 0.009), (5, 35.0, 4.0, 0.01), (6, 25.0, 9.0, 0.0), (7, 10.0, None, 0.0), (8, 39.0, 9.0, None)]
    got = jobs.select_bouts(spark.createDataFrame(rows, "bout int, onset double, gap_before double, oxygen_before double")).collect()
    assert {(r.bout, r.condition) for r in got} == {(2, "normal"), (4, "hypoxia")}


def test_baseline_clusters_and_refinement_find_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2, 64))
    rows = cells(spark, *[base[i % 2] + 0.2 * rng.normal(size=64) for i in range(40)])
    got = jobs.baseline_clusters(rows, "cell_id", 64, k=2, loading=0.6, least_cells=5)[0].collect()
    groups = [{r.label for r in got if r.cell_id % 2 == k} for k in (0, 1)]
    assert all(len(g) == 1 for g in groups) and groups[0] != groups[1] and None not in groups[0]
    refined = jobs.hierarchical_labels(rows, "cell_id", 64, k=2, share=0.2, noisy=2.0, factor_rounds=5).collect()
    assert len(refined) == 40 and all(len({r.label for r in refined if r.cell_id % 2 == k}) <= 2 for k in (0, 1))
    assert (models.noise_ratios(np.stack([np.sin(np.arange(300) / 40), (-1.0) ** np.arange(300)])) > [-1, 0.9]).all()


def test_subcluster_numbers_run_on_over_clusters(spark, sf):
    got = QUERIES["baseline_subclusters"](spark, sf).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.label, set()).add(r.sub)
    ordered = [sorted(spans[k]) for k in sorted(spans)]
    assert sum(ordered, []) == list(range(1, sum(map(len, ordered)) + 1))


def test_ward_labels_every_cell_of_a_group_above_its_sample(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2, 32))
    rows = [(i, "hot" if i < 500 else "small", (base[i % 2] + 0.2 * rng.normal(size=32)).tolist()) for i in range(530)]
    table = spark.createDataFrame(rows, "cell_id long, label string, trace array<double>")
    got = models.ward_groups(signals.zscore(table), "label", "cell_id", most=100, k=2).collect()
    assert sorted(r.cell_id for r in got) == list(range(530)) and {r.label for r in got if r.cell_id >= 500} == {"small"}
    for label in ("hot", "small"):
        even, odd = ({r.sub for r in got if r.label == label and r.cell_id % 2 == k} for k in (0, 1))
        assert len(even) == len(odd) == 1 and even | odd == {1, 2}
