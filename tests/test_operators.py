"""Operators on signals, populations, events, voxels, files and streams: closed forms, quirks and SQL twins."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracewell.kernels import numeric
from tracewell.operators import events, models, populations, signals, voxels
from tracewell.plans.queries import ORACLES, QUERIES
from tracewell.sources import files, sinks
from tracewell.streaming import live


def cells(spark, *traces):
    return spark.createDataFrame([(i, [float(x) for x in t]) for i, t in enumerate(traces)], "cell_id long, trace array<double>")


# every query against its SQL twin


SF = "/root/testdata/sf0.01"  # the size at which the driver compares


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu" or str(df[c].dtype).startswith("Int"):
            df[c] = df[c].astype(float).round(6) + 0.0
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = _plain(QUERIES[name](spark, SF).toPandas()), _plain(duck.execute(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry_lists_everything(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["cell_id", "r"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


# kernels


def test_average_ranks_share_ties():
    assert numeric.average_ranks([3.0, 1.0, 3.0, 2.0]).tolist() == [[3.5, 1.0, 3.5, 2.0]]


def test_rank_correlation_ignores_monotone_maps_and_flat_traces():
    x = np.random.default_rng(0).normal(size=(3, 40))
    a = numeric.rank_correlations(x, x)
    assert np.allclose(a, numeric.rank_correlations(np.exp(x), x**3)) and np.allclose(np.diag(a), 1)
    assert np.isnan(numeric.rank_correlations(np.ones(5), np.arange(5.0))).all()


def test_rank_correlations_on_a_threshold_are_on_it():
    """Without ties the correlation is rational: the nearest double to it, for every length, never beyond -1 or 1."""
    rnd = np.random.default_rng(4)
    for n in range(3, 120):
        a, b = np.stack([np.arange(n), np.arange(n)[::-1], *[rnd.permutation(n) for _ in range(4)]]).astype(float), np.arange(n, dtype=float)[None]
        want = [1 - Fraction(6 * int(((x - b[0]) ** 2).sum()), n * (n * n - 1)) for x in a]
        assert numeric.rank_correlations(a, b)[:, 0].tolist() == [float(w) for w in want]


def test_p_values_of_known_points():
    assert math.isclose(numeric.incomplete_beta(2, 3, 0.5), 0.6875) and math.isclose(numeric.incomplete_beta(0.5, 0.5, 0.5), 0.5)
    assert math.isclose(numeric.spearman_p(0.0, 20), 1.0) and numeric.spearman_p(1.0, 20) == 0.0
    assert math.isclose(numeric.f_p(1.0, 1, 1), 0.5)  # Cauchy squared
    assert math.isclose(numeric.spearman_p(0.5, 10), 0.14111, abs_tol=1e-4)


def test_low_pass_keeps_constants_and_removes_fast_changes():
    b, a = numeric.butterworth_low(5, 0.1)
    assert math.isclose(b.sum() / a.sum(), 1.0)
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * t / 200), np.sin(2 * np.pi * t / 4)
    out = numeric.zero_phase_low_pass(np.stack([slow + fast, np.full(400, 3.0)]), 0.06)
    assert np.abs(out[0] - slow)[40:-40].max() < 0.05 and np.allclose(out[1], 3)


def test_ward_finds_separate_clouds():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    labels = numeric.ward_labels(x, 3)
    assert len(set(labels)) == 3 and all(len(set(labels[i : i + 20])) == 1 for i in (0, 20, 40))
    assert len(set(numeric.ward_labels(x, 60))) == 60


def _ward_one_by_one(x, k):
    """The dearest way: every pair's growth of the sum of squares, one merge at a time."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        means, sizes = np.array([x[g].mean(0) for g in groups]), np.array([len(g) for g in groups])
        cost = np.square(means[:, None] - means).sum(2) * sizes[:, None] * sizes / (sizes[:, None] + sizes)
        cost[np.tril_indices(len(groups))] = np.inf
        i, j = divmod(int(cost.argmin()), len(groups))
        groups[i] = sorted(groups[i] + groups.pop(j))
    labels = np.zeros(len(x), int)
    for at, g in enumerate(sorted(groups)):
        labels[g] = at + 1
    return labels


@pytest.mark.parametrize(("n", "t", "k"), [(1, 3, 1), (2, 3, 5), (90, 5, 7), (70, 200, 4), (120, 2, 1)])
def test_ward_equals_one_merge_at_a_time(n, t, k):
    x = np.random.default_rng(n).normal(size=(n, t))
    assert numeric.ward_labels(x, k).tolist() == _ward_one_by_one(x, k).tolist()


def test_ward_of_correlation_rows_equals_that_of_the_matrix():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 40))[rng.integers(0, 6, 150)] + rng.normal(size=(150, 40))
    x = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True) / np.sqrt(40)
    points = numeric.correlation_rows(x)
    whole = x @ x.T
    gaps = lambda a: np.square(a[:, None] - a).sum(2)
    assert points.shape == (150, 40) and np.allclose(gaps(points), gaps(whole))
    assert numeric.ward_labels(points, 6).tolist() == _ward_one_by_one(whole, 6).tolist()
    same = np.repeat(points[:3], 20, 0)  # equal rows
    assert [len(set(numeric.ward_labels(same, 3)[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1]


def test_logistic_fit_equals_grouped_odds():
    x = np.column_stack([np.ones(8), [0, 0, 0, 0, 1, 1, 1, 1]])
    got = numeric.logistic_fit(x, np.array([0, 0, 0, 1, 0, 1, 1, 1.0]))
    assert np.allclose(got["params"], [math.log(1 / 3), 2 * math.log(3)], atol=1e-6) and not got["separated"]
    assert numeric.logistic_fit(x, x[:, 1])["separated"]
    assert math.isclose(got["aic"], 4 - 2 * got["llf"])


def test_sliding_rank_mirrors_and_runs_on():
    x = np.arange(40.0)
    assert (numeric.sliding_rank(np.full(17, 2.0), 6, 20, 3) == 2).all()
    got = numeric.sliding_rank(x, 4, 25, 10)
    assert len(got) == 40 and np.allclose(np.diff(got[30:]), got[21] - got[20])
    brute = [sorted(x[min(max(-1 - j, j), 79 - j)] if not 0 <= j < 40 else x[j] for j in range(i - 5, i + 5))[2] for i in range(40)]
    assert np.allclose(numeric.sliding_rank(x, 10, 20), brute)


def test_varimax_is_a_rotation():
    turn = numeric.varimax(np.random.default_rng(2).normal(size=(50, 4)))
    assert np.allclose(turn @ turn.T, np.eye(4))


# quirks


def test_validity_variants_differ(spark):
    odd = cells(spark, [1, 2], [1, math.nan], [1, math.inf], [1, 11])
    rows = odd.select(signals.valid_bounded("trace").alias("a"), (~signals.has_nan("trace")).alias("b"), signals.valid_finite("trace").alias("c")).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (False, False, False), (False, True, False), (False, True, True)]


def test_flat_cells_give_nulls_not_errors(spark):
    flat = cells(spark, [2, 2, 2, 2], [1, 2, 3, 4])
    assert [r.z for r in signals.zscore(flat).orderBy("cell_id").collect()][0] == [None] * 4
    (a,), (b,) = [r.r for r in signals.rank_correlation(flat, np.arange(4.0)).orderBy("cell_id").collect()]
    assert a is None and math.isclose(b, 1.0)
    fits = {r.cell_id: r for r in models.ridge_scan(flat, "cell_id", np.array([1.0, 0, 2, 1]), lags=(1, 2)).collect()}
    assert fits[0].r2 is None and fits[1].r2 is not None


def test_ridge_scan_equals_direct_solution_and_prefers_fewer_lags(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60)
    y = 2 * x + np.r_[0, x[:-1]] + 5
    (fit,) = models.ridge_scan(cells(spark, y), "cell_id", x, lags=(2, 3), strength=1e-9).collect()
    assert fit.lags == 2 and math.isclose(fit.beta, math.sqrt(5), rel_tol=1e-5) and math.isclose(fit.intercept, 5, rel_tol=1e-5)
    assert np.allclose(np.array(fit.kernel) * fit.beta, [2, 1], atol=1e-4)


def test_edges_are_strict(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, 3.8, 4.0, 3.0, 4.0])], "k int, i int, v double")
    assert [r.i for r in signals.rising_edges(rows, ["k"], ["i"], "v").collect()] == [4]


def test_bouts_at_the_ends_and_single_bursts_go(spark):
    active = [1, 1, 0, 0, 0, 1, 0, 1, 0, 0, 0, 1]
    rows = spark.createDataFrame([(1, i, bool(v)) for i, v in enumerate(active)], "k int, i int, on boolean")
    got = events.bout_features(rows, ["k"], ["i"], F.col("on"), 2).collect()
    assert [(r.start, r.end, r.duration) for r in got] == [(5, 7, 3.0)]
    times = spark.createDataFrame([(1, t) for t in (0, 600, 1201, 1300, 5000)], "k int, t long")
    assert sorted((r.start, r.end) for r in events.sessions(times, ["k"], "t", "t", 600).collect()) == [(0, 600), (1201, 1300)]


def test_event_windows_equal_a_nested_loop(spark):
    rng = np.random.default_rng(4)
    on, at = sorted(set(rng.integers(0, 5000, 40).tolist())), sorted(set(rng.integers(0, 5000, 400).tolist()))
    got = events.event_windows(spark.createDataFrame([(1, o) for o in on], "k int, o long"), spark.createDataFrame([(1, t) for t in at], "k int, t long"), ["k"], "o", "t", 100, 300)
    assert sorted((r.o, r.t) for r in got.collect()) == sorted((o, t) for o in on for t in at if o - 100 <= t < o + 300)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_interpolation_clamps_and_shifts_its_origin(spark):
    curve = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 40.0)], "sec int, value double")
    times = spark.createDataFrame([(t,) for t in (0.0, 1.0, 1.5, 2.25, 3.0, 9.0)], "t double")
    got = {r.t: r.curve for r in signals.interpolate_curve(times, "t", curve).collect()}
    assert got == {0.0: 10, 1.0: 10, 1.5: 15, 2.25: 25, 3.0: 40, 9.0: 40}


def test_reference_bins_are_open(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, -0.95, -0.8, -0.75, 0.0, 0.05, 0.8, 0.85, 1.0)], "r double")
    assert [r[0] for r in rows.select(populations.reference_bin(F.col("r"))).collect()] == [None, 0, None, 1, None, 9, None, 17, None]


def test_box_map_is_half_open_and_rounds_half_to_even(spark):
    points = spark.createDataFrame([(2.5, 3.5, 4.0, 1.0)] * 10, "z double, y double, x double, v double")
    got = voxels.box_map(points, ["z", "y", "x"], "v", (1, 1, 1), (9, 9, 9), 10).collect()
    assert sorted((r.z, r.y, r.x) for r in got) == [(z, y, x) for z in (1, 2) for y in (3, 4) for x in (3, 4)]
    assert voxels.box_map(points.limit(9), ["z", "y", "x"], "v", (1, 1, 1), (9, 9, 9), 10).count() == 0


def test_null_keys_group_and_nan_is_skipped(spark):
    rows = spark.createDataFrame([(None, 1, 2.0), (None, 2, math.nan), ("a", 1, 4.0), ("a", 2, 6.0)], "c string, fish int, v double")
    got = {r.c: (r.mean, r.units) for r in populations.mean_of_means(rows, ["c"], "fish", "v").collect()}
    assert got == {None: (2.0, 1), "a": (5.0, 2)}


def test_seed_needs_one_dominant_score(spark):
    rows = cells(spark, [0.1, -1.0, 0.2], [1.0, 0.5, 0.0])
    assert [(r.component, r.sign, r.seed) for r in populations.seed_groups(rows, "trace").orderBy("cell_id").collect()] == [(1, -1, True), (0, 1, False)]


def test_factors_recover_two_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2, 64))
    rows = cells(spark, *[base[i % 2] + 0.2 * rng.normal(size=64) for i in range(40)])
    labelled = models.loading_labels(models.factor_loadings(rows, "cell_id", 64, 2), "cell_id").collect()
    groups = [{r.label for r in labelled if r.cell_id % 2 == k} for k in (0, 1)]
    assert all(len(g) == 1 for g in groups) and groups[0] != groups[1]


# files and streams


def test_array_and_channel_files(spark, tmp_path):
    files.register(spark)
    x = np.arange(12.0).reshape(4, 3)
    np.savez(tmp_path / "a.npz", dFF=x)
    np.save(tmp_path / "b.npy", x[:, 0])
    got = spark.read.format("npy").option("path", str(tmp_path / "a.npz")).option("key", "dFF").option("rows", 3).load().orderBy("row").collect()
    assert [r["values"] for r in got] == x.tolist()
    assert spark.read.format("npy").option("path", str(tmp_path / "b.npy")).load().count() == 4
    np.arange(11, dtype=np.float32).tofile(tmp_path / "c.5chFlt")
    rows = spark.read.format("chflt").option("path", str(tmp_path / "c.5chFlt")).load().collect()
    assert sorted((r.channel, r.sample_idx, r.value) for r in rows if r.channel in ("swim1", "visualInput2")) == [("swim1", 0, 0.0), ("swim1", 1, 5.0), ("visualInput2", 0, 4.0), ("visualInput2", 1, 9.0)]


def test_text_files(spark, tmp_path):
    (tmp_path / "list.csv").write_text("recording_id,cohort,dir,save_root,registration_root\n0,n,a,b,None\n1,n,a,b,c\n2,g,a,b,\n")
    catalog = files.read_catalog(spark, str(tmp_path / "list.csv"))
    assert [r.registration_root for r in catalog.orderBy("recording_id").collect()] == [None, "c", None]
    assert files.select_recordings(catalog, 1, 1).count() == 1
    (tmp_path / "m.txt").write_text("1 0 0 2\n0 1  0 3\n")
    assert [r["values"] for r in files.read_matrix(spark, str(tmp_path / "m.txt")).orderBy("row").collect()] == [[1, 0, 0, 2], [0, 1, 0, 3]]
    (tmp_path / "p.xml").write_text("<r><epoch><gain>1</gain><name>x</name></epoch><epoch><gain>0.5</gain><name>3</name></epoch></r>")
    assert sorted((r.epoch_idx, r.field, r.value) for r in files.read_epochs(spark, str(tmp_path / "p.xml")).collect()) == [(0, "gain", 1.0), (1, "gain", 0.5)]


def test_manifest_skips_finished(spark, tmp_path):
    catalog = spark.createDataFrame([(0,), (1,)], "recording_id int")
    path = str(tmp_path / "manifest")
    assert sinks.pending(spark, catalog, path, "r1").count() == 2
    sinks.mark_done(catalog.limit(1), path, "r1")
    assert sinks.pending(spark, catalog, path, "r1").count() == 1
    assert sinks.pending(spark, catalog, path, "r2").count() == 2 and sinks.pending(spark, catalog, path, "r1", force=True).count() == 2


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [Row(k=i % 2, t=(pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=90 * i * (1 + (i > 20)))).to_pydatetime(), v=float(i)) for i in range(40)]
    spark.createDataFrame(rows, "k int, t timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp, v double").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    for i, f in enumerate((live.tumbling_means, lambda d, *a: live.burst_sessions(d, "k", "t", "200 milliseconds"))):
        query = f(stream, "k", "t", "v").writeStream.outputMode("append" if i else "complete").format("memory").queryName(f"out{i}").start()
        query.processAllAvailable()
        query.stop()
        got = spark.table(f"out{i}").collect()
        want = f(batch, "k", "t", "v").collect()
        assert set(map(tuple, got)) <= set(map(tuple, want)) and (i or len(got) == len(want))
