"""Scans of one signal in blocks: equal to the whole windows, with no block larger than asked for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import events, scans, signals


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    made = []
    for key in (None, "a", "b"):
        for i in range({None: 37, "a": 400, "b": 1}[key]):
            v = rnd.choice([0.0, 0.0, 1.0, rnd.random() * 5, None])
            made.append((key, i * 3, i, v))
    return spark.createDataFrame(made, "k string, t int, tie int, v double").repartition(5).cache()


def _same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    f = lambda d: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in columns)) for r in d.collect()], key=str)
    assert f(a) == f(b) and a.count()


ORDER = ["t", "tie"]
CASES = {
    "rolling": lambda d, k, b: signals.rolling(d, k, ORDER, "v", 7, block=b),
    "rolling_wide": lambda d, k, b: signals.rolling(d, k, ORDER, "v", 40, block=b),
    "rolling_quantile": lambda d, k, b: signals.rolling(d, k, ORDER, "v", 6, 0.3, block=b),
    "trailing_sum": lambda d, k, b: signals.trailing_sum(d, k, ORDER, "v", 25, block=b),
    "lag_design": lambda d, k, b: signals.lag_design(d, k, ORDER, "v", 4, block=b),
    "rising_edges": lambda d, k, b: signals.rising_edges(d, k, ORDER, "v", 0.5, block=b),
    "local_maxima": lambda d, k, b: signals.local_maxima(d, k, ORDER, "v", block=b),
    "gap_fill": lambda d, k, b: signals.gap_fill(d, k, "t", "v", block=b),
    "first_difference": lambda d, k, b: signals.first_difference(d, k, ORDER, "v", block=b),
    "least_step": lambda d, k, b: signals.least_step(d, k, ORDER, "t", block=b),
    "turns": lambda d, k, b: signals.turns(d, k, ORDER, "v", block=b),
    "find_runs": lambda d, k, b: events.find_runs(d, k, ORDER, F.col("v") > 0.5, block=b),
    "bout_features": lambda d, k, b: events.bout_features(d, k, ORDER, F.coalesce(F.col("v") > 0.5, F.lit(False)), 2, block=b),
    "sessions": lambda d, k, b: events.sessions(d.filter("v > 0"), k, "t", "tie", 5, block=b),
    "run_spans": lambda d, k, b: events.run_spans(d, k, ORDER, "t", F.col("v") > 0.5, block=b),
    "burst_bouts": lambda d, k, b: events.burst_bouts(d.withColumn("v", F.coalesce("v", F.lit(0.0)) / 60), ["k"], "tie", "v", 40, 1e-3, gap=12, rows=b),
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize(("keys", "block"), [(["k"], 9), ([], 50)])
def test_blocks_equal_whole_windows(rows, name, keys, block):
    df = rows.filter("k = 'a'") if not keys else rows.filter("k is not null") if name in ("bout_features", "burst_bouts") else rows
    _same(CASES[name](df, keys, block), CASES[name](df, keys, None))


@pytest.mark.parametrize("block", [None, 7])
def test_interpolation_between_any_knots(spark, block):
    """Against numpy, with uneven knots, equal times, one knot, none, and every way beyond the ends."""
    rnd = random.Random(2)
    ts = sorted(rnd.choice([rnd.random(), 50 + rnd.random() * 1e-3, rnd.random() * 100]) for _ in range(60))
    vs = [rnd.random() for _ in ts]
    curve = spark.createDataFrame([("a", t, v) for t, v in zip(ts, vs, strict=True)] + [("a", ts[3], vs[3] - 1), ("b", 5.0, 2.0), ("a", None, 1.0), ("a", 1.0, None)], "k string, t double, v double")
    at = [-3.0, ts[0], ts[3], ts[-1], 120.0, *[rnd.random() * 100 for _ in range(80)]]
    rows = [("a", i, t) for i, t in enumerate(at)] + [("b", 900, 1.0), ("b", 901, 5.0), ("c", 902, 1.0), ("a", 903, None)]
    df = spark.createDataFrame(rows, "k string, t int, at double").repartition(3)
    run = lambda how: {r.t: r.curve for r in signals.interpolate_at(df, ["k"], "at", curve, beyond=how, block=block).collect()}
    held, left, on = run("clamp"), run("leave"), run("extrapolate")
    assert len(held) == len(rows) and held[900] == held[901] == 2.0 == on[900] and held[902] is None is held[903]
    assert all(abs(held[i] - float(np.interp(t, ts, vs))) < 1e-9 for i, t in enumerate(at))
    assert set(left) == {i for i, t in enumerate(at) if ts[0] <= t <= ts[-1]} | {901} and all(left[i] == held[i] for i in left)
    assert abs(on[0] - (vs[0] + (vs[1] - vs[0]) / (ts[1] - ts[0]) * (-3 - ts[0]))) < 1e-6 and abs(on[4] - (vs[-1] + (vs[-1] - vs[-2]) / (ts[-1] - ts[-2]) * (120 - ts[-1]))) < 1e-6
    with pytest.raises(Exception, match="beyond the curve"):
        run("error")


def test_one_long_signal_is_dealt_out(spark):
    """A million rows: blocks and halos are what is asked for, and sums that whole windows would give."""
    n, block = 1_000_000, 50_000
    df = spark.range(0, n, 1, 8).select(((F.col("id") * 7919) % n).alias("t"), F.lit(1.0).alias("v"))
    placed = scans.number_rows(df, [], ["t"])
    assert placed.filter("place <> t").count() == 0
    seen = scans.with_halo(placed, "place", 30, 10, block).groupBy("__b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__b") == F.col("__home")).alias("own")).collect()
    assert sum(r.own > 0 for r in seen) == n // block and max(r.n for r in seen) == block + 40
    total = scans.running(placed, [], "place", {"s": ("sum", F.col("v"))}, block)
    assert total.filter("s <> place + 1").count() == 0
    runs = events.find_runs(df, [], ["t"], F.floor(F.col("t") / 300_000), block=block)
    assert sorted((r.start, r.end) for r in runs.collect()) == [(0, 299_999), (300_000, 599_999), (600_000, 899_999), (900_000, 999_999)]


def _frames(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("block", [None, 1 << 16])
@pytest.mark.parametrize("beyond", ["clamp", "extrapolate"])
def test_interpolation_of_long_curves_takes_one_pass(spark, block, beyond):
    """No frame runs to its partition's end, which Spark would work out anew for every row; one key of 40,000 rows and 100 knots."""
    knots = spark.range(100).select(F.lit("a").alias("k"), (F.col("id") * 400).cast("double").alias("t"), (F.col("id") % 7).cast("double").alias("v"))
    df = spark.range(40_000).select(F.lit("a").alias("k"), F.col("id"), F.col("id").cast("double").alias("at"))
    got = signals.interpolate_at(df, ["k"], "at", knots, beyond=beyond, block=block)
    assert "unboundedfollowing" not in _frames(got)
    inside = {r.id: r.curve for r in got.filter("id <= 39600").collect()}
    want = np.interp(np.arange(39_601), np.arange(100) * 400, np.arange(100) % 7)
    assert len(inside) == 39_601 and max(abs(inside[i] - want[i]) for i in inside) < 1e-9


@pytest.mark.parametrize("block", [None, 1 << 16])
def test_gap_filling_of_long_signals_takes_one_pass(spark, block):
    """No frame runs to its partition's end; 40,000 rows, nine of ten unknown, every position twice."""
    rows = spark.range(40_000).select(F.lit("a").alias("k"), "id", F.floor(F.col("id") / 2).alias("p"), F.when(F.col("id") % 20 == 6, (F.col("id") % 17).cast("double")).alias("v"))
    got = signals.gap_fill(rows, ["k"], "p", "v", block=block)
    assert "unboundedfollowing" not in _frames(got)
    known = [i for i in range(40_000) if i % 20 == 6]
    filled = {r.id: r.filled for r in got.collect()}
    want = np.interp(np.arange(40_000) // 2, [i // 2 for i in known], [i % 17 for i in known])
    assert len(filled) == 40_000 and max(abs(filled[i] - want[i]) for i in filled) < 1e-9
