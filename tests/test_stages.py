"""Stages over a catalog of recordings, and movies turned into traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.__main__ import main
from tracewell.kernels import numeric
from tracewell.operators import layout, signals
from tracewell.plans import stages
from tracewell.plans.stages import Stage


@pytest.mark.parametrize("task_bytes", [1, 300, 1 << 20])
def test_frames_to_cells_equals_transposition(spark, task_bytes):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(37, 11))
    x[5], x[8, 9:], x[9, 3] = np.nan, np.nan, np.nan
    rows = [(i, None if i == 5 else x[i, : 9 if i == 8 else 11].tolist()) for i in range(37) if i != 20]
    rows[9] = (9, [None if c == 3 else float(v) for c, v in enumerate(x[9])])
    x[20] = np.nan  # this frame is missing
    movie = spark.createDataFrame([*rows, (None, [1.0])], "row long, values array<double>").withColumn("cell", F.lit("clash")).repartition(5)
    got = sorted(layout.frames_to_cells(movie, task_bytes=task_bytes).collect())
    assert [r.cell for r in got] == list(range(11)) and np.array_equal(np.array([r.trace for r in got]), x.T, equal_nan=True)


def test_frames_to_cells_of_odd_movies(spark):
    empty = spark.createDataFrame([], "row long, values array<float>")
    assert layout.frames_to_cells(empty).collect() == []
    assert layout.frames_to_cells(spark.createDataFrame([(0, []), (1, None)], "row long, values array<float>")).collect() == []
    twice = spark.createDataFrame([(0, [1.0]), (0, [2.0])], "row long, values array<float>")
    with pytest.raises(Exception, match="twice"):
        layout.frames_to_cells(twice).collect()


def _catalog(tmp_path, count):
    lines = ["recording_id,cohort,dir,save_root,registration_root", *[f"{k},a,d,{tmp_path}/rec{k},None" for k in range(count)]]
    (tmp_path / "list.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "list.csv")


def _states(report, recording=0):
    return {stage: state for r, stage, state in report if r == recording}


def test_only_what_depends_on_a_change_runs_again(spark, tmp_path):
    ran = []

    def scaled(source, by):
        ran.append(("scaled", by))
        return source.select("cell", (F.col("v") * by).alias("v"))

    def total(scaled, other):
        ran.append(("total",))
        return scaled.join(other, "cell").agg(F.sum("v").alias("v"))

    def failing(source):
        if source.filter("v = 13").count():
            raise ValueError("thirteen")
        return source

    graph = {
        "scaled": Stage(scaled, ("source",), {"by": 2}),
        "other": Stage(lambda source: source.select("cell"), ("source",)),
        "total": Stage(total, ("scaled", "other")),
        "late": Stage(lambda total, curve: total, ("total",), {"curve": None}, ("curve",)),
        "failing": Stage(failing, ("source",)),
    }
    for k, v in enumerate((1.0, 13.0)):
        spark.createDataFrame([(0, v), (1, 2.0)], "cell int, v double").coalesce(1).write.parquet(f"{tmp_path}/rec{k}/source.parquet")
    catalog, out = _catalog(tmp_path, 3), f"{tmp_path}/out/"
    run = lambda which=("total",), force=False, last=0, **settings: stages.run_catalog(spark, catalog, out, which, settings, last=last, force=force, graph=graph)
    assert _states(run()) == {"scaled": "ran", "other": "ran", "total": "ran"}
    assert _states(run()) == {"scaled": "kept", "other": "kept", "total": "kept"}
    assert _states(run(scaled={"by": 5})) == {"scaled": "ran", "other": "kept", "total": "ran"}
    assert stages.results(spark, out, "total").first().asDict() == {"v": 15.0, "recording_id": 0}
    ran.clear()
    assert _states(run(scaled={"by": 2})) == {"scaled": "kept", "other": "kept", "total": "kept"} and not ran
    assert stages.results(spark, out, "total").first().v == 6.0  # the earlier result holds again
    assert _states(run(("scaled",), force=True)) == {"scaled": "ran"}
    assert _states(run()) == {"scaled": "kept", "other": "kept", "total": "ran"}
    spark.createDataFrame([(0, 7.0), (1, 2.0)], "cell int, v double").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/rec0/source.parquet")
    assert set(_states(run()).values()) == {"ran"} and stages.results(spark, out, "total").first().v == 18.0
    assert _states(run(("late",)))["late"] == "lacks late.curve"
    (tmp_path / "curve").write_text("1")
    curve = {"late": {"curve": f"{tmp_path}/curve"}}
    assert [_states(run(("late",), **curve))["late"] for _ in range(2)] == ["ran", "kept"]
    (tmp_path / "curve").write_text("12")
    assert _states(run(("late",), **curve))["late"] == "ran"
    both = run(last=2)
    assert _states(both, 1)["total"] == "ran" and _states(both, 2) == {"scaled": "lacks source", "other": "lacks source", "total": "lacks scaled, other"}
    assert {r.recording_id: r.v for r in stages.results(spark, out, "total").collect()} == {0: 18.0, 1: 30.0}
    with pytest.raises(ExceptionGroup) as fault:
        run(("failing",), last=2)
    assert "thirteen" in str(fault.value.exceptions[0]) and stages.results(spark, out, "failing").count() == 2  # recording 0 went through
    for wrong in ({"which": ("none",)}, {"scaled": {"none": 1}}, {"none": {"by": 1}}):
        with pytest.raises(ValueError):
            run(**wrong)


def test_from_movie_to_map_by_one_command(spark, tmp_path):
    """Frame-major fluorescence, footprints and channel samples in; flags, fits, map, clusters and activity out."""
    rng = np.random.default_rng(3)
    frames, cells, step = 300, 12, 60
    swim = np.where(rng.random(frames) < 0.4, rng.gamma(2, 1, frames), 0)
    slow = np.sin(np.arange(frames) / 40)
    movie = 100 + 40 * slow[:, None] * np.where(np.arange(cells) % 2, -1, 1) + 5 * np.stack([np.convolve(np.sqrt(np.maximum(swim - np.percentile(swim, 70), 0)), [0, 1, 0.5])[:frames]] * cells, 1)
    movie += rng.normal(size=movie.shape) * 0.3
    movie[7, 11] = np.nan
    root = tmp_path / "rec0"
    spark.createDataFrame([(i, (v + 5).tolist(), 15.0) for i, v in enumerate(movie)], "row long, values array<double>, background double").write.parquet(f"{root}/raw.parquet")
    spark.createDataFrame([(c, float(5 + c % 3 + d), 6.0, 7.0, 1.0) for c in range(cells) for d in (-1, 1)], "cell long, z double, x double, y double, weight double").write.parquet(f"{root}/footprints.parquet")
    samples = [(i, float(swim[i // step - 1]) / step if i >= step else 0.0, 0.0, 5.0 if i % step == 0 and i else 0.0) for i in range(step * (frames + 1))]
    spark.createDataFrame(samples, "sample_idx long, signal double, background double, camera double").write.parquet(f"{root}/samples.parquet")
    (tmp_path / "o2.csv").write_text("sec,value\n" + "\n".join(f"{t},{np.sin(t / 40 - 0.025)}" for t in range(1, 303)) + "\n")
    sets = {"frames.rate": 60, "cells.window": 60, "cells.step": 2, "baseline_clusters.components": 2, "baseline_clusters.least_cells": 1, "oxygen.start": 0, "oxygen.end": 400, "flags.most_p": 0.01,
            "swim_fits.states": '{"normoxia": [10, 140], "hypoxia": [150, 290]}', "swim_fits.lags": "[2, 4]", "map.size": "[16, 16, 16]", "map.least": 1, "clusters.k": 2, "clusters.noisy": 2, "clusters.share": 0.9, "activity.least": 1,
            "subcluster_activity.least": 1, "subcluster_places.least": 1, "subcluster_oxygen.start": 0, "subcluster_oxygen.end": 280}
    call = ["run", "--catalog", _catalog(tmp_path, 1), "--out", f"{tmp_path}/out", "--oxygen-file", f"{tmp_path}/o2.csv", *[x for k, v in sets.items() for x in ("--set", f"{k}={v}")]]
    first = _states(main(call))
    assert first == dict.fromkeys(stages.GRAPH, "ran")
    read = lambda stage: stages.results(spark, f"{tmp_path}/out", stage)
    own = {r.cell: (r.trace, r.baseline) for r in read("cells").collect()}
    want = signals.percentile_baseline(spark.createDataFrame([(0, movie[:, 0].tolist())], "cell long, trace array<double>"), window=60, step=2).first().baseline
    assert np.allclose(own[0][1], want) and np.allclose(own[0][0], movie[:, 0] / want - 1)
    seen = sorted(read("frames").collect(), key=lambda r: r.frame)
    assert np.allclose([r.sec for r in seen], np.arange(1, frames + 1))
    flags = {r.cell: (r.invalid, r.explained, r.active) for r in read("flags").collect()}
    assert flags[11] == (True, None, None) and len(flags) == cells
    active = {c for c, f in flags.items() if f == (False, True, True)}
    fits = read("swim_fits").collect()
    assert active and {r.cell for r in fits} == active and {r.state for r in fits} == {"normoxia", "hypoxia"}
    assert {r.cell for r in read("ratios").collect()} <= active and read("map").count() > 0
    assert {r.cell for r in read("clusters").collect()} == set(range(11))
    subs = read("subclusters").collect()
    assert len({(r.cluster, r["sub"]) for r in subs}) == len({r.cluster for r in subs})  # under 200 cells: whole
    assert sum(r.n for r in read("activity").collect()) == len(subs) == read("subcluster_places").count()
    curve, seconds = np.array([np.sin(t / 40 - 0.025) for t in range(1, 303)]), np.arange(1, frames + 1)
    inside = (seconds > 0) & (seconds < 280)
    held = {r.label: np.array(r.activity) for r in read("subcluster_activity").collect()}
    for r in read("subcluster_oxygen").collect():
        want = numeric.rank_correlations(held[r.label][None, inside], curve[None, :frames][:, inside])[0, 0]
        assert np.isclose(r.r, want) and np.isclose(r.p, numeric.spearman_p(want, inside.sum()))
    assert len(held) == read("subcluster_oxygen").count() > 0
    again = _states(main([*call, "--set", "map.least=2"]))
    assert {s for s, state in again.items() if state == "ran"} == {"map"}
    fewer = _states(main([*call, "--stages", "map", "--set", "flags.mean=1"]))
    assert {s for s, state in fewer.items() if state == "ran"} == {"flags", "swim_fits", "ratios", "map"} and "clusters" not in fewer
