"""A recording's whole analysis as stages, each with the tables it needs and its settings.

A table that lies in the recording's folder (``save_root/<name>.parquet``) is taken as given; others are made by the
stage of their name. Every result has an identity, a digest of the stage, its settings and the identities of what it
needs, and is written below ``<out>/<stage>/recording_id=<id>/``; a manifest by recording tells what is finished. So a
changed setting, or a changed file, runs again just what depends on it, and a run that was cut off goes on where it
stopped. Results of earlier settings are kept and found again; those that no manifest row names may be removed.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import layout, models, populations, signals, voxels
from tracewell.plans import jobs, recording_jobs
from tracewell.session import materialize
from tracewell.sources import files

MANIFEST = "stage string, key string, result string, settings string, at double"


@dataclass(frozen=True)
class Stage:
    """``make(**tables, **settings)`` gives the table; settings that are None must be given by the caller, those in ``paths``
    name files, whose state counts; ``version`` changes with what the stage computes."""

    make: Callable[..., DataFrame]
    needs: Sequence[str] = ()
    settings: Mapping[str, Any] = field(default_factory=dict)
    paths: Sequence[str] = ()
    version: int = 1


def _cells(raw: DataFrame, window: int, percentile: int, step: int) -> DataFrame:
    """(cell, trace, baseline): dF/F and the sliding baseline of frame-major fluorescence (row, values, background); the
    background counts as far as it exceeds 10, and what is below it is 0."""
    shift = F.coalesce(F.col("background") - 10, F.lit(0.0)) if "background" in raw.columns else F.lit(0.0)
    above = raw.select("row", F.transform("values", lambda v: F.when(v.isNotNull(), F.greatest(v.cast("double") - shift, F.lit(0.0)))).alias("values"))
    based = materialize(signals.percentile_baseline(layout.frames_to_cells(above), window=window, percentile=percentile, step=step), "baselines")
    change = F.transform(signals.delta_f(F.col("trace"), F.col("baseline")), lambda v: F.coalesce(v, F.lit(float("nan"))))
    return based.select("cell", change.alias("trace"), "baseline")


def _frames(samples: DataFrame, level: float, rate: float) -> DataFrame:
    """(frame, sec, swim) from a recording's samples (sample_idx, signal, background, camera)."""
    one = samples.withColumn("recording", F.lit(0))
    triggers = materialize(jobs.camera_triggers(one, ["recording"], "sample_idx", "camera", level), "triggers")
    swim = jobs.swim_by_frame(one, triggers, "recording", "sample_idx", "signal", "background")
    return triggers.join(swim, ["recording", "frame"]).select("frame", (F.col("sample_idx") / rate).alias("sec"), F.coalesce("swim", F.lit(0.0)).alias("swim"))


def _with_baseline(cells: DataFrame) -> DataFrame:
    """Valid cells (no NaN in the trace) by their baseline, or by the trace where a recording has none."""
    return cells.filter(~signals.has_nan("trace")).select("cell", F.col("baseline" if "baseline" in cells.columns else "trace").alias("trace"))


def _length(cells: DataFrame) -> int:
    """Frames of a trace; 0 where there is no cell."""
    found = cells.select(F.size("trace")).first()
    return found[0] if found else 0


def _baseline_clusters(cells: DataFrame, components: int, explained: float, **settings) -> DataFrame:
    own = materialize(_with_baseline(cells), "valid")
    if not (n := _length(own)):
        return own.select("cell", F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("best_r"), F.lit(None).cast("double").alias("explained"))
    return jobs.baseline_clusters(own, "cell", n, min(components, n), least_explained=explained, **settings)[0]


def _against_oxygen(rows: DataFrame, key: str, frames: DataFrame, curve: str, start: float, end: float) -> DataFrame:
    """Rows of (key, trace) with r and p against a CSV curve of sec, value."""
    one = materialize(rows.withColumn("recording", F.lit(0)), "traces")
    times = frames.groupBy(F.lit(0).alias("recording")).agg(F.sort_array(F.collect_list(F.struct("frame", "sec"))).alias("f")).select("recording", F.col("f.sec").alias("sec"))
    knots = rows.sparkSession.read.schema("sec int, value double").csv(curve, header=True)
    return jobs.oxygen_correlations(one, times, knots, key, "recording", start, end)


def _oxygen(cells: DataFrame, frames: DataFrame, **settings) -> DataFrame:
    """(cell, mean, std, r, p) of valid cells."""
    return _against_oxygen(signals.with_moments(_with_baseline(cells)), "cell", frames, **settings).select("cell", "mean", "std", "r", "p")


def _subcluster_oxygen(subcluster_activity: DataFrame, frames: DataFrame, **settings) -> DataFrame:
    """(label, n, r, p) of the subclusters' mean traces."""
    return _against_oxygen(subcluster_activity.withColumnRenamed("activity", "trace"), "label", frames, **settings).select("label", "n", "r", "p")


def _flags(cells: DataFrame, baseline_clusters: DataFrame, oxygen: DataFrame, explained: float, **least) -> DataFrame:
    """(cell, invalid, explained, active): the masks, null where an earlier one left the cell out."""
    active = populations.active_cells(oxygen, **least).select("cell", F.lit(True).alias("__a"))
    met = cells.select("cell", signals.has_nan("trace").alias("invalid")).join(baseline_clusters.select("cell", F.col("explained").alias("__e")), "cell", "left").join(active, "cell", "left")
    known = F.when(~F.col("invalid"), F.coalesce(F.col("__e") > explained, F.lit(False)))
    return met.select("cell", "invalid", known.alias("explained"), F.when(known, F.coalesce("__a", F.lit(False))).alias("active"))


def _swim_fits(cells: DataFrame, flags: DataFrame, frames: DataFrame, states: Mapping[str, Sequence[float]], lags: Sequence[int], least: float) -> DataFrame:
    own, sec, swim = recording_jobs.recording_inputs(cells.select("cell", "trace"), flags, frames)
    return jobs.swim_fits(own, "cell", swim, recording_jobs.state_frames(sec, states), lags, least)


def _map(ratios: DataFrame, centers: DataFrame, size: Sequence[int], radius: Sequence[int], least: int, sign: str) -> DataFrame:
    return jobs.ratio_map(ratios, centers, ["cell"], size, radius, least, sign)


def _clusters(cells: DataFrame, **settings) -> DataFrame:
    z = signals.zscore(cells.filter(signals.valid_finite("trace")), "trace", "z").filter(~signals.has_nan("z"))
    own = materialize(z.select("cell", "trace"), "valid")
    if not (n := _length(own)):
        return own.select("cell", F.lit(None).cast("int").alias("label"))
    return jobs.hierarchical_labels(own, "cell", n, **settings)


def _subclusters(cells: DataFrame, clusters: DataFrame, least: int, most: int) -> DataFrame:
    own = signals.zscore(cells.join(clusters.filter("label is not null"), "cell"), "trace", "z").select("cell", F.col("label").alias("cluster"), "z")
    return jobs.subclusters(own, "cluster", "cell", None, trace="z", least=least, most=most)


def _activity(cells: DataFrame, labels: DataFrame, label: str, least: int) -> DataFrame:
    return jobs.cluster_activity(cells, labels.select("cell", F.col(label).alias("label")), "cell", least=least)[0]


def _places(cells: DataFrame, subclusters: DataFrame, centers: DataFrame, least: int) -> DataFrame:
    return jobs.cluster_activity(cells, subclusters.select("cell", F.col("sub").alias("label")), "cell", centers, least)[1]


#: The stages, each after those it needs.
GRAPH: dict[str, Stage] = {
    "cells": Stage(_cells, ("raw",), {"window": 400, "percentile": 20, "step": 10}),
    "centers": Stage(lambda footprints, least: voxels.weighted_centroid(footprints, ["cell"], ["z", "x", "y"], "weight", least), ("footprints",), {"least": 0.005}),
    "frames": Stage(_frames, ("samples",), {"level": 3.8, "rate": 6000.0}),
    "baseline_clusters": Stage(_baseline_clusters, ("cells",), {"components": 20, "explained": 0.9, "loading": 0.4, "least_cells": 100, "assign": 0.4}),
    "oxygen": Stage(_oxygen, ("cells", "frames"), {"curve": None, "start": 600.0, "end": 3600.0}, ("curve",)),
    "flags": Stage(_flags, ("cells", "baseline_clusters", "oxygen"), {"explained": 0.9, "mean": 20.0, "std": 2.0, "variation": 0.05, "most_p": 0.001}),
    "swim_fits": Stage(_swim_fits, ("cells", "flags", "frames"), {"states": recording_jobs.STATES, "lags": list(models.LAGS), "least": 0.2}),
    "ratios": Stage(lambda swim_fits, first, second, least_r2, mode: jobs.beta_ratios(swim_fits, "cell", first, second, least_r2, mode), ("swim_fits",), {"first": "normoxia", "second": "hypoxia", "least_r2": 0.0, "mode": "log2"}),
    "map": Stage(_map, ("ratios", "centers"), {"size": None, "radius": [5, 5, 5], "least": 10, "sign": "all"}),
    "clusters": Stage(_clusters, ("cells",), {"k": 100, "share": 0.05, "settled": 0.9, "noisy": 0.3, "floor": 0.2}),
    "subclusters": Stage(_subclusters, ("cells", "clusters"), {"least": 200, "most": 30_000}),
    "activity": Stage(lambda cells, clusters, least: _activity(cells, clusters, "label", least), ("cells", "clusters"), {"least": 50}),
    "subcluster_activity": Stage(lambda cells, subclusters, least: _activity(cells, subclusters, "sub", least), ("cells", "subclusters"), {"least": 50}),
    "subcluster_oxygen": Stage(_subcluster_oxygen, ("subcluster_activity", "frames"), {"curve": None, "start": 600.0, "end": 3600.0}, ("curve",)),
    "subcluster_places": Stage(_places, ("cells", "subclusters", "centers"), {"least": 50}),
}


def _digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:32]


def file_state(spark: SparkSession, path: str) -> str | None:
    """A digest of names, lengths and times of a file or of all files of a folder, hidden ones apart; None if it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return None
    found, listed = [], system.listFiles(hadoop, True)
    while listed.hasNext():  # the files of one table
        f = listed.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return _digest(sorted(found))


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest, none before there is one."""
    try:
        return spark.read.schema(MANIFEST).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def _wanted(graph: Mapping[str, Stage], stages: Sequence[str] | None) -> list[str]:
    """The asked stages and all they need, in the graph's order."""
    unknown = set(stages or ()) - set(graph)
    if unknown:
        raise ValueError(f"no stage {', '.join(sorted(unknown))}; there are {', '.join(graph)}")
    chosen = set(stages or graph)
    for name in reversed(list(graph)):
        if name in chosen:
            chosen |= {n for n in graph[name].needs if n in graph}
    return [name for name in graph if name in chosen]


def _settings(graph: Mapping[str, Stage], given: Mapping[str, Mapping[str, Any]]) -> dict[str, dict[str, Any]]:
    for name, own in given.items():
        if unknown := set(own) - set(graph[name].settings if name in graph else ()):
            raise ValueError(f"stage {name} has no setting {', '.join(sorted(unknown))}")
    return {name: {**stage.settings, **given.get(name, {})} for name, stage in graph.items()}


def run_recording(
    spark: SparkSession, recording: int, root: str, out: str, stages: Sequence[str] | None = None, settings: Mapping[str, Mapping[str, Any]] | None = None, force: bool = False, graph: Mapping[str, Stage] = GRAPH
) -> list[tuple[int, str, str]]:
    """(recording, stage, state) of the asked stages and what they need: ``given``, ``kept`` (finished before), ``ran``, or
    ``lacks`` and what is missing. ``force`` runs the asked stages again; what depends on a new result runs when next asked."""
    chosen, of = _wanted(graph, stages), _settings(graph, settings or {})
    log = f"{out}/manifest/recording_id={recording}"
    done = {(r.stage, r.key): r for r in sorted(_manifest(spark, log).collect(), key=lambda r: r["at"])}  # a row a run of a stage
    latest = {r.stage: r for r in sorted(done.values(), key=lambda r: r["at"])}
    idents: dict[str, str | None] = {}
    places: dict[str, str] = {}
    report = []

    def look(table: str) -> str | None:
        """The identity of a table in the folder."""
        if table not in idents:
            places[table] = f"{root}/{table}.parquet"
            idents[table] = file_state(spark, places[table])
        return idents[table]

    for name in chosen:
        stage, own = graph[name], of[name]
        if look(name):
            report.append((recording, name, "given"))
            continue
        lacking = [n for n in stage.needs if not look(n)] + [f"{name}.{s}" for s, v in own.items() if v is None]
        states = {p: file_state(spark, own[p]) for p in stage.paths if own[p] is not None}
        lacking += [own[p] for p, state in states.items() if state is None]
        if lacking:
            report.append((recording, name, f"lacks {', '.join(lacking)}"))
            continue
        key = _digest(name, stage.version, own, states, [idents[n] for n in stage.needs])
        row, asked = done.get((name, key)), force and (stages is None or name in stages)
        state = "kept" if row and not asked else "ran"
        result = row["result"] if state == "kept" else uuid.uuid4().hex
        places[name] = f"{out}/{name}/recording_id={recording}/result={result}"
        if state == "ran":
            stage.make(**{n: spark.read.parquet(places[n]) for n in stage.needs}, **own).write.mode("error").parquet(places[name])
        if state == "ran" or latest[name]["result"] != result:  # the newest row names the result that holds
            spark.createDataFrame([(name, key, result, json.dumps(own), time.time())], MANIFEST).coalesce(1).write.mode("append").json(log)
        idents[name] = result
        report.append((recording, name, state))
    return report


def run_catalog(
    spark: SparkSession, catalog: str, out: str, stages: Sequence[str] | None = None, settings: Mapping[str, Mapping[str, Any]] | None = None, first: int | None = 0, last: int | None = None,
    force: bool = False, parallel: int = 4, graph: Mapping[str, Stage] = GRAPH,
) -> list[tuple[int, str, str]]:
    """``run_recording`` for every recording of a catalog's inclusive range of ids, ``parallel`` of them at a time.

    A fault in one recording does not stop the others; all faults are raised together at the end, and what was finished
    stays finished.
    """
    _wanted(graph, stages), _settings(graph, settings or {})  # faults in the call come before any work
    rows = files.select_recordings(files.read_catalog(spark, catalog), first, last).select("recording_id", "save_root").orderBy("recording_id").collect()  # a row a recording
    base = out.rstrip("/")
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        running = [pool.submit(run_recording, spark, r.recording_id, r.save_root.rstrip("/"), base, stages, settings, force, graph) for r in rows]
    faults = [e for f in running if (e := f.exception())]
    if faults:
        raise ExceptionGroup(f"{len(faults)} of {len(rows)} recordings failed", faults)
    return [line for f in running for line in f.result()]


def results(spark: SparkSession, out: str, stage: str) -> DataFrame:
    """The newest result of a stage of every recording that has one, with ``recording_id``."""
    base = out.rstrip("/")
    newest = _manifest(spark, f"{base}/manifest").filter(F.col("stage") == stage)
    if "recording_id" not in newest.columns:
        raise FileNotFoundError(f"no results below {base}")
    rows = newest.groupBy("recording_id").agg(F.max_by("result", "at").alias("result")).collect()  # a row a recording
    if not rows:
        raise FileNotFoundError(f"no results of {stage} below {base}")
    paths = [f"{base}/{stage}/recording_id={r.recording_id}/result={r['result']}" for r in rows]
    return spark.read.option("basePath", f"{base}/{stage}").parquet(*paths).drop("result")
