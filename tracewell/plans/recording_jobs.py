"""Jobs over a catalog of recordings: each reads a recording's tables, runs an analysis on Spark and writes its result.

A recording's folder (``save_root``) holds Parquet tables: ``cells`` (cell, trace), ``flags`` (cell, invalid, explained, active:
the masks of the earlier stages, null where a stage did not reach the cell), ``frames`` (frame, sec, swim). Finished
recordings are kept in a manifest and skipped on the next run unless forced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import models, populations, signals
from tracewell.plans import jobs
from tracewell.session import materialize
from tracewell.sources import files, sinks

#: Seconds of the two states that are compared.
STATES = {"normoxia": (600.0, 1200.0), "hypoxia": (1800.0, 2400.0)}


def recording_inputs(cells: DataFrame, flags: DataFrame, frames: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(cells that passed every mask, cut to the shortest of traces and frames; seconds; swim signal by frame).

    Only the frames' two columns, as long as the recording, reach the driver; cells stay where they are.
    """
    kept = flags.filter(~F.col("invalid") & F.coalesce("explained", F.lit(False)) & F.coalesce("active", F.lit(False))).select("cell")
    chosen = cells.join(kept, "cell")
    clock = frames.orderBy("frame").select("sec", "swim").toPandas()
    longest = chosen.agg(F.max(F.size("trace"))).first()[0]
    n = min(len(clock), longest if longest is not None else len(clock))
    cut = materialize(chosen.withColumn("trace", F.slice("trace", F.lit(1), F.lit(n))), "chosen")
    return cut, clock["sec"].to_numpy(float)[:n], clock["swim"].to_numpy(float)[:n]


def state_frames(sec: np.ndarray, states: dict[str, tuple[float, float]]) -> dict[str, tuple[int, int]]:
    """The half-open range of frames of each state, start <= time < end."""
    return {name: (int(np.searchsorted(sec, lo, "left")), int(np.searchsorted(sec, hi, "left"))) for name, (lo, hi) in states.items()}


def for_each_recording(spark: SparkSession, catalog: str, out: str, stage: str, job: Callable[[str], DataFrame], first: int | None = 0, last: int | None = None, force: bool = False) -> list[int]:
    """Runs ``job`` on the folder of every pending recording of an inclusive range of ids and writes its rows to ``out``.

    Returns the ids that ran. The loop is over recordings, each of which is a distributed job of its own.
    """
    rows = files.select_recordings(files.read_catalog(spark, catalog), first, last)
    manifest = f"{out.rstrip('/')}.manifest"
    todo = sinks.pending(spark, rows, manifest, stage, force).orderBy("recording_id")
    ran = []
    for r in todo.select("recording_id", "save_root").collect():  # a row a recording
        sinks.write_table(job(r.save_root).withColumn("recording_id", F.lit(r.recording_id)), out)
        sinks.mark_done(rows.filter(F.col("recording_id") == r.recording_id), manifest, stage)
        ran.append(r.recording_id)
    return ran


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def swim_fit_job(
    spark: SparkSession, catalog: str, out: str, first: int | None = 0, last: int | None = None, force: bool = False, states: dict[str, tuple[float, float]] | None = None,
    lags: Sequence[int] = models.LAGS, least: float = 0.2,
) -> list[int]:
    """Lagged fits of every recording's cells on its swimming, in each state."""

    def job(root: str) -> DataFrame:
        cells, sec, swim = recording_inputs(*(_read(spark, root, n) for n in ("cells", "flags", "frames")))
        return jobs.swim_fits(cells, "cell", swim, state_frames(sec, states or STATES), lags, least)

    return for_each_recording(spark, catalog, out, "swim_fit", job, first, last, force)


def oxygen_job(spark: SparkSession, catalog: str, out: str, oxygen: str, first: int | None = 0, last: int | None = None, force: bool = False, start: float = 600, end: float = 3600) -> list[int]:
    """Each valid cell's mean, std and rank correlation with the oxygen curve (CSV: sec, value) between two times."""
    curve = spark.read.schema("sec int, value double").csv(oxygen, header=True)

    def job(root: str) -> DataFrame:
        valid = _read(spark, root, "flags").filter(~F.col("invalid")).select("cell")
        cells = signals.with_moments(_read(spark, root, "cells").join(valid, "cell")).withColumn("recording", F.lit(0))
        times = _read(spark, root, "frames").groupBy(F.lit(0).alias("recording")).agg(F.sort_array(F.collect_list(F.struct("frame", "sec"))).alias("f")).select("recording", F.col("f.sec").alias("sec"))
        scored = jobs.oxygen_correlations(materialize(cells, "cells"), times, curve, "cell", "recording", start, end)
        return scored.select("cell", "mean", "std", "r", "p")

    return for_each_recording(spark, catalog, out, "oxygen", job, first, last, force)


def cluster_job(spark: SparkSession, catalog: str, out: str, first: int | None = 0, last: int | None = None, force: bool = False, k: int = 20, least_explained: float = 0.9, **settings) -> list[int]:
    """Baseline clusters of the cells that the first ``k`` components explain."""

    def job(root: str) -> DataFrame:
        valid = _read(spark, root, "flags").filter(~F.col("invalid")).select("cell")
        cells = materialize(_read(spark, root, "cells").join(valid, "cell").filter(~signals.has_nan("trace")), "valid")
        n = cells.select(F.size("trace")).first()
        if n is None:
            return cells.select("cell", F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("best_r"))
        labelled = jobs.baseline_clusters(cells, "cell", n[0], k, least_explained=least_explained, **settings)[0]
        return labelled.filter(F.col("explained") > least_explained).select("cell", "label", "best_r")

    return for_each_recording(spark, catalog, out, "clusters", job, first, last, force)


def run_report(runs: DataFrame, value: str = "r2") -> tuple[DataFrame, DataFrame]:
    """(summary by spec and condition, two-way ANOVA by condition) of model runs."""
    return populations.summarise_runs(runs, ["spec_idx", "spec_label", "condition"]), populations.two_way_anova(runs, "spec_label", "fish_idx", value, "condition")


def save_factors(loadings: DataFrame, scores: np.ndarray, path: str) -> None:
    """A factor model as two Parquet tables: loadings by cell, scores by factor."""
    spark = loadings.sparkSession
    loadings.write.mode("overwrite").parquet(f"{path}/loadings")
    rows = [(i, s.tolist()) for i, s in enumerate(np.asarray(scores, float))]
    spark.createDataFrame(rows, "factor int, score array<double>").write.mode("overwrite").parquet(f"{path}/scores")


def load_factors(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    rows = spark.read.parquet(f"{path}/scores").orderBy("factor").collect()  # a row a factor
    return spark.read.parquet(f"{path}/loadings"), np.array([r.score for r in rows], float)
