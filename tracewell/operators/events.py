"""Events, bouts and intervals: runs, sessions, event-aligned windows and interval algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import scans
from tracewell.session import materialize


def _over(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _numbered_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column, block: int | None) -> DataFrame:
    """Adds ``__s`` (the state), ``__i`` (the row's number from 0) and ``run`` (the number of its run from 1)."""
    if block is None:
        w = _over(keys, order)
        marked = df.withColumns({"__s": state, "__i": F.row_number().over(w) - 1})
        changed = marked.withColumn("__c", F.when(F.lag("__s").over(w).eqNullSafe(F.col("__s")) & (F.col("__i") > 0), 0).otherwise(1))
        return changed.withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    placed = scans.number_rows(df.withColumn("__s", state), keys, order, "__i")
    changed = scans.over_frame(placed, keys, "__i", 1, 0, {"__c": lambda w: F.when(F.lag("__s").over(w).eqNullSafe(F.col("__s")) & (F.col("__i") > 0), 0).otherwise(1)}, block)
    return scans.running(changed, keys, "__i", {"run": ("sum", F.col("__c"))}, block)


def find_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column, block: int | None = None) -> DataFrame:
    """(keys, run, state, start, end, length): maximal runs of equal state, places counted from 0."""
    runs = _numbered_runs(df, keys, order, state, block)
    return runs.groupBy(*keys, "run").agg(
        F.first("__s").alias("state"), F.min("__i").alias("start"), F.max("__i").alias("end"), F.count(F.lit(1)).alias("length")
    )


def fill_short_gaps(runs: DataFrame, keys: Sequence[str], shortest: int, block: int | None = None) -> DataFrame:
    """(keys, bout, start, end): active runs joined over inactive ones shorter than ``shortest`` samples."""
    active = runs.filter("state")
    if block is not None:
        placed = scans.number_rows(active.select(*keys, "start", "end"), keys, ["start"], "__i")
        near = lambda w: F.when(F.coalesce(F.col("start") - F.lag("end").over(w) - 1 < shortest, F.lit(False)), 0).otherwise(1)
        opened = scans.over_frame(placed, keys, "__i", 1, 0, {"__new": near}, block)
        numbered = scans.running(opened, keys, "__i", {"bout": ("sum", F.col("__new"))}, block)
        return numbered.groupBy(*keys, "bout").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    w = _over(keys, ["start"])
    gap = F.col("start") - F.lag("end").over(w) - 1
    new = active.withColumn("__new", F.when(F.coalesce(gap < shortest, F.lit(False)), 0).otherwise(1))
    numbered = new.withColumn("bout", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "bout").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def bout_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], active: Column, shortest_gap: int = 2, rate: float = 1.0, block: int | None = None) -> DataFrame:
    """(keys, bout, start, end, duration, initiation_gap, gap_before) of bouts that touch neither end of the signal."""
    runs = find_runs(df, keys, order, active, block)
    if block is not None:
        runs = materialize(runs, "runs")
    ends = runs.groupBy(*keys).agg(F.max("end").alias("__last"))
    met = fill_short_gaps(runs, keys, shortest_gap, block)
    whole = (met.join(ends, list(keys)) if keys else met.crossJoin(F.broadcast(ends))).filter("start > 0 and end < __last").drop("__last")  # one row a signal
    gaps = {
        "duration": lambda w: (F.col("end") - F.col("start") + 1) / rate,
        "initiation_gap": lambda w: (F.col("start") - F.lag("start").over(w)) / rate,
        "gap_before": lambda w: (F.col("start") - F.lag("end").over(w) - 1) / rate,
    }
    if block is not None:
        return scans.over_frame(scans.number_rows(whole, keys, ["start"], "__i"), keys, "__i", 1, 0, gaps, block).drop("__i")
    return whole.withColumns({name: f(_over(keys, ["start"])) for name, f in gaps.items()})


def sessions(df: DataFrame, keys: Sequence[str], time: str, tie: str, gap: float, block: int | None = None) -> DataFrame:
    """(keys, session, start, end, n): a new session where the gap exceeds ``gap``; those of one event are dropped."""
    new = lambda w: F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    if block is None:
        w = _over(keys, [time, tie])
        numbered = df.withColumn("__n", new(w)).withColumn("session", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        opened = scans.over_frame(scans.number_rows(df, keys, [time, tie], "__i"), keys, "__i", 1, 0, {"__n": new}, block)
        numbered = scans.running(opened, keys, "__i", {"session": ("sum", F.col("__n"))}, block)
    grouped = numbered.groupBy(*keys, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))
    return grouped.filter("start <> end")


def burst_threshold(mode: Column, floor: Column, multiplier: float = 2.5) -> Column:
    return mode + multiplier * (mode - floor)


def event_windows(onsets: DataFrame, samples: DataFrame, keys: Sequence[str], onset: str, time: str, before: float, after: float) -> DataFrame:
    """Samples within [onset - before, onset + after) of each onset, with offset = time - onset.

    Both sides meet on buckets of the window's width: an onset's window touches two buckets, so the range join is an
    equality join of two rows an onset, without a nested loop.
    """
    width = before + after
    first = F.floor((F.col(onset) - before) / width).cast("long")
    opened = onsets.withColumn("__b", F.explode(F.array(first, first + 1)))
    dealt = samples.withColumn("__b", F.floor(F.col(time) / width).cast("long"))
    met = opened.join(dealt, [*keys, "__b"]).drop("__b")
    offset = F.col(time) - F.col(onset)
    return met.withColumn("offset", offset).filter((F.col("offset") >= -before) & (F.col("offset") < after))


def sweep(intervals: DataFrame, keys: Sequence[str], kind: str, start: str, end: str) -> DataFrame:
    """(keys, at, until, a, b): between consecutive ends, how many intervals of kind a and of kind b are open.

    Intervals are half-open. Each is two rows, summed by position before the running sum.
    """
    ends = intervals.select(*keys, kind, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    deltas = ends.groupBy(*keys, "e.at").agg(*[F.sum(F.when(F.col(kind) == k, F.col("e.d")).otherwise(0)).alias(k) for k in ("a", "b")])
    w = _over(keys, ["at"])
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select(*keys, "at", F.lead("at").over(w).alias("until"), F.sum("a").over(running).alias("a"), F.sum("b").over(running).alias("b"))


def overlap_length(swept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, both_open, only_b): length with both kinds open, and with b open while a is not."""
    length = F.col("until") - F.col("at")
    return swept.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when((F.col("a") > 0) & (F.col("b") > 0), length)), F.lit(0)).alias("both_open"),
        F.coalesce(F.sum(F.when((F.col("a") <= 0) & (F.col("b") > 0), length)), F.lit(0)).alias("only_b"),
    )


def epoch_means(trials: DataFrame, epoch: str, offset: str, value: str, baseline_until: float) -> DataFrame:
    """(epoch, offset, mean): trial means by epoch, less the epoch's mean before ``baseline_until``."""
    means = trials.groupBy(epoch, offset).agg(F.avg(value).alias("mean"))
    early = trials.filter(F.col(offset) < baseline_until).groupBy(epoch).agg(F.avg(value).alias("__base"))
    return means.join(F.broadcast(early), epoch, "left").withColumn("mean", F.col("mean") - F.coalesce("__base", F.lit(0.0))).drop("__base")


def run_spans(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, state: Column, block: int | None = None) -> DataFrame:
    """(keys, run, state, span): the time from the first to the last row of each run of equal state."""
    numbered = _numbered_runs(df, keys, order, state, block)
    return numbered.groupBy(*keys, "run").agg(F.first("__s").alias("state"), (F.max(time) - F.min(time)).alias("span"))


def swim_trials(turns: DataFrame, keys: Sequence[str], position: str, normal: tuple[float, float], hypoxia: tuple[float, float], least_gap: float = 10, drop_last: int = 2) -> DataFrame:
    """(keys, trial, start, end, epoch) from the on and off turns of a signal.

    A trial begins at an onset after which the next one is more than ``least_gap`` from this one's end, or at the last;
    it ends at the last end before the next trial. Turns before the first onset count for nothing. The last trials,
    whose windows may be cut, are left out. Epoch: 1 strictly inside ``normal``, 2 inside ``hypoxia``, else 0.
    """
    w = _over(keys, [position])
    ons = turns.withColumns({"__off": F.lead(position).over(w), "__next": F.lead(position, 2).over(w)}).filter("turn = 'on'")
    kept = F.when(F.col("__next").isNull() | (F.col("__next") - F.col("__off") > least_gap), 1).otherwise(0)
    numbered = ons.withColumn("__k", kept).withColumn("trial", F.sum("__k").over(w)).filter("trial > 0")
    trials = numbered.groupBy(*keys, "trial").agg(F.min(position).alias("start"), F.max("__off").alias("end"))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trial")))
    kept_trials = trials.withColumn("__r", last).filter(F.col("__r") > drop_last).drop("__r")
    inside = lambda at: (F.col("start") > at[0]) & (F.col("start") < at[1])
    return kept_trials.withColumn("epoch", F.when(inside(normal), 1).when(inside(hypoxia), 2).otherwise(0))


def burst_bouts(df: DataFrame, keys: Sequence[str], position: str, value: str, block: int = 6000, width: float = 1e-5, top: float = 0.1, multiplier: float = 2.5, gap: float = 600, rows: int | None = None) -> DataFrame:
    """(keys, bout, start, end): bursts of swimming in a filtered signal with positions 0, 1, 2, ...

    Peaks up to each block's end are counted in bins of ``width`` up to ``top``; the first fullest bin is the mode, and
    the floor is the last bin before it with less than 1/200 of its count (else 0). Peaks above mode + multiplier x (mode -
    floor) are bursts; a bout ends where the next burst is more than ``gap`` away, and bouts of one burst are dropped.
    Positions after the last whole block take its threshold and are not counted. With ``rows``, a signal's samples are dealt
    to tasks by so many; what is counted, a row a block and bin, and the bursts are few.
    """
    ahead = {"__1": lambda w: F.lead(value, 1).over(w), "__2": lambda w: F.lead(value, 2).over(w)}
    if rows is None:
        w = _over(keys, [position])
        steps = df.withColumns({name: f(w) for name, f in ahead.items()} | {"__n": F.max(position).over(Window.partitionBy(*keys)) + 1})
    else:
        ends = F.broadcast(df.groupBy(*keys).agg((F.max(position) + 1).alias("__n")))  # one row a signal
        looked = scans.over_frame(df, keys, position, 0, 2, ahead, rows)
        steps = looked.join(ends, list(keys)) if keys else looked.crossJoin(ends)
    # a block's threshold reaches one sample into the next, which overwrites all but the last
    blocks = F.greatest(F.ceil((F.col("__n") - block) / block), F.lit(1)) - 1
    peaks = steps.filter((F.col("__1") > F.col(value)) & (F.col("__2") < F.col("__1")))
    peaks = peaks.withColumn("__b", F.least(F.floor(F.col(position) / block), blocks)).select(*keys, position, value, "__b")
    bins = F.least(F.floor(F.col(value) / width), F.lit(round(top / width) - 1)).cast("int")  # the last bin holds its upper end
    whole = F.col(position) < (F.col("__b") + 1) * block
    counted = peaks.filter((F.col(value) >= 0) & (F.col(value) <= top) & whole).groupBy(*keys, "__b", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per_bin = Window.partitionBy(*keys, "bin").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    seen = peaks.select(*keys, "__b").distinct().join(counted.select(*keys, "bin").distinct(), list(keys)).join(counted, [*keys, "__b", "bin"], "left").fillna(0, ["n"])
    seen = seen.withColumn("n", F.sum("n").over(per_bin)).filter("n > 0")
    each = Window.partitionBy(*keys, "__b")
    modes = seen.withColumn("__m", F.max(F.struct("n", (-F.col("bin")).alias("b"))).over(each)).withColumns({"mode": -F.col("__m.b"), "__most": F.col("__m.n")})
    high = modes.filter((F.col("bin") < F.col("mode")) & (F.col("n") >= F.col("__most") / 200))
    # bins right below the mode that all have enough; the one below them is the floor
    joined = high.withColumn("__r", F.row_number().over(each.orderBy(F.desc("bin")))).filter(F.col("mode") - F.col("bin") == F.col("__r"))
    floors = joined.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    levels = modes.select(*keys, "__b", "mode").distinct().join(floors, [*keys, "__b"], "left").withColumn("floor", F.greatest(F.col("mode") - 1 - F.coalesce("__c", F.lit(0)), F.lit(0)))
    high_peaks = peaks.join(levels, [*keys, "__b"]).filter(F.col(value) > burst_threshold(F.col("mode") * width, F.col("floor") * width, multiplier))
    return sessions(high_peaks.select(*keys, position), keys, position, position, gap, rows).select(*keys, F.col("session").alias("bout"), "start", "end")
