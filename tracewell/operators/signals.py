"""Operators on signals: rows of (keys, order, value), or one array per cell.

Windows are always partitioned by the signal's keys; per-cell statistics on arrays need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.kernels import numeric
from tracewell.operators import scans


def _over(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _framed(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int, columns: Mapping[str, Callable[[WindowSpec], Column]], block: int | None) -> DataFrame:
    """Adds window columns that look ``before`` rows back and ``after`` ahead, a signal a task or (``block``) a block a task."""
    if block is None:
        w = _over(keys, order)
        return df.withColumns({name: f(w) for name, f in columns.items()})
    return scans.over_frame(scans.number_rows(df, keys, order, "__place"), keys, "__place", before, after, columns, block).drop("__place")


# validity and thresholds


def has_nan(trace: str) -> Column:
    return F.exists(trace, lambda x: F.isnan(x) | x.isNull())


def valid_bounded(trace: str, most: float = 10.0) -> Column:
    """No NaN and no value above ``most``."""
    return ~has_nan(trace) & (F.array_max(trace) <= most)


def valid_finite(trace: str) -> Column:
    """Neither NaN nor infinite."""
    return ~F.exists(trace, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))


# per-cell array statistics


def array_mean(trace: str | Column) -> Column:
    return F.try_divide(F.aggregate(trace, F.lit(0.0), lambda s, x: s + x), F.size(trace))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row; the optimiser would copy a plain column into lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spread(trace: str, mean: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(trace, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), F.size(trace)))


def with_moments(cells: DataFrame, trace: str = "trace") -> DataFrame:
    """Adds mean and std (population) of each cell's array."""
    return cells.withColumns({"mean": array_mean(trace), "std": let(array_mean(trace), lambda m: _spread(trace, m))})


def zscore(cells: DataFrame, trace: str = "trace", name: str = "z") -> DataFrame:
    """Adds the array's z-scores with the population deviation; null where it is 0."""
    scaled = lambda m: let(_spread(trace, m), lambda s: F.transform(trace, lambda x: F.try_divide(x - m, s)))
    return cells.withColumn(name, let(array_mean(trace), scaled))


def to_frames(cells: DataFrame, trace: str, value: str, *keep: str) -> DataFrame:
    """One row a frame: the kept columns, frame and value."""
    return cells.select(*keep, F.posexplode(trace).alias("frame", value))


def delta_f(fluorescence: Column, baseline: Column) -> Column:
    """F / baseline - 1 by frame; null where the baseline is 0."""
    return F.zip_with(fluorescence, baseline, lambda f, b: F.try_divide(f, b) - 1)


def population_mean(cells: DataFrame, trace: str = "trace") -> DataFrame:
    """(frame, mean) over all cells; sums are made in each task, so one row a frame and task is shuffled."""
    return to_frames(cells, trace, "value").groupBy("frame").agg(F.avg("value").alias("mean"))


# ranks and rank correlation


def rank_correlation(cells: DataFrame, references: np.ndarray, trace: str = "trace", name: str = "r") -> DataFrame:
    """Adds the array of Spearman correlations with each reference row; null where undefined.

    References are few (a population mean, cluster templates, a regressor) and travel with the tasks; every cell is
    ranked where it lies, so nothing is shuffled.
    """
    shared = cells.sparkSession.sparkContext.broadcast(np.atleast_2d(references))

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = np.diff(batch.offsets.to_numpy())
            out: list = [None] * len(batch)
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                if n != shared.value.shape[1]:
                    continue
                traces = np.stack([np.asarray(batch[int(i)].values.to_numpy(zero_copy_only=False), float) for i in rows])
                for i, r in zip(rows, numeric.rank_correlations(traces, shared.value), strict=True):
                    out[i] = [float(v) if np.isfinite(v) else None for v in r]
            yield pa.array(out, pa.list_(pa.float64()))

    return cells.withColumn(name, F.arrow_udf(work, T.ArrayType(T.DoubleType()))(trace))


def paired_rank_correlation(rows: DataFrame, left: str, right: str, name: str = "r") -> DataFrame:
    """Adds the Spearman correlation of two arrays of each row; null where undefined or of unequal lengths."""

    def values(lists: pa.Array, at: np.ndarray, n: int) -> np.ndarray:
        """The lists of length n at these places, as a matrix; null elements are NaN."""
        return np.asarray(pc.list_flatten(lists.take(pa.array(at))).to_numpy(zero_copy_only=False), float).reshape(len(at), n)

    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            sizes = [np.asarray(pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False)) for x in (a, b)]
            out = np.full(len(a), np.nan)
            for n in np.unique(sizes[0][(sizes[0] == sizes[1]) & (sizes[0] > 0)]):  # rows of one length at a time
                at = np.flatnonzero((sizes[0] == n) & (sizes[1] == n))
                out[at] = numeric.paired_rank_correlations(values(a, at, n), values(b, at, n))
            yield pa.array(np.where(np.isfinite(out), out, np.nan), pa.float64(), mask=~np.isfinite(out))

    return rows.withColumn(name, F.arrow_udf(work, T.DoubleType())(left, right))


def vector(frames: DataFrame, value: str) -> np.ndarray:
    """A frame-indexed column as numpy; its length is the number of frames, not of cells."""
    return np.array([r[0] for r in frames.orderBy("frame").select(value).collect()], float)


@F.arrow_udf(T.DoubleType())
def spearman_p(r: pa.Array, n: pa.Array) -> pa.Array:
    """Two-sided p-value of a rank correlation over n pairs."""
    unknown = pc.or_(pc.is_null(r), pc.is_null(n)).to_numpy(zero_copy_only=False)
    p = numeric.spearman_p(pc.fill_null(r, 0.0).to_numpy(zero_copy_only=False), pc.fill_null(n, 0).to_numpy(zero_copy_only=False))
    return pa.array(p, pa.float64(), mask=unknown)


# windows over rows


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, span: int, quantile: float | None = None, block: int | None = None) -> DataFrame:
    """Adds roll_mean and roll_std (sample), or roll_quantile, of a centred span; an even span looks one row less ahead."""
    before, after = span // 2, span - span // 2 - 1
    frame = lambda w: w.rowsBetween(-before, after)
    if quantile is not None:
        return _framed(df, keys, order, before, after, {"roll_quantile": lambda w: F.percentile(value, quantile).over(frame(w))}, block)
    return _framed(df, keys, order, before, after, {"roll_mean": lambda w: F.avg(value).over(frame(w)), "roll_std": lambda w: F.stddev_samp(value).over(frame(w))}, block)


def trailing_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: int, name: str = "trailing", block: int | None = None) -> DataFrame:
    return _framed(df, keys, order, length - 1, 0, {name: lambda w: F.sum(value).over(w.rowsBetween(-(length - 1), 0))}, block)


def lag_design(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int, block: int | None = None) -> DataFrame:
    """Adds lag_0 .. lag_{lags-1}, zero before the start."""
    lagged = {f"lag_{k}": (lambda w, k=k: F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) if k else F.col(value)) for k in range(lags)}
    return _framed(df, keys, order, lags - 1, 0, lagged, block)


def rising_edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, level: float = 3.8, block: int | None = None) -> DataFrame:
    """Rows above the level whose predecessor is below it, both strictly."""
    before = _framed(df, keys, order, 1, 0, {"__before": lambda w: F.lag(value).over(w)}, block)
    return before.filter((F.col("__before") < level) & (F.col(value) > level)).drop("__before")


def local_maxima(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: int | None = None) -> DataFrame:
    """The row before each peak: the next step rises and the one after it falls."""
    ahead = _framed(df, keys, order, 0, 2, {"__1": lambda w: F.lead(value, 1).over(w), "__2": lambda w: F.lead(value, 2).over(w)}, block)
    return ahead.filter((F.col("__1") > F.col(value)) & (F.col("__2") < F.col("__1"))).drop("__1", "__2")


def gap_fill(df: DataFrame, keys: Sequence[str], position: str, value: str, name: str = "filled", block: int | None = None) -> DataFrame:
    """Linear interpolation of nulls by position; ends take the nearest value."""
    at = F.when(F.col(value).isNotNull(), F.col(position))
    if block is None:
        # numbered, so that ties stand alike in both orders; a frame up to the signal's end would be worked out anew for every row
        placed = df.withColumn("__place", F.row_number().over(_over(keys, [position])))
        back, ahead = (_over(keys, [o]).rowsBetween(Window.unboundedPreceding, 0) for o in ("__place", F.desc("__place")))
        known = placed.withColumns(
            {"__v0": F.last(value, True).over(back), "__v1": F.last(value, True).over(ahead), "__p0": F.last(at, True).over(back), "__p1": F.last(at, True).over(ahead)}
        ).drop("__place")
    else:
        placed = scans.number_rows(df, keys, [position], "__place")
        known = scans.running(placed, keys, "__place", {"__v0": ("last", F.col(value)), "__v1": ("next", F.col(value)), "__p0": ("last", at), "__p1": ("next", at)}, block).drop("__place")
    share = F.coalesce(F.try_divide(F.col(position) - F.col("__p0"), F.col("__p1") - F.col("__p0")), F.lit(0.0))
    blend = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * share
    return known.withColumn(name, F.coalesce(blend, "__v0", "__v1")).drop("__v0", "__v1", "__p0", "__p1")


def percentile_baseline(cells: DataFrame, trace: str = "trace", window: int = 400, percentile: int = 20, step: int = 10, name: str = "baseline") -> DataFrame:
    """Adds the sliding rank-filter baseline of each array.

    Every ``step``-th frame is taken; the filter's window of window // step samples, mirrored at the ends, is sorted and
    the element at int(size * percentile / 100) kept; between samples it is linear, past the last one it runs on.
    """
    size = max(1, window // step)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [np.array(x, float) for x in batch.to_pylist()]
            yield pa.array([numeric.sliding_rank(x, size, percentile, step).tolist() for x in rows], pa.list_(pa.float64()))

    return cells.withColumn(name, F.arrow_udf(work, T.ArrayType(T.DoubleType()))(trace))


def smooth(cells: DataFrame, kernel: Sequence[float], trace: str = "trace", name: str = "smooth") -> DataFrame:
    """Adds the convolution with a kernel of odd length, as long as the array, zero beyond its ends."""
    half = len(kernel) // 2

    def at(_: Column, i: Column) -> Column:
        return sum((F.coalesce(F.get(trace, i + half - k), F.lit(0.0)) * float(w) for k, w in enumerate(kernel)), F.lit(0.0))

    return cells.withColumn(name, F.transform(trace, at))


def bin_means(frames: DataFrame, keys: Sequence[str], position: str, value: str, width: int) -> DataFrame:
    """(keys, bin, value) means of whole bins; a last partial bin is dropped."""
    binned = frames.withColumn("bin", F.floor(F.col(position) / width).cast("int"))
    return binned.groupBy(*keys, "bin").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == width).drop("__n")


def interpolate_curve(df: DataFrame, time: str, curve: DataFrame, name: str = "curve", clamp: bool = True) -> DataFrame:
    """Adds the linear value of a curve with knots (sec, value) at whole seconds.

    Times beyond its ends take the end's value, or are left out without ``clamp`` (the last knot's time included).
    An equality join on the second before; the curve is one short table, its segments carry the next value.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("sec")  # the curve only: one row a second
    knots = curve.select("sec", F.col("value").alias("__v"), F.lead("value").over(w).alias("__next"))
    ends = curve.agg(F.min("sec").alias("__lo"), F.max("sec").alias("__hi"))
    held = df.crossJoin(F.broadcast(ends))  # one row
    if not clamp:
        held = held.filter((F.col(time) >= F.col("__lo")) & (F.col(time) < F.col("__hi")))
    held = held.withColumn("__t", F.greatest(F.least(F.col(time), F.col("__hi").cast("double")), F.col("__lo").cast("double")))
    met = held.withColumn("sec", F.floor("__t").cast("int")).join(F.broadcast(knots), "sec", "left")
    value = F.col("__v") + (F.coalesce("__next", "__v") - F.col("__v")) * (F.col("__t") - F.col("sec"))
    return met.withColumn(name, value).drop("__lo", "__hi", "__t", "sec", "__v", "__next")


def interpolate_at(df: DataFrame, keys: Sequence[str], time: str, curve: DataFrame, knot: str = "t", value: str = "v", name: str = "curve", beyond: str = "clamp", block: int | None = None) -> DataFrame:
    """Adds the linear value, at each row's time, of its key's curve with knots (keys, ``knot``, ``value``) at any times.

    Beyond a curve's ends rows take the end's value (``clamp``), are left out (``leave``), go on along the end's segment
    (``extrapolate``) or are an error (``error``). Of knots at one time the largest value counts; rows of keys without knots,
    and of null times, have none. Rows and knots are put in one order and the knots before and behind are carried to
    the rows, so nothing is multiplied however unevenly knots lie; with ``block`` one key may be of any length.
    """
    if beyond not in ("clamp", "leave", "extrapolate", "error"):
        raise ValueError(f"beyond {beyond!r}: clamp, leave, extrapolate or error")
    knots = curve.filter(F.col(knot).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, F.col(knot).cast("double").alias("__t")).agg(F.max(F.col(value).cast("double")).alias("__v"))
    rise = lambda t0, v0, t1, v1: F.try_divide(v1 - v0, t1 - t0)
    parts = {"t": "__t", "v": "__v"}
    if beyond == "extrapolate":  # the only one that goes on along a segment whose other knot the row does not see
        up = lambda w: rise(F.col("__t"), F.col("__v"), F.lead("__t").over(w), F.lead("__v").over(w))
        down = lambda w: rise(F.lag("__t").over(w), F.lag("__v").over(w), F.col("__t"), F.col("__v"))
        knots, parts = _framed(knots, keys, ["__t"], 1, 1, {"__up": up, "__down": down}, block), parts | {"up": "__up", "down": "__down"}
    packed = knots.select(*keys, "__t", F.lit(0).alias("__row"), F.struct(*[F.col(c).alias(n) for n, c in parts.items()]).alias("__knot"))
    rows = df.select(*keys, F.col(time).cast("double").alias("__t"), F.lit(1).alias("__row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__own"))
    both = packed.unionByName(rows, allowMissingColumns=True)
    if block is None:
        back, ahead = (_over(keys, o).rowsBetween(Window.unboundedPreceding, 0) for o in (["__t", "__row"], [F.desc("__t"), F.desc("__row")]))
        met = both.withColumns({"__a": F.last("__knot", True).over(back), "__b": F.last("__knot", True).over(ahead)})
    else:
        met = scans.running(scans.number_rows(both, keys, ["__t", "__row"], "__place"), keys, "__place", {"__a": ("last", F.col("__knot")), "__b": ("next", F.col("__knot"))}, block)
    met = met.filter("__row = 1")
    t, a, b = F.col("__t"), F.col("__a"), F.col("__b")
    inside = a.isNotNull() & (b.isNotNull() | (a["t"] == t)) & t.isNotNull()
    before, behind = t.isNotNull() & a.isNull() & b.isNotNull(), t.isNotNull() & a.isNotNull() & b.isNull() & (a["t"] < t)
    line = a["v"] + F.coalesce(rise(a["t"], a["v"], b["t"], b["v"]) * (t - a["t"]), F.lit(0.0))
    if beyond == "leave":
        met, found = met.filter(inside), line
    elif beyond == "error":
        found = F.when(inside, line).when(before | behind, F.raise_error(F.concat(F.lit("beyond the curve: "), t.cast("string"))).cast("double"))
    elif beyond == "clamp":
        found = F.when(inside, line).when(before, b["v"]).when(behind, a["v"])
    else:
        found = F.when(inside, line).when(before, b["v"] + F.coalesce(b["up"], F.lit(0.0)) * (t - b["t"])).when(behind, a["v"] + F.coalesce(a["down"], F.lit(0.0)) * (t - a["t"]))
    return met.select("__own.*", found.alias(name))


def ecdf(df: DataFrame, keys: Sequence[str], value: str, name: str = "ecdf") -> DataFrame:
    """Adds the share of the key's rows that are at most this row's value."""
    return df.withColumn(name, F.cume_dist().over(_over(keys, [value])))


def histogram_mode(df: DataFrame, keys: Sequence[str], block: str, value: str, width: float) -> DataFrame:
    """(keys, block, mode_bin, n): the fullest bin among all rows up to and including each block; the lowest wins ties."""
    counts = df.groupBy(*keys, block, F.floor(F.col(value) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins, blocks = counts.select(*keys, "bin").distinct(), counts.select(*keys, block).distinct()
    grid = blocks.join(bins, list(keys)).join(counts, [*keys, block, "bin"], "left").fillna(0, ["n"])
    upto = Window.partitionBy(*keys, "bin").orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    seen = grid.withColumn("n", F.sum("n").over(upto))
    return seen.groupBy(*keys, block).agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m")).select(*keys, block, (-F.col("m.b")).alias("mode_bin"), F.col("m.n").alias("n"))


def swim_power(df: DataFrame, keys: Sequence[str], value: str, percentile: float = 0.7) -> DataFrame:
    """Adds threshold (the key's percentile, linear) and power, sqrt of what exceeds it."""
    levels = df.groupBy(*keys).agg(F.percentile(value, percentile).alias("threshold"))
    return df.join(levels, list(keys)).withColumn("power", F.sqrt(F.greatest(F.col(value) - F.col("threshold"), F.lit(0.0))))


# differences, steps and turns


def first_difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "diff", block: int | None = None) -> DataFrame:
    """Adds the value less its predecessor's; null on the first row."""
    return _framed(df, keys, order, 1, 0, {name: lambda w: F.col(value) - F.lag(value).over(w)}, block)


def least_step(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, block: int | None = None) -> DataFrame:
    """(keys, least_step): the least distance of neighbouring positions."""
    return first_difference(df, keys, order, position, "__d", block).groupBy(*keys).agg(F.min("__d").alias("least_step"))


def turns(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: int | None = None) -> DataFrame:
    """The rows before a change, with turn: ``on`` from 0 to a positive value, ``off`` from a positive value to 0."""
    ahead = _framed(df, keys, order, 0, 1, {"__after": lambda w: F.lead(value).over(w)}, block)
    after = F.col("__after")
    turn = F.when((F.col(value) == 0) & (after > 0), "on").when((F.col(value) > 0) & (after == 0), "off")
    return ahead.withColumn("turn", turn).filter("turn is not null").drop("__after")


def exclude_places(df: DataFrame, keys: Sequence[str], order: Sequence[str], places: DataFrame) -> DataFrame:
    """The rows whose place in their signal, from 0, is not listed in ``places`` (keys, place)."""
    placed = df.withColumn("place", F.row_number().over(_over(keys, order)) - 1)
    return placed.join(places, [*keys, "place"], "left_anti").drop("place")


def pair_times(cells: DataFrame, times: DataFrame, recording: str, trace: str = "trace", sec: str = "sec") -> DataFrame:
    """Cells with the time stamps of their recording (one array a recording), both cut to the shorter one's length."""
    n = F.least(F.size(trace), F.size(sec))
    joined = cells.join(times.select(recording, sec), recording).withColumn("__n", n)
    return joined.withColumns({trace: F.slice(trace, F.lit(1), F.col("__n")), sec: F.slice(sec, F.lit(1), F.col("__n"))}).drop("__n")


def within(cells: DataFrame, start: float, end: float, trace: str = "trace", sec: str = "sec") -> DataFrame:
    """Traces and times of the frames with start < time < end."""
    both = F.filter(F.arrays_zip(F.col(trace).alias("v"), F.col(sec).alias("t")), lambda x: (x["t"] > start) & (x["t"] < end))
    held = cells.withColumn("__b", both)
    return held.withColumns({trace: F.col("__b.v"), sec: F.col("__b.t")}).drop("__b")


# robust means and distributions


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(keys, trimmed_mean): the mean of the values strictly between two percentiles."""
    ends = df.groupBy(*keys).agg(F.percentile(value, [low, high]).alias("__p"))
    inside = df.join(ends, list(keys)).filter((F.col(value) > F.col("__p")[0]) & (F.col(value) < F.col("__p")[1]))
    return inside.groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"))


def normalise_by_window(df: DataFrame, keys: Sequence[str], position: str, value: str, start: float, end: float, name: str = "normal") -> DataFrame:
    """Adds the value over the key's mean within [start, end); null where that has no rows or is 0."""
    inside = (F.col(position) >= start) & (F.col(position) < end)
    means = df.groupBy(*keys).agg(F.avg(F.when(inside, F.col(value))).alias("__m"))
    return df.join(means, list(keys)).withColumn(name, F.try_divide(value, "__m")).drop("__m")


def ecdf_grid(df: DataFrame, keys: Sequence[str], value: str, points: int = 50) -> DataFrame:
    """(keys, i, x, ecdf): the share of values at most x, on an even grid from the key's least value to its largest.

    Each value is counted at the first grid point that is not below it, and the counts of ``points`` rows are summed
    up; values never meet the whole grid. The last point is the largest value itself. Nulls, NaN and infinities are left
    out; a key of none but those has no rows.
    """
    df = df.filter(F.abs(value) < float("inf"))  # NaN is above infinity
    ends = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    at = lambda i: F.when(i < points - 1, F.col("__lo") + (F.col("__hi") - F.col("__lo")) * i / (points - 1)).otherwise(F.col("__hi"))
    guess = F.coalesce(F.ceil(F.try_divide((F.col(value) - F.col("__lo")) * (points - 1), F.col("__hi") - F.col("__lo"))), F.lit(0))
    met = df.join(ends, list(keys)).withColumn("__g", F.least(guess, F.lit(points - 1)))
    first = F.when((F.col("__g") > 0) & (at(F.col("__g") - 1) >= F.col(value)), F.col("__g") - 1).when((F.col("__g") < points - 1) & (at(F.col("__g")) < F.col(value)), F.col("__g") + 1).otherwise(F.col("__g"))
    counts = met.groupBy(*keys, first.cast("int").alias("i")).agg(F.count(F.lit(1)).alias("__n"))
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", at(F.col("i")))
    w = Window.partitionBy(*keys)
    seen = F.sum(F.coalesce("__n", F.lit(0))).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(counts, [*keys, "i"], "left").select(*keys, "i", "x", (seen / F.sum("__n").over(w)).alias("ecdf"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], bins: int = 4096, few: int = 10_000) -> list[float | None]:
    """Linear quantiles of a whole column, without gathering it: counted histograms narrow down to the values at a rank.

    Each pass counts at most ``bins`` bins and goes on between the least and the largest value of the bin that holds
    the rank, until ``few`` rows, or copies of one value, are left. Where a pass keeps more than half of its rows (values
    over many orders of magnitude), the next one splits at 64 approximate quantiles. Nulls and NaN are left out;
    infinities are the least and the largest values.
    """
    values = df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    endless = float("inf")
    bounded = F.when(F.abs("v") < endless, F.col("v"))
    n, inner, below_all, least, most = values.agg(F.count("v"), F.count(bounded), F.count_if(F.col("v") == -endless), F.min(bounded), F.max(bounded)).first()

    def ranked(rank: int) -> float:
        if rank < below_all:
            return -endless
        if rank >= below_all + inner:
            return endless
        rank -= below_all
        lo, hi, below, inside, by_rank = least, most, 0, inner, False
        while lo < hi:
            held = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
            if inside <= few:
                return held.orderBy("v").limit(rank - below + 1).agg(F.max("v")).first()[0]
            if by_rank:
                cuts = sorted(set(held.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000)).first()[0]))
                place = sum((F.col("v") > c).cast("int") for c in cuts) + sum((F.col("v") >= c).cast("int") for c in cuts)  # a cut's copies by themselves
            else:
                width = hi / bins - lo / bins
                place = F.least(F.floor(F.col("v") / width - lo / width), F.lit(bins - 1)) if width > 0 else (F.col("v") > lo).cast("int")
            for r in held.groupBy(place.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect():
                if below + r.n > rank:
                    by_rank = 2 * r.n > inside
                    lo, hi, inside = r.lo, r.hi, r.n
                    break
                below += r.n
        return lo

    found: dict[int, float] = {}
    out: list[float | None] = []
    for share in shares:
        if not n:
            out.append(None)
            continue
        at = share * (n - 1)
        low, high = int(np.floor(at)), int(np.ceil(at))
        for k in (low, high):
            if k not in found:
                found[k] = ranked(k)
        out.append(found[low] if found[low] == found[high] else found[low] + (found[high] - found[low]) * (at - low))
    return out
