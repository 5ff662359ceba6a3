"""Whole analyses made of the operators: lagged fits by state, ratio maps, behavioural model runs, baseline clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.kernels import numeric
from tracewell.operators import events, factors, models, populations, signals, voxels
from tracewell.session import materialize

#: The share of negatives kept: that of a standard normal above 0.5.
NEGATIVES = 0.3085375387259869


def swim_regressor(signal: np.ndarray, percentile: float = 70) -> np.ndarray:
    """Square root of what exceeds the percentile."""
    level = np.percentile(signal, percentile)
    return np.sqrt(np.maximum(np.asarray(signal, float) - level, 0))


def swim_fits(cells: DataFrame, cell: str, signal: np.ndarray, states: Mapping[str, tuple[int, int]], lags: Sequence[int] = models.LAGS, least: float = 0.2, trace: str = "trace") -> DataFrame:
    """(cell, state, spearman_r, skipped, lags, intercept, beta, r2, kernel) for every cell and state window.

    A cell is fitted if its largest absolute rank correlation over the states reaches ``least`` and all are defined;
    the others keep their correlations with null metrics. The screen is one pass of ranks; only its survivors reach
    the fits, which share one solver per state and lag count.
    """
    regressor = swim_regressor(signal)
    screened = cells.select(cell, trace)
    for i, (lo, hi) in enumerate(states.values()):
        part = screened.withColumn("__part", F.slice(trace, lo + 1, hi - lo))
        screened = signals.rank_correlation(part, regressor[lo:hi], "__part", f"__r{i}").withColumn(f"__r{i}", F.get(f"__r{i}", F.lit(0))).drop("__part")
    names = [F.col(f"__r{i}") for i in range(len(states))]
    strong = F.greatest(*[F.abs(r) for r in names], F.lit(-1.0)) >= least
    known = [r.isNotNull() for r in names]
    every = known[0]
    for k in known[1:]:
        every = every & k
    screened = materialize(screened.withColumn("skipped", ~(strong & every)), "screened")
    out = None
    for i, (state, window) in enumerate(states.items()):
        fits = models.ridge_scan(screened.filter("not skipped"), cell, regressor, trace, lags, window=window)
        own = screened.select(cell, F.lit(state).alias("state"), F.col(f"__r{i}").alias("spearman_r"), "skipped").join(fits, cell, "left")
        out = own if out is None else out.unionByName(own)
    return out


def beta_ratios(fits: DataFrame, cell: str, first: str, second: str, least_r2: float | None = None, mode: str = "log2") -> DataFrame:
    """(cell, ratio): the second state's beta over the first's (``raw``), or its log2, where both are finite and positive."""
    if mode not in ("log2", "raw"):
        raise ValueError(f"mode {mode!r}: log2 or raw")
    wide = fits.filter("not skipped").groupBy(cell).agg(*[F.max(F.when(F.col("state") == s, populations.finite(c))).alias(f"{c}_{n}") for n, s in (("a", first), ("b", second)) for c in ("beta", "r2")])
    kept = wide.filter((F.col("beta_a") > 0) & (F.col("beta_b") > 0))
    if least_r2 is not None:
        kept = kept.filter((F.col("r2_a") >= least_r2) & (F.col("r2_b") >= least_r2))
    ratio = F.col("beta_b") / F.col("beta_a")
    return kept.select(cell, (F.log2(ratio) if mode == "log2" else ratio).alias("ratio"))


def ratio_map(ratios: DataFrame, centers: DataFrame, cell: Sequence[str], size: Sequence[int], radius: Sequence[int] = (5, 5, 5), least: int = 10, sign: str = "all") -> DataFrame:
    """Box map of the ratios at the cells' registered centers (z, x, y)."""
    points = ratios.join(centers, list(cell))
    if sign != "all":
        points = points.filter(F.col("ratio") > 0 if sign == "positive" else F.col("ratio") < 0)
    return voxels.box_map(points, ["z", "x", "y"], "ratio", radius, size, least)


def export_ratio_map(ratios: DataFrame, centers: DataFrame, cell: Sequence[str], path: str, size: Sequence[int], radius: Sequence[int] = (5, 5, 5), least: int = 10, sign: str = "all", mode: str = "log2", least_r2: float | None = None, animal: str | None = None) -> None:
    """Writes a ratio map below ``path``: ``map`` (its voxels), ``cells`` (the rows that it is made of), and ``provenance``, one row
    with the settings and the number of animals (null without an ``animal`` column), so a map tells how it was made."""
    if sign not in ("all", "positive", "negative"):
        raise ValueError(f"sign {sign!r}: all, positive or negative")
    points = ratios.join(centers, list(cell))
    if sign != "all":
        points = points.filter(F.col("ratio") > 0 if sign == "positive" else F.col("ratio") < 0)
    points.write.mode("overwrite").parquet(f"{path}/cells")
    held = ratios.sparkSession.read.parquet(f"{path}/cells")
    voxels.box_map(held, ["z", "x", "y"], "ratio", radius, size, least).write.mode("overwrite").parquet(f"{path}/map")
    animals = F.count_distinct(animal) if animal else F.lit(None).cast("bigint")
    made = held.agg(F.count(F.lit(1)).alias("cells"), animals.alias("animals"))
    stated = {"mode": F.lit(mode), "sign": F.lit(sign), "least_r2": F.lit(least_r2).cast("double"), "least": F.lit(least), "radius": F.array(*map(F.lit, radius)), "size": F.array(*map(F.lit, size))}
    made.withColumns(stated).write.mode("overwrite").parquet(f"{path}/provenance")


def cluster_activity(cells: DataFrame, labels: DataFrame, cell: str, centers: DataFrame | None = None, least: int = 50, trace: str = "trace") -> tuple[DataFrame, DataFrame | None]:
    """((label, n, activity), (label, cell, z, x, y)): the mean z-scored trace of every label with at least ``least`` cells, and
    the coordinates of these labels' members.

    Cells without a label, negative labels and constant traces are left out; a cell without a center has no coordinates.
    """
    sizes = labels.filter("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    members = materialize(labels.select(cell, "label").join(F.broadcast(sizes), "label"), "members")  # a row a label
    z = signals.zscore(cells.join(members, cell), trace, "z").filter(~signals.has_nan("z"))
    means = populations.label_means(z, "label", "z").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("frame", "mean"))).alias("f"))
    activity = means.join(sizes, "label").select("label", "n", F.col("f.mean").alias("activity"))
    return activity, None if centers is None else members.join(centers, cell).select("label", cell, "z", "x", "y")


def lag_specs(bins: DataFrame, keys: Sequence[str], order: Sequence[str], signals_by_name: Mapping[str, str], specs: Sequence[Mapping[str, int]]) -> DataFrame:
    """Rows of (spec_idx, spec_label, x): the lagged values that each spec asks of each named signal, oldest first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    most = {n: max(s.get(n, 0) for s in specs) for n in signals_by_name}
    history = bins.withColumns({f"__{n}": F.array(*[F.lag(c, k).over(w) for k in range(most[n], 0, -1)]) for n, c in signals_by_name.items() if most[n]})
    made = []
    for i, spec in enumerate(specs):
        parts = [F.slice(f"__{n}", most[n] - k + 1, k) for n, k in spec.items() if k]
        label = ", ".join(f"{n}:{k}" for n, k in spec.items())
        made.append(F.struct(F.lit(i).alias("spec_idx"), F.lit(label).alias("spec_label"), F.concat(*parts).alias("x")))
    spread = history.withColumn("__s", F.explode(F.array(*made)))
    whole = spread.select("*", "__s.*").filter(~F.exists("x", lambda v: v.isNull()))
    return whole.drop("__s", *[f"__{n}" for n in signals_by_name])


def behaviour_runs(rows: DataFrame, fish: str, condition: str, outcome: str, runs: int, seed: int = 0, identity: Sequence[str] = ()) -> DataFrame:
    """One logistic fit per (spec, run, fish, condition): all positives, and each run's own draw of the negatives.

    A row's draw depends on its identity, the run and the seed only, so reruns agree whatever the partitions.
    """
    drawn = rows.withColumn("run_idx", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), "run_idx", *identity), F.lit(1 << 30)) / float(1 << 30)
    kept = drawn.filter(F.col(outcome) | (u < NEGATIVES))
    return models.logistic_fits(kept, ["spec_idx", "spec_label", "run_idx", fish, condition], "x", outcome)


def select_bouts(bouts: DataFrame, onset: str = "onset", gap: str = "gap_before", oxygen: str = "oxygen_before", normal: tuple[float, float] = (5, 20), hypoxia: tuple[float, float] = (30, 40), least_gap: float = 3, most_oxygen: float = 0.01) -> DataFrame:
    """The bouts that a behaviour model is fitted to, with their condition: onsets (minutes) strictly inside ``normal`` or
    ``hypoxia``, after a gap (seconds) above ``least_gap``, with normalised oxygen before the onset below ``most_oxygen``.

    Bouts without a gap before them, or with unknown oxygen, are left out.
    """
    inside = lambda span: (F.col(onset) > span[0]) & (F.col(onset) < span[1])
    named = bouts.withColumn("condition", F.when(inside(normal), "normal").when(inside(hypoxia), "hypoxia"))
    return named.filter(F.col("condition").isNotNull() & (F.col(gap) > least_gap) & (F.col(oxygen) < most_oxygen))


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) from row hashes and a salt, the same wherever the rows lie."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)
        for x in salt:
            h = (h ^ np.uint64(x + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


#: Rows of a bucket of groups, on average, and rows (filled up) that are fitted together; a larger group stands alone.
_BUCKET, _FILLED = 2048, 16_384


def _alike(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Groups by rising size, in pieces of at most ``most`` rows when all are filled up to the piece's largest."""
    pieces: list[list[int]] = []
    for g in np.argsort(sizes, kind="stable").tolist():
        if pieces and (len(pieces[-1]) + 1) * int(sizes[g]) <= most:
            pieces[-1].append(g)
        else:
            pieces.append([g])
    return [np.array(p) for p in pieces]


def model_runs(
    bins: DataFrame, fish: str, condition: str, order: Sequence[str], outcome: str, signals_by_name: Mapping[str, str], specs: Sequence[Mapping[str, int]], runs: int = 20,
    seed: int = 0, tries: int = 1, identity: Sequence[str] = (), inclusive: Sequence[str] = (), most: int = models.FIT_ROWS,
) -> DataFrame:
    """(spec_idx, spec_label, run_idx, fish, condition, tries, n, r2, aic, llf, separated, params): logistic fits of an outcome on
    the history of named signals.

    A fit takes all positives of a fish and condition, and its run's own draw of the negatives. A separated fit is drawn
    again, with a new seed, until it holds or ``tries`` draws are used; the others keep theirs. A spec's lag k takes the k
    bins before a bin, oldest first, and the bin itself for the signals in ``inclusive``; bins without whole history are
    left out. Fits of one outcome only have null metrics.

    Rows are shuffled once, by buckets of about ``_BUCKET`` rows that hold whole groups of a fish and condition; specs, runs and
    draws are formed inside the bucket, so nothing is copied, and small groups are fitted many at a time. A draw depends on the row's identity, run, try and seed only. Groups above ``most`` rows, of which there are few,
    are fitted by sums over all tasks, run by run, with their draws made by Spark.
    """
    w = Window.partitionBy(fish).orderBy(*order)
    lags = {name: max(s.get(name, 0) for s in specs) for name in signals_by_name}
    history = {f"__{n}": F.array(*[F.lag(c, j).over(w).cast("double") for j in range(lags[n], 0, -1)], *([F.col(c).cast("double")] if n in inclusive else [])) for n, c in signals_by_name.items()}
    rows = bins.withColumns(history).withColumn("__h", F.xxhash64(*identity)).withColumn("__y", F.col(outcome).cast("double"))
    rows = materialize(rows.select(fish, condition, "__h", "__y", *history).filter("__y is not null"), "histories")
    kinds = f"spec_idx int, spec_label string, run_idx int, {fish} {rows.schema[fish].dataType.simpleString()}, {condition} {rows.schema[condition].dataType.simpleString()}"
    schema = f"{kinds}, tries int, n long, r2 double, aic double, llf double, separated boolean, params array<double>"
    labels = [", ".join(f"{n}:{k}" for n, k in spec.items()) for spec in specs]

    def fit(table: pa.Table) -> pa.Table:
        """All fits of a bucket's groups, groups of like sizes together."""
        codes = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in (fish, condition)]
        of = codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy()
        y, ids = table.column("__y").to_numpy(), table.column("__h").to_numpy()
        order = np.lexsort((y, ids, of))  # as it comes, a group's order is no one's
        y, ids = y[order], ids[order]
        first, of = np.unique(of[order], return_index=True, return_inverse=True)[1:]
        past = {n: np.asarray(table.column(f"__{n}").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(y), -1)[order] for n in signals_by_name}
        drawn: dict[int, np.ndarray] = {}
        out: list[tuple] = []
        for i, spec in enumerate(specs):
            parts = [past[n][:, lags[n] - spec[n] :] for n in spec if spec[n] or n in inclusive]
            x = np.column_stack([np.ones(len(y)), *parts])
            whole = np.flatnonzero(~np.isnan(x).any(1))
            sizes = np.bincount(of[whole], minlength=len(first))
            starts = np.cumsum(sizes) - sizes
            for some in _alike(sizes, _FILLED):
                width = max(1, int(sizes[some].max()))
                filled = np.arange(width) < sizes[some][:, None]
                at = whole[np.where(filled, starts[some][:, None] + np.arange(width), 0)] if len(whole) else np.zeros(filled.shape, np.int64)
                xs, ys = np.where(filled[:, :, None], x[at], 0.0), np.where(filled, y[at], 0.0)
                left, tried, got = np.ones((len(some), runs), bool), np.ones((len(some), runs), int), {}
                for attempt in range(tries):
                    if attempt not in drawn:
                        drawn[attempt] = np.stack([_uniform(ids, seed, r, attempt) < NEGATIVES for r in range(runs)])
                    go = np.flatnonzero(left.any(1))
                    chosen = (drawn[attempt][:, at[go]].transpose(1, 0, 2) | (ys[go] > 0)[:, None]) & filled[go][:, None] & left[go][:, :, None]
                    new = numeric.grouped_logistic_fits(xs[go], ys[go], chosen)
                    for key, v in new.items():
                        held = got.setdefault(key, np.zeros((len(some), *v.shape[1:]), v.dtype))
                        held[go] = np.where(left[go].reshape(*left[go].shape, *[1] * (v.ndim - 2)), v, held[go])
                    tried[left] = attempt + 1
                    again = np.zeros_like(left)
                    again[go] = new["separated"]
                    left &= again
                    if not left.any():
                        break
                known = np.isfinite(got["llf"])
                keys = [table.column(c).take(pa.array(order[first[some]])).to_pylist() for c in (fish, condition)]
                for j in range(len(some)):
                    out += [(i, labels[i], r, keys[0][j], keys[1][j], int(tried[j, r]), int(got["n"][j, r]), *(float(got[c][j, r]) if known[j, r] else None for c in ("r2", "aic", "llf")), bool(got["separated"][j, r]), got["params"][j, r].tolist() if known[j, r] else None) for r in range(runs)]
        columns = list(zip(*out, strict=True))
        names = ["spec_idx", "spec_label", "run_idx", fish, condition, "tries", "n", "r2", "aic", "llf", "separated", "params"]
        types = [pa.int32(), pa.string(), pa.int32(), table.schema.field(fish).type, table.schema.field(condition).type, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    spark = bins.sparkSession
    # by a stated number: few bytes, which AQE would put together, take many fits
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(tasks, rows.count() // _BUCKET)
    bucketed = lambda df: df.withColumn("__bucket", F.pmod(F.xxhash64(fish, condition), F.lit(buckets)))
    dealt = lambda df: bucketed(df).repartition(tasks, "__bucket").groupBy("__bucket").applyInArrow(fit, schema)
    large = rows.groupBy(fish, condition).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    if not large.limit(1).count():
        return dealt(rows)
    large = materialize(large.drop("__n"), "large")
    small = dealt(rows.join(F.broadcast(large), [fish, condition], "left_anti"))
    made = [F.struct(F.lit(i).alias("spec_idx"), F.lit(labels[i]).alias("spec_label"), F.concat(*[F.slice(f"__{n}", lags[n] - k + 1, k + (n in inclusive)) for n, k in spec.items() if k or n in inclusive]).alias("x")) for i, spec in enumerate(specs)]
    spread = rows.join(F.broadcast(large), [fish, condition]).select(fish, condition, "__h", "__y", F.explode(F.array(*made)).alias("s")).select(fish, condition, "__h", "__y", "s.*")
    left = spread.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v))).withColumn("run_idx", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    whole = small
    for attempt in range(tries):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(attempt), "run_idx", "__h"), F.lit(1 << 30)) / float(1 << 30)
        drawn = left.filter((F.col("__y") > 0) | (u < NEGATIVES))
        fits = materialize(models.logistic_fits(drawn, ["spec_idx", "spec_label", "run_idx", fish, condition], "x", "__y", most).withColumn("tries", F.lit(attempt + 1)), "fits")
        again = fits.filter("separated") if attempt + 1 < tries else fits.limit(0)
        whole = whole.unionByName(fits.join(again.select("spec_idx", "run_idx", fish, condition), ["spec_idx", "run_idx", fish, condition], "left_anti").select(whole.columns))
        if not again.limit(1).count():
            break
        left = left.join(F.broadcast(again.select("spec_idx", "run_idx", fish, condition)), ["spec_idx", "run_idx", fish, condition])
    return whole


def oxygen_correlations(cells: DataFrame, times: DataFrame, curve: DataFrame, cell: str, recording: str, start: float, end: float, clamp: bool = True, trace: str = "trace") -> DataFrame:
    """Adds r and p, the rank correlation of each trace with the oxygen curve at the frames with start < time < end.

    ``times`` has one array ``sec`` a recording; traces and times are cut to the shorter. The curve (sec, value) is linear
    between whole seconds; beyond its ends it takes the end's value, or those frames are left out without ``clamp``. One
    curve a recording is worked out, as long as its frames, and travels to its cells.
    """
    longest = cells.groupBy(recording).agg(F.max(F.size(trace)).alias("__n"))
    frames = times.join(longest, recording).select(recording, F.posexplode(F.slice("sec", F.lit(1), F.col("__n"))).alias("frame", "__t"))
    met = signals.interpolate_curve(frames.filter((F.col("__t") > start) & (F.col("__t") < end)), "__t", curve, "__o", clamp)
    oxygen = materialize(met.groupBy(recording).agg(F.sort_array(F.collect_list(F.struct("frame", "__o"))).alias("__f")).select(recording, "__f.frame", "__f.__o"), "oxygen")
    joined = cells.join(oxygen, recording)
    held = F.filter(F.transform("frame", lambda i: F.get(trace, i)), lambda v: v.isNotNull())
    cut = materialize(joined.withColumn("__v", held).withColumn("__o", F.slice("__o", F.lit(1), F.size("__v"))), "paired")
    scored = signals.paired_rank_correlation(cut, "__v", "__o", "r").withColumn("p", signals.spearman_p("r", F.size("__v").cast("long")))
    return scored.withColumnRenamed("__v", "inside").drop("frame", "__o")


def oxygen_reference_bins(cells: DataFrame, times: DataFrame, curve: DataFrame, cell: str, recording: str, start: float, end: float, trace: str = "trace") -> DataFrame:
    """(cell, r, rs, best_r, best): each cell's rank correlations with the mean z-scored trace of every bin of oxygen
    correlation that has cells, the largest of them, and its place."""
    scored = materialize(oxygen_correlations(cells, times, curve, cell, recording, start, end, trace=trace).select(cell, "r", "inside"), "scored")
    z = signals.zscore(scored, "inside").withColumn("bin", populations.reference_bin(F.col("r")))
    labels, traces = populations.templates(populations.label_means(z.filter("bin is not null"), "bin"), "bin")
    if not labels:
        return scored.select(cell, "r", F.array().cast("array<double>").alias("rs"), F.lit(None).cast("double").alias("best_r"), F.lit(None).cast("int").alias("best"))
    matched = signals.rank_correlation(scored, traces, "inside", "rs")
    return matched.select(cell, "r", "rs", F.array_max("rs").alias("best_r"), (F.array_position("rs", F.array_max("rs")) - 1).cast("int").alias("best"))


def camera_triggers(samples: DataFrame, keys: Sequence[str], position: str, value: str, level: float = 3.8) -> DataFrame:
    """(keys, frame, sample_idx): the samples at which the camera's channel rises through the level, numbered from 0."""
    edges = signals.rising_edges(samples, keys, [position], value, level)
    return edges.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(position)) - 1).alias("frame"), F.col(position).alias("sample_idx"))


def swim_by_frame(samples: DataFrame, triggers: DataFrame, key: str, position: str, signal: str, background: str) -> DataFrame:
    """(key, frame, swim): the signal above its background, at least 0, summed over the last samples up to each trigger, as
    many as the least distance of two triggers (all up to it, where there is one trigger only).

    Windows do not overlap, so a sample is summed once, in the window it lies in: an equality join on buckets of the
    window's width, two rows a trigger. A NaN makes its own frame NaN; frames without samples are null.
    """
    widths = signals.least_step(triggers, [key], ["sample_idx"], "sample_idx").withColumnRenamed("least_step", "__w")
    ends = materialize(triggers.join(widths, key).withColumn("__w", F.coalesce("__w", F.col("sample_idx") + 1)).select(key, "frame", F.col("sample_idx").alias("__end"), "__w"), "windows")
    bucket = F.floor(F.col("__end") / F.col("__w"))
    opened = ends.select(key, "frame", "__end", F.explode(F.array(bucket - 1, bucket)).alias("__b"))
    above = samples.join(F.broadcast(ends.groupBy(key).agg(F.first("__w").alias("__w"))), key)  # a row a recording
    above = above.select(key, position, F.greatest(F.col(signal) - F.col(background), F.lit(0.0)).alias("__a"), "__w", F.floor(F.col(position) / F.col("__w")).alias("__b"))
    inside = (F.col(position) <= F.col("__end")) & (F.col(position) > F.col("__end") - F.col("__w"))
    sums = above.join(opened, [key, "__b"]).filter(inside).groupBy(key, "frame").agg(F.sum("__a").alias("swim"))
    return triggers.select(key, "frame").join(sums, [key, "frame"], "left")


def bout_bins(bouts: DataFrame, samples: DataFrame, key: str, position: str, values: Sequence[str], width: int, before: int, after: int) -> DataFrame:
    """(key, bout, bin, <value> means, duration, gap_before, gap_after) in bins of ``width`` samples around each onset.

    Bins count from the window's start. Bouts keep twice the window's room on both sides and the last of them is left out;
    gaps are from the previous end and to the next onset of all bouts. A last partial bin is dropped.
    """
    w = Window.partitionBy(key).orderBy("start")
    vectors = bouts.withColumns({"duration": F.col("end") - F.col("start"), "gap_before": F.col("start") - F.lag("end").over(w), "gap_after": F.lead("start").over(w) - F.col("end")})
    last = samples.groupBy(key).agg((F.max(position) + 1).alias("__n"))
    roomy = vectors.join(last, key).filter((F.col("start") - 2 * before > 0) & (F.col("start") + 2 * after < F.col("__n")))
    kept = roomy.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("start")))).filter("__k > 1").drop("__k", "__n")
    met = events.event_windows(kept, samples, [key], "start", position, before, after)
    place = F.floor((F.col("offset") + before) / width).cast("int")
    binned = met.groupBy(key, "bout", place.alias("bin")).agg(F.count(F.lit(1)).alias("__c"), *[F.avg(v).alias(v) for v in values], *[F.first(v).alias(v) for v in ("duration", "gap_before", "gap_after")])
    return binned.filter(F.col("__c") == width).drop("__c")


def guard_edges(bouts: DataFrame, keys: Sequence[str], start: str, end: str, before: float, after: float, length: float) -> DataFrame:
    """Bouts with room for two windows on either side, without the last one that qualifies."""
    roomy = bouts.filter((F.col(start) - 2 * before > 0) & (F.col(end) + 2 * after < length))
    return roomy.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(start)))).filter("__k > 1").drop("__k")


def baseline_clusters(cells: DataFrame, cell: str, frames: int, k: int = 20, loading: float = 0.4, least_cells: int = 100, assign: float = 0.4, trace: str = "trace", least_explained: float | None = None) -> tuple[DataFrame, DataFrame]:
    """((cell, label, best_r, explained), (label, n, mean by frame)): principal components give seed groups, their mean traces
    are templates, cells join the best one.

    Traces are z-scored, constant ones left out; everything after goes by what the first ``k`` components rebuild of them.
    A seed is a cell with one score above ``loading`` of its largest; a (component, sign) group needs more than
    ``least_cells`` of them. Labels number the groups by component, the negative side first. Cells whose best rank
    correlation is below ``assign``, and those of which no more than ``least_explained`` is explained, have none. The second
    table has the refined means: of all members of each label.
    """
    z = materialize(signals.zscore(cells.select(cell, trace), trace, "z").filter(~signals.has_nan("z")).select(cell, F.col("z").alias(trace)), "z")
    parts = materialize(models.principal_components(z, cell, frames, k, trace, rebuilt=True), "components")
    kept = parts if least_explained is None else parts.filter(F.col("explained") > least_explained)
    seeds = populations.seed_groups(kept, "scores", loading).filter("seed").withColumn("group", 2 * F.col("component") + (F.col("sign") > 0).cast("int"))
    big = seeds.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least_cells).select("group")
    members = seeds.join(F.broadcast(big), "group")  # at most 2k groups
    labels, traces = populations.templates(populations.label_means(members, "group", "rebuilt"), "group")
    none = parts.select(cell, F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("best_r"), "explained")
    if not labels:
        return none, none.select("label", F.lit(0).cast("bigint").alias("n"), F.array().cast("array<double>").alias("mean")).limit(0)
    scored = populations.assign_templates(kept, list(range(len(labels))), traces, assign, "rebuilt", "label")
    assigned = materialize(scored.select(cell, "label", "best_r", "explained", "rebuilt"), "assigned")
    refined = populations.label_means(assigned.filter("label is not null"), "label", "rebuilt")
    _, means = populations.templates(refined, "label")
    of = [r.label for r in refined.select("label").distinct().orderBy("label").collect()]  # a row a label
    sizes = assigned.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    table = cells.sparkSession.createDataFrame([(int(i), m.tolist()) for i, m in zip(of, means, strict=True)], "label int, mean array<double>")
    rest = none if least_explained is None else none.join(kept.select(cell), cell, "left_anti")
    whole = assigned.drop("rebuilt") if least_explained is None else assigned.drop("rebuilt").unionByName(rest)
    return whole, table.join(sizes, "label").select("label", "n", "mean")


def subclusters(cells: DataFrame, cluster: str, cell: str, k: int | None, assign: float = 0.4, trace: str = "trace", least: int = 1, most: int = 30_000) -> DataFrame:
    """(cluster, cell, sub): Ward clusters within each cluster, numbered through by a running offset over clusters; clusters
    under ``least`` cells stay whole."""
    inner = materialize(models.ward_groups(cells, cluster, cell, trace, most, k, least), "inner")
    sizes = inner.groupBy(cluster).agg(F.max("sub").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy(cluster).rowsBetween(Window.unboundedPreceding, -1)  # one row a cluster
    offsets = sizes.select(cluster, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return inner.join(F.broadcast(offsets), cluster).select(cluster, cell, (F.col("sub") + F.col("__o")).cast("int").alias("sub"))


def factor_subclusters(cells: DataFrame, cluster: str, cell: str, frames: int, k: int = 20, loading: float = 0.1, least_cells: int = 100, assign: float = 0.4, trace: str = "trace", rounds: int = 20) -> DataFrame:
    """(cluster, cell, sub): subclusters of every cluster (integers) by factors of its own cells, all clusters in the same passes.

    Cells whose loading lies beyond ``loading`` on a side of a factor are that side's seeds; sides with more than
    ``least_cells`` give a template each, the mean of their z-scored traces. Cells join the template of the best rank
    correlation (the first on ties). Where a cluster has cells below ``assign``, these become its first subcluster. Numbers
    run on over the clusters; cells of clusters without a template are -1.
    """
    z = materialize(signals.zscore(cells.select(F.col(cluster).cast("int").alias("g"), cell, trace), trace, "z").filter(~signals.has_nan("z")).select("g", cell, "z"), "z")
    found = [r.g for r in z.filter("g is not null").select("g").distinct().collect()]  # a row a cluster
    loads, _ = factors.factor_models(z, "g", cell, frames, dict.fromkeys(found, k), rounds, "z")
    sides = F.flatten(F.transform("loadings", lambda x, i: F.when(x < -loading, F.array(2 * i)).when(x > loading, F.array(2 * i + 1)).otherwise(F.array().cast("array<int>"))))
    seeds = materialize(loads.select("g", cell, F.explode(sides).alias("side")), "seeds")
    big = seeds.groupBy("g", "side").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least_cells).select("g", "side")
    members = seeds.join(F.broadcast(big), ["g", "side"]).join(z, ["g", cell])  # at most 2k sides a cluster
    means = signals.to_frames(members, "z", "v", "g", "side").groupBy("g", "side", "frame").agg(F.avg("v").alias("v"))
    rows = means.groupBy("g", "side").agg(F.sort_array(F.collect_list(F.struct("frame", "v"))).alias("f")).select("g", "side", F.col("f.v").alias("t")).orderBy("g", "side").collect()
    templates: dict[int, list] = {}
    for r in rows:  # at most 2k a cluster, each as long as the frames
        templates.setdefault(r.g, []).append(r.t)
    best = materialize(populations.best_of_group(z, templates, "g", "z"), "best")
    local = F.when(F.col("best_r") < assign, F.lit(-1)).otherwise(F.col("best"))
    placed = best.filter("best is not null").withColumn("local", local)
    spans = placed.groupBy("g").agg(F.min("local").alias("low"), F.max("local").alias("high"))
    shifted = spans.select("g", F.when(F.col("low") < 0, 1).otherwise(0).alias("shift"), "high")
    before = Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row a cluster
    offsets = shifted.select("g", (F.col("shift") + F.coalesce(F.sum(F.col("high") + F.col("shift") + 1).over(before), F.lit(0))).alias("shift"))
    sub = best.withColumn("local", local).join(F.broadcast(offsets), "g", "left")
    return sub.select(F.col("g").alias(cluster), cell, F.coalesce(F.when(F.col("best").isNotNull(), F.col("local") + F.col("shift")), F.lit(-1)).cast("int").alias("sub"))


def hierarchical_labels(cells: DataFrame, cell: str, frames: int, k: int = 100, share: float = 0.05, settled: float = 0.9, noisy: float = 0.3, floor: float = 0.2, rounds: int = 100, factor_rounds: int = 20, trace: str = "trace") -> DataFrame:
    """(cell, label): factor labels, refined until every cluster has under ``share`` of the cells or is settled.

    A larger cluster (at most 1 / share of them at a time) is factored again over its own cells, all of a round in the same
    passes; members with a positive new label move to new ids after the current largest. It is settled, with its parts, if over ``settled`` of its members
    stay or over that share moves. Factors whose scores lose ``noisy`` of their energy to a low-pass do not count. Every
    round splits or settles each large cluster, so the loop ends; one that does not within ``rounds`` is an error.
    Every round is a written table.
    """
    k = min(k, frames)
    quiet = lambda scores: [int(i) for i in np.flatnonzero(models.noise_ratios(scores) < noisy)]
    loads, scores = models.factor_model(cells, cell, frames, k, factor_rounds, trace)
    labels = models.loading_labels(loads, cell, floor, quiet(scores)).select(cell, "label")
    labels, done, most = materialize(labels, "labels"), set(), k
    for _ in range(rounds):
        counts = {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cluster
        total = sum(counts.values())
        big = sorted(x for x, n in counts.items() if x is not None and n >= share * total and x not in done)
        if not big:
            return labels
        top = max(x for x in counts if x is not None) + 1
        parts = {x: min(most, frames, max(1, counts[x] // 1000)) for x in big}
        firsts = dict(zip(big, (top + np.r_[0, np.cumsum([parts[x] for x in big])[:-1]]).tolist(), strict=True))
        members = cells.join(labels.filter(F.col("label").isin(big)), cell)
        inner, scores = factors.factor_models(members, "label", cell, frames, parts, factor_rounds, trace)
        keep = F.create_map(*[c for x in big for c in (F.lit(x), F.array(*map(F.lit, quiet(scores[x]))).cast("array<int>"))])[F.col("label")]
        audible = inner.withColumn("loadings", F.transform("loadings", lambda x, i: F.when(F.array_contains(keep, i), x).otherwise(F.lit(0.0)))).withColumnRenamed("label", "__of").drop("noise")
        own = models.loading_labels(audible.withColumn("__first", F.create_map(*[F.lit(int(v)) for x in firsts.items() for v in x])[F.col("__of")]), cell, floor)
        moved = materialize(own.filter("label >= 0").select(cell, "__of", (F.col("label") + F.col("__first")).cast("int").alias("new")), "moved")
        went = {r["__of"]: r.n for r in moved.groupBy("__of").agg(F.count(F.lit(1)).alias("n")).collect()}
        for x in big:
            n = went.get(x, 0)
            if counts[x] - n > settled * counts[x] or n > settled * counts[x]:
                done |= {x} | {firsts[x] + i for i in range(parts[x])}
        labels = materialize(labels.join(moved.drop("__of"), cell, "left").select(cell, F.coalesce("new", "label").alias("label")), "labels")
        most = max(int(np.mean(list(parts.values()))) + 5, 20)
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")
