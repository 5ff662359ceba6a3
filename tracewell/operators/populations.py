"""Cell populations: cluster templates, label assignment, reference bins and group statistics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.kernels import numeric
from tracewell.operators.signals import let, rank_correlation, to_frames
from tracewell.session import materialize


def label_means(cells: DataFrame, label: str, value: str = "z", least: int = 1) -> DataFrame:
    """(label, frame, mean, n): the mean trace of each label with at least ``least`` cells; unassigned (null) left out."""
    frames = to_frames(cells.filter(F.col(label).isNotNull()), value, "value", label)
    means = frames.groupBy(label, "frame").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.filter(F.col("n") >= least)


def templates(means: DataFrame, label: str) -> tuple[list, np.ndarray]:
    """Labels and their traces; a handful of clusters, whatever the number of cells."""
    rows = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("frame", "mean"))).alias("t")).orderBy(label).collect()
    return [r[0] for r in rows], np.array([[x["mean"] for x in r.t] for r in rows], float)


def assign_templates(cells: DataFrame, labels: Sequence, traces: np.ndarray, least: float = 0.4, trace: str = "trace", name: str = "assigned") -> DataFrame:
    """Adds the label of the best-correlated template (ranks; the first wins ties) and best_r; null below ``least``."""
    scored = rank_correlation(cells, traces, trace, "__r")
    rounded = F.transform("__r", lambda r, i: F.struct(F.coalesce(F.round(r, 9), F.lit(0.0)).alias("r"), (-i).alias("i")))
    best = F.array_max(rounded)
    named = F.array(*[F.lit(x) for x in labels])
    found = scored.withColumn("__b", best).withColumn("best_r", F.col("__b.r"))
    return found.withColumn(name, F.when(F.col("best_r") >= least, F.get(named, -F.col("__b.i")))).drop("__r", "__b")


def seed_groups(cells: DataFrame, scores: str, ratio: float = 0.4) -> DataFrame:
    """Adds component (place of the largest absolute score), sign, and seed: no other score exceeds ``ratio`` of it."""
    size = F.transform(scores, lambda x: F.abs(x))
    component = let(F.array_max(size), lambda m: F.array_position(size, m).cast("int") - 1)
    alone = let(F.array_max(size), lambda m: F.size(F.filter(size, lambda x: x > m * ratio)) == 1)
    return cells.withColumns({"component": component, "seed": alone}).withColumn("sign", F.signum(F.get(scores, F.col("component"))).cast("int"))


def reference_bin(r: Column, width: float = 0.1) -> Column:
    """Bin of a correlation between -0.8 and 0.8 in steps, with one open bin to -1 and one to 1; null on an edge."""
    scaled = F.round(r / width, 9)
    inner = F.when(scaled == F.floor(scaled), None).otherwise(F.floor(scaled) + 9)
    return F.when((r > -1) & (scaled < -8), 0).when((scaled > 8) & (r < 1), 17).when((scaled > -8) & (scaled < 8), inner).cast("int")


def d_prime(frames: DataFrame, keys: Sequence[str], frame: str, value: str, first: tuple[int, int], second: tuple[int, int], spread: tuple[int, int]) -> DataFrame:
    """Difference of two window means over the pooled deviation of the first and the spread window."""
    within = lambda w: (F.col(frame) >= w[0]) & (F.col(frame) < w[1])
    pick = lambda w: F.when(within(w), F.col(value))
    stats = frames.groupBy(*keys).agg(
        F.avg(pick(first)).alias("m1"), F.avg(pick(second)).alias("m2"), F.var_pop(pick(first)).alias("v1"), F.var_pop(pick(spread)).alias("v2")
    )
    return stats.select(*keys, F.try_divide(F.col("m1") - F.col("m2"), F.sqrt((F.col("v1") + F.col("v2")) / 2)).alias("d_prime"))


def best_of_group(cells: DataFrame, templates: Mapping[int, Sequence[Sequence[float]]], group: str, trace: str) -> DataFrame:
    """Adds best_r and best: the largest rank correlation with the templates of the cell's group, and its place (the first
    on ties; an undefined one counts as the least); null without templates. Templates are few and travel to the cells."""
    shared = cells.sparkSession.sparkContext.broadcast({g: np.array(t, float) for g, t in templates.items()})

    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for groups, traces in batches:
            of = np.array([-1 if g not in shared.value else g for g in groups.to_pylist()])
            r, at = np.full(len(of), np.nan), np.zeros(len(of), np.int64)
            for g in np.unique(of[of >= 0]).tolist():
                rows = np.flatnonzero(of == g)
                x = np.asarray(traces.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), -1)
                scored = np.nan_to_num(numeric.rank_correlations(x, shared.value[g]), nan=-np.inf)
                at[rows], r[rows] = scored.argmax(1), np.maximum(scored.max(1), -1.0)
            none = of < 0
            yield pa.StructArray.from_arrays([pa.array(r, mask=none), pa.array(at.astype(np.int32), mask=none)], ["best_r", "best"])

    kind = T.StructType([T.StructField("best_r", T.DoubleType()), T.StructField("best", T.IntegerType())])
    return cells.withColumn("__b", F.arrow_udf(work, kind)(group, trace)).select(*cells.columns, "__b.*")


# model-run summaries


def finite(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def summarise(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, std (population) and median of the finite values."""
    clean = df.withColumn("__v", finite(value))
    return clean.groupBy(*keys).agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"), F.percentile("__v", 0.5).alias("median"))


def mean_of_means(df: DataFrame, unit: Sequence[str], over: str, value: str) -> DataFrame:
    """Mean and standard error over units (animals) of each unit's own mean; null keys are groups."""
    per = df.groupBy(*unit, over).agg(F.avg(finite(value)).alias("m"))
    return per.groupBy(*unit).agg(F.avg("m").alias("mean"), F.try_divide(F.stddev_samp("m"), F.sqrt(F.count("m").cast("double"))).alias("se"), F.count("m").alias("units"))


def two_way_sums(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """One row of additive two-way ANOVA sums for a balanced table: ss_a, ss_b, ss_error and degrees of freedom.

    Cells are averaged first, so one row a (a, b) pair enters the sums.
    """
    cells = df.groupBy(a, b).agg(F.avg(value).alias("y"))
    grand = cells.agg(F.avg("y").alias("g"))
    ma, mb = (cells.groupBy(k).agg(F.avg("y").alias(f"m{n}"), F.count(F.lit(1)).alias(f"n{n}")) for k, n in ((a, "a"), (b, "b")))
    one = lambda m, n: m.crossJoin(grand).agg(F.sum(F.col(f"n{n}") * F.pow(F.col(f"m{n}") - F.col("g"), 2)).alias(f"ss_{n}"), (F.count(F.lit(1)) - 1).alias(f"df_{n}"))
    total = cells.crossJoin(grand).agg(F.sum(F.pow(F.col("y") - F.col("g"), 2)).alias("ss"), (F.count(F.lit(1)) - 1).alias("df"))
    joined = one(ma, "a").crossJoin(one(mb, "b")).crossJoin(total)  # one row each
    return joined.select("ss_a", "ss_b", (F.col("ss") - F.col("ss_a") - F.col("ss_b")).alias("ss_error"), "df_a", "df_b", (F.col("df") - F.col("df_a") - F.col("df_b")).alias("df_error"))


def bin_counts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(keys, label, n, rank): group sizes, the largest first, ties by label."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), label)))


# filters on fitted cells


def active_cells(cells: DataFrame, p: str = "p", mean: float = 20, std: float = 2, variation: float = 0.05, most_p: float = 0.001) -> DataFrame:
    """Cells whose mean, std and their ratio exceed their floors and whose p-value is below ``most_p``."""
    return cells.filter((F.col("mean") > mean) & (F.col("std") > std) & (F.try_divide("std", "mean") > variation) & (F.col(p) < most_p))


def significant(df: DataFrame, p: str, most: float = 0.05) -> DataFrame:
    return df.filter(finite(p) < most)


def on_grid(df: DataFrame, unit: str, axes: dict[str, Sequence], value: str) -> DataFrame:
    """(unit, axes, value) for every unit and every combination of the axes' values, null where ``df`` has no row."""
    grid = df.select(unit).distinct()
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df.groupBy(unit, *axes).agg(F.first(value).alias(value)), [unit, *axes], "left")


def summarise_runs(fits: DataFrame, keys: Sequence[str], values: Sequence[str] = ("r2", "aic")) -> DataFrame:
    """(keys, fits, <value>_n, <value>_mean, <value>_std, <value>_median) over the runs' finite values; null keys are groups."""
    made = []
    for v in values:
        x = finite(v)
        made += [F.count(x).alias(f"{v}_n"), F.avg(x).alias(f"{v}_mean"), F.stddev_pop(x).alias(f"{v}_std"), F.median(x).alias(f"{v}_median")]
    return fits.groupBy(*keys).agg(F.count(F.lit(1)).alias("fits"), *made)


def anova_sums(means: DataFrame, condition: str, small: str, large: str, value: str, levels: Sequence) -> DataFrame:
    """(condition, part, i, j, v): the sums of an additive model's normal equations, the larger factor eliminated.

    ``means`` has one row a (condition, small, large); ``levels`` are those of the smaller factor. Parts: ``c`` (i, j), the
    Schur complement diag(n) - N diag(1 / n_large) N'; ``q`` (i), its right side; ``t`` and ``n`` (i), sums and counts by
    level; ``r``, the sum over the larger factor's levels of sum^2 / count; ``y``, of squares; ``m`` rows, ``k`` levels of the
    larger factor. Tasks add up whole batches of the larger factor's levels, so only these sums are shuffled.
    """
    k, level = len(levels), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    place = F.create_map(*[x for i, level in enumerate(levels) for x in (F.lit(str(level)), F.lit(i))])
    rows = means.groupBy(condition, large).agg(F.collect_list(F.struct(F.element_at(place, level(small)).alias("i"), F.col(value).cast("double").alias("y"))).alias("cells"))
    rows = rows.select(condition, F.col("cells.i").alias("i"), F.col("cells.y").alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            at, y = batch.column(1), batch.column(2)
            row = np.repeat(np.arange(len(names)), np.diff(at.offsets.to_numpy()))
            one, held = np.zeros((len(names), k)), np.zeros((len(names), k))
            one[row, at.flatten().to_numpy()] = 1.0
            held[row, at.flatten().to_numpy()] = y.flatten().to_numpy()
            for name in set(names):
                of = np.array([x == name for x in names])
                m, v = one[of], held[of]
                n, t = m.sum(1), v.sum(1)
                made = [np.diag(m.sum(0)) - (m / n[:, None]).T @ m, v.sum(0) - m.T @ (t / n), v.sum(0), m.sum(0), np.array([(t * t / n).sum(), (v * v).sum(), n.sum(), float(of.sum())])]
                sums[name] = [a + b for a, b in zip(sums[name], made, strict=True)] if name in sums else made
        out = [[], [], [], [], []]
        for name, (c, q, t, n, rest) in sums.items():
            for part, i, j, v in [
                *(("c", i, j, c[i, j]) for i in range(k) for j in range(k)), *(("q", i, 0, q[i]) for i in range(k)), *(("t", i, 0, t[i]) for i in range(k)), *(("n", i, 0, n[i]) for i in range(k)),
                *((p, 0, 0, x) for p, x in zip("rymk", rest, strict=True)),
            ]:
                for held, x in zip(out, (name, part, i, j, float(v)), strict=True):
                    held.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.float64())], ["condition", "part", "i", "j", "v"])

    pieces = rows.withColumn(condition, F.col(condition).cast("string")).mapInArrow(work, "condition string, part string, i int, j int, v double")
    return pieces.groupBy("condition", "part", "i", "j").agg(F.sum("v").alias("v"))


def two_way_anova(df: DataFrame, a: str, b: str, value: str, condition: str | None = None) -> DataFrame:
    """(condition, term, sum_sq, df, f, p): additive two-way ANOVA, type II, on the means of (condition, a, b).

    One table a condition and one of all conditions' means, named ``combined``. Cells may be missing: each term's sum is
    what the fit without it leaves more than the full fit. The factor with fewer levels is solved for; the other one, of
    any number of levels, is eliminated in sums (``anova_sums``), so the driver gets the square of the fewer levels.
    Non-finite values are left out; a table without any has no rows.
    """
    spark = df.sparkSession
    named = df.withColumn("__c", F.coalesce(F.col(condition).cast("string"), F.lit("None")) if condition else F.lit("combined"))
    each = named.groupBy("__c", a, b).agg(F.avg(finite(value)).alias("__m")).filter("__m is not null")
    each = materialize(each, "means") if condition else each
    both = each.groupBy(a, b).agg(F.avg("__m").alias("__m")).select(F.lit("combined").alias("__c"), a, b, "__m")
    means = materialize(each.unionByName(both) if condition else both, "cells")
    size = means.agg(F.count_distinct(F.struct(a)), F.count_distinct(F.struct(b)), F.avg("__m")).first()  # nulls are a level
    if not size[0] or not size[1]:
        return spark.createDataFrame([], "condition string, term string, sum_sq double, df double, f double, p double")
    small, large = (a, b) if size[0] <= size[1] else (b, a)
    levels = sorted((r[0] for r in means.select(F.coalesce(F.col(small).cast("string"), F.lit("None"))).distinct().collect()), key=str)  # the fewer
    sums: dict[str, dict] = {}
    for r in anova_sums(means.withColumn("__m", F.col("__m") - size[2]), "__c", small, large, "__m", levels).collect():
        sums.setdefault(r.condition, {})[r.part, r.i, r.j] = r.v

    rows = []
    for name, of in sorted(sums.items()):
        c = np.array([[of["c", i, j] for j in range(len(levels))] for i in range(len(levels))])
        q, t, n = (np.array([of[p, i, 0] for i in range(len(levels))]) for p in "qtn")
        adjusted = float(q @ np.linalg.lstsq(c, q, rcond=1e-10)[0])  # of the smaller factor, given the larger
        alone = float((t[n > 0] ** 2 / n[n > 0]).sum())
        terms = {small: (adjusted, (n > 0).sum() - 1), large: (of["r", 0, 0] + adjusted - alone, of["k", 0, 0] - 1)}
        full = max(0.0, of["y", 0, 0] - of["r", 0, 0] - adjusted)
        free = of["m", 0, 0] - 1 - sum(k for _, k in terms.values())
        for term, column in (("a", a), ("b", b)):
            ss, k = terms[column]
            f = float((ss / k) / (full / free)) if k and free > 0 and full > 0 else None
            rows.append((name, term, float(ss), float(k), f, None if f is None else numeric.f_p(f, k, free)))
        rows.append((name, "error", full, float(free), None, None))
    return spark.createDataFrame(rows, "condition string, term string, sum_sq double, df double, f double, p double")
