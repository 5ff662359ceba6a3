"""Voxel maps and cell geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.signals import exact_quantiles


def box_map(points: DataFrame, axes: Sequence[str], value: str, radius: Sequence[int], size: Sequence[int], least: int = 10) -> DataFrame:
    """(axes, n, mean): mean value of the points within a half-open box [c - r, c + r) of each voxel, if n >= least.

    Points are rounded half to even and summed per voxel; then one axis at a time is spread and summed again, so a
    point makes 2r rows an axis, not (2r)^3, and every step starts from partial sums.
    """
    at = points.select(*[F.rint(a).cast("int").alias(a) for a in axes], F.col(value).alias("__v"))
    for a, s in zip(axes, size, strict=True):
        at = at.filter((F.col(a) > 0) & (F.col(a) < s - 1))
    sums = at.groupBy(*axes).agg(F.sum("__v").alias("s"), F.count(F.lit(1)).alias("n"))
    for a, r, s in zip(axes, radius, size, strict=True):
        spread = F.explode(F.sequence(F.greatest(F.col(a) - r, F.lit(0)), F.least(F.col(a) + r - 1, F.lit(s - 1))))
        sums = sums.select(*[x for x in axes if x != a], spread.alias(a), "s", "n").groupBy(*axes).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= least).select(*axes, "n", (F.col("s") / F.col("n")).alias("mean"))


def overlap_map(points: DataFrame, animal: str, axes: Sequence[str], kernels: Sequence[Sequence[float]], size: Sequence[int], share: float = 0.1) -> DataFrame:
    """(axes, animals): in how many animals the smoothed map of distinct voxels exceeds ``share`` of its maximum.

    Kernels are odd and separable; what they would put beyond an edge is reflected.
    """
    maps = points.select(animal, *axes).distinct().withColumn("v", F.lit(1.0))
    for a, kernel, s in zip(axes, kernels, size, strict=True):
        half = len(kernel) // 2
        parts = F.array(*[F.struct((F.col(a) + k - half).alias("x"), (F.col("v") * float(w)).alias("v")) for k, w in enumerate(kernel)])
        spread = maps.select(animal, *[x for x in axes if x != a], F.explode(parts).alias("p"))
        x = F.col("p.x")
        inside = F.when(x < 0, -1 - x).when(x >= s, 2 * s - 1 - x).otherwise(x)
        maps = spread.select(animal, *[x for x in axes if x != a], inside.alias(a), F.col("p.v").alias("v")).groupBy(animal, *axes).agg(F.sum("v").alias("v"))
    top = maps.groupBy(animal).agg(F.max("v").alias("top"))
    return maps.join(top, animal).filter(F.col("v") > F.col("top") * share).groupBy(*axes).agg(F.count(F.lit(1)).alias("animals"))


def affine(df: DataFrame, axes: Sequence[str], matrix: Sequence[Sequence[float]], shift: Sequence[float], source_voxel: Sequence[float], target_voxel: Sequence[float]) -> DataFrame:
    """Adds <axis>_reg: (matrix * (point * source_voxel) + shift) / target_voxel."""
    scaled = [F.col(a) * float(v) for a, v in zip(axes, source_voxel, strict=True)]
    moved = {}
    for i, a in enumerate(axes):
        total: Column = F.lit(float(shift[i]))
        for j, p in enumerate(scaled):
            total = total + p * float(matrix[i][j])
        moved[f"{a}_reg"] = total / float(target_voxel[i])
    return df.withColumns(moved)


def weighted_centroid(points: DataFrame, keys: Sequence[str], axes: Sequence[str], weight: str, least: float = 0.005) -> DataFrame:
    """Centroids by weight; weights of at most ``least``, NaN and null count nothing."""
    w = F.when(~F.isnan(weight) & (F.col(weight) > least), F.col(weight)).otherwise(F.lit(0.0))
    kept = points.withColumn("__w", w)
    return kept.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col("__w") * F.col(a)), F.sum("__w")).alias(a) for a in axes])


def normalise_intensity(df: DataFrame, value: str, low: float, high: float, name: str = "normal") -> DataFrame:
    """Adds the value clipped to its high percentile, less its low one, floored at 0, over the maximum that leaves.

    ``df`` is read several times: the percentiles come from counted histograms, not from a gathered column.
    """
    lo, hi = exact_quantiles(df, value, [low, high])
    if lo is None or hi is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    clipped = F.greatest(F.least(F.col(value), F.lit(hi)) - F.lit(lo), F.lit(0.0))
    return df.withColumn(name, F.try_divide(clipped, F.lit(hi - lo)))


def inside_volume(df: DataFrame, axes: Sequence[str], size: Sequence[int]) -> DataFrame:
    """The points strictly between 0 and size - 1 on every axis, before any rounding."""
    for a, n in zip(axes, size, strict=True):
        df = df.filter((F.col(a) > 0) & (F.col(a) < n - 1))
    return df


def z_panels(cells: DataFrame, z: str, depth: int = 3) -> DataFrame:
    """Adds panel = z div depth."""
    return cells.withColumn("panel", F.floor(F.col(z) / depth).cast("int"))


def max_projection(voxels: DataFrame, axes: Sequence[str], value: str) -> DataFrame:
    return voxels.groupBy(*axes).agg(F.max(value).alias(value))


def population_gaussian(sigma: float, truncate: float = 1.0) -> list[float]:
    """A normalised Gaussian of radius int(truncate * sigma + 0.5)."""
    import math

    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def best_per_cell(fits: DataFrame, cell: Sequence[str], score: str, tie: str) -> DataFrame:
    """The row with the highest finite score of each cell; the lower ``tie`` wins equal scores."""
    w = Window.partitionBy(*cell).orderBy(F.desc("__s"), tie)
    ranked = fits.withColumn("__s", F.when(~F.isnan(score), F.col(score))).filter("__s is not null")
    return ranked.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__s", "__k")
