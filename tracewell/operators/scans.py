"""Scans of one long signal by many tasks.

Rows of a signal are numbered, and blocks of numbers are what a task gets. A frame of a bounded number of rows needs its
block and a halo of neighbours; a scan from the signal's start needs what the blocks before come to, which a
second, short scan over one row a block gives. The operators on signals and events take ``block``, the rows of a
block: without it a signal is one window, which suits many short ones; with it a signal of any length is
dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracewell.session import materialize

#: Rows of a block, where nothing else is said.
BLOCK = 1 << 20


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns whose nulls are values; the right side's copies are dropped."""
    named = right.select([F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return left.join(named, same, how).drop(*[f"__r_{c}" for c in on])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Adds the row's number in its signal, from 0, in the order of ``order`` (nulls first, ties in any order).

    A range partitioning by keys and order puts the rows in order; what the pieces before hold of a signal is added, one
    row a piece and signal. The rows are written once, so their numbers stay.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = materialize(dealt.withColumns({"__piece": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ordered")
    pieces = dealt.groupBy(*keys, "__piece").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    shifts = pieces.select(*keys, "__piece", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return _meet(dealt, shifts, [*keys, "__piece"]).withColumn(name, F.col("__at") + F.col("__shift")).drop("__piece", "__at", "__shift")


def with_halo(df: DataFrame, place: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Adds ``__home``, the block of the row's number, and ``__b``, a block that sees it; a row comes once for every block
    whose rows look back ``before`` or ahead ``after`` rows to it."""
    seen = F.sequence(F.greatest(F.floor((F.col(place) - after) / block), F.lit(0)), F.floor((F.col(place) + before) / block))
    return df.withColumn("__home", F.floor(F.col(place) / block)).withColumn("__b", F.explode(seen))


def over_frame(df: DataFrame, keys: Sequence[str], place: str, before: int, after: int, columns: Mapping[str, Callable[[WindowSpec], Column]], block: int = BLOCK) -> DataFrame:
    """Adds columns made by window functions that look at most ``before`` rows back and ``after`` ahead.

    ``place`` numbers the rows of a signal without gaps. A task gets a block and its halo; only its own rows stay.
    """
    w = Window.partitionBy(*keys, "__b").orderBy(place)
    made = with_halo(df, place, before, after, block).withColumns({name: f(w) for name, f in columns.items()})
    return made.filter("__home = __b").drop("__home", "__b")


def running(df: DataFrame, keys: Sequence[str], place: str, columns: Mapping[str, tuple[str, Column]], block: int = BLOCK) -> DataFrame:
    """Adds scans of a whole signal: ``sum`` and ``last`` (known value) up to and including the row, ``next`` (known value)
    from the row on.

    Blocks are scanned by themselves; one row a block is scanned for what comes before (behind) it and joined back by
    block. Rows are shuffled once, by key and block. ``next`` is ``last`` in falling order: Spark works a frame that ends
    with its partition out anew for every row, one that begins with it only once.
    """
    blocked = df.withColumn("__b", F.floor(F.col(place) / block)).withColumns({f"__x_{n}": c for n, (_, c) in columns.items()})
    whole = lambda kind, c: {"sum": F.sum(c), "last": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(place))), "next": F.min_by(c, F.when(F.col(c).isNotNull(), F.col(place)))}[kind]
    totals = blocked.groupBy(*keys, "__b").agg(*[whole(kind, f"__x_{n}").alias(f"__t_{n}") for n, (kind, _) in columns.items()])
    blocks = Window.partitionBy(*keys)
    earlier, later = (blocks.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("__b", F.desc("__b")))
    carried = {"sum": lambda c: F.sum(c).over(earlier), "last": lambda c: F.last(c, True).over(earlier), "next": lambda c: F.last(c, True).over(later)}
    carries = totals.select(*keys, "__b", *[carried[kind](f"__t_{n}").alias(f"__c_{n}") for n, (kind, _) in columns.items()])
    rows = Window.partitionBy(*keys, "__b")
    back, ahead = (rows.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (place, F.desc(place)))
    local = {"sum": lambda c: F.sum(c).over(back), "last": lambda c: F.last(c, True).over(back), "next": lambda c: F.last(c, True).over(ahead)}
    scanned = blocked.withColumns({f"__l_{n}": local[kind](f"__x_{n}") for n, (kind, _) in columns.items()})
    met = _meet(scanned, carries, [*keys, "__b"], "left")

    def both(name: str, kind: str) -> Column:
        inside, outside = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        return F.coalesce(inside + outside, inside, outside) if kind == "sum" else F.coalesce(inside, outside)

    return met.select(*df.columns, *[both(n, kind).alias(n) for n, (kind, _) in columns.items()])
