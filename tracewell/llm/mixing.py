"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key scaled by its quality weight; within its source, documents are taken in the
order of their keys until the running sum of their sizes meets the source's budget. Where a target exceeds the
source, whole epochs come first and only the rest is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import let, with_words
from tracewell.session import broadcast_if_small, materialize

#: A key's logarithm as a whole number of 48 bits: order-preserving, cut into steps by its upper bits.
_CODE_BITS = 48
#: Bits of one step: each pass sums 4,096 steps a source and goes on inside the one where the budget ends.
_STEP_BITS = 12
#: Rows of one source's last step that are sorted; a step with more is cut again.
SORTED_ROWS = 50_000

#: ASCII signs and digits.
_SIGNS = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"


def text_quality(words: Column, text: Column) -> Column:
    """A document's sampling weight from 0.02 to 1: (share of characters that are no ASCII signs or digits) ** 6 times
    (1.25 x distinct words / words, 1 at most) ** 2. Texts without words weigh 0.02.

    Prose is near 0.85; tables, symbol lines and repeated lines are at 0.3 and below.
    """
    plain = F.char_length(text) - F.regexp_count(text, F.lit(_SIGNS))
    share = F.try_divide(plain.cast("double"), F.char_length(text).cast("double"))
    variety = F.least(F.lit(1.0), F.try_divide(1.25 * F.size(F.array_distinct(words)), F.size(words).cast("double")))
    weight = let(F.struct(share.alias("s"), variety.alias("v")), lambda x: x["s"] * x["s"] * x["s"] * x["s"] * x["s"] * x["s"] * x["v"] * x["v"])
    return F.when(F.size(words) > 0, F.greatest(F.lit(0.02), weight)).otherwise(F.lit(0.02))


def with_sizes(docs: DataFrame) -> DataFrame:
    """Adds ``__tw_size`` (words of the text) and ``__tw_quality``; the text is split once."""
    found = with_words(docs, "__tw_words")
    words = F.col("__tw_words")
    return found.withColumns({"__tw_size": F.size(words).cast("bigint"), "__tw_quality": text_quality(words, F.col("text"))}).drop("__tw_words")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets for (source, source_size): the sizes' total shared by weight, none above ``max_epochs`` x its size.

    Sources sort by code point, null last, and take the weights in turn. The excess of capped sources is reshared by
    weight until none is above its cap: with sources ordered by cap / weight, the first k are capped, where k is the
    first count at which the next source's cap holds its share of what remains. One row a source goes through here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    named = sizes.withColumn("i", F.row_number().over(by_name)).withColumn("weight", F.element_at(cycle, ((F.col("i") - 1) % len(weights) + 1).cast("int")))
    capped = named.withColumn("cap", F.col("source_size") * max_epochs).withColumn("r", F.col("cap") / F.col("weight"))
    every, before = Window.partitionBy(), Window.orderBy("r", "i").rowsBetween(Window.unboundedPreceding, -1)
    shares = capped.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    shares = shares.withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    shares = shares.withColumn("level", F.col("left") / F.col("weight_left"))
    level = F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "i", "level"))).over(every)["level"]
    return shares.withColumn("at", level).select(
        "source", "source_size", "weight", F.when(F.col("at") * F.col("weight") < F.col("cap"), F.col("at") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target")
    )


def _boundary(narrow: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """(source, shift, prefix, start, budget): the step in which each source's budget ends, of at most ``rows`` rows or
    of one code; start is the sum before it. Sources whose budget lies beyond their last row are left out."""
    shift = _CODE_BITS - _STEP_BITS
    now = targets.select("source", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("start"), "budget")
    done = None
    while True:
        held = broadcast_if_small(now.withColumnRenamed("source", "__s"), 100_000)
        inside = F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("code", shift + _STEP_BITS) == F.col("prefix"))
        met = narrow.select("source", "code", "size").join(held, inside)
        steps = met.groupBy("source", F.shiftright("code", shift).alias("step")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("start").alias("start"), F.first("budget").alias("budget"))
        upto = F.col("start") + F.sum("n").over(Window.partitionBy("source").orderBy("step"))  # 4,096 rows a source at most
        ends = steps.withColumn("upto", upto).filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")))
        found = materialize(ends.select("source", F.lit(shift).alias("shift"), F.col("step").alias("prefix"), (F.col("upto") - F.col("n")).alias("start"), "budget", "rows"), "steps")
        fits = (F.col("rows") <= rows) if shift else F.lit(True)
        part = found.filter(fits).drop("rows")
        done = part if done is None else done.unionByName(part)
        now = found.filter(~fits).select("source", "prefix", "start", "budget")
        if not shift or not now.limit(1).count():
            return done
        shift -= _STEP_BITS


def _first_rows(narrow: DataFrame, partly: DataFrame) -> DataFrame:
    """(source, some, upto): of the equal rows of each source's key in ``partly`` the first ``taken``, in the order of
    the rows' numbers, are those up to ``upto``.

    A number's upper bits are the task that wrote the row. Tasks' counts are summed; only the rows of the one task in
    which the count is reached are ordered.
    """
    held = broadcast_if_small(partly.select([F.col(c).alias(f"__{c}") for c in partly.columns]), 100_000)  # one row a source
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("k") == F.col("__k")) & (F.col("d") == F.col("__d"))
    rows = narrow.join(held, same).select("source", "k", "d", "at", F.shiftright("at", 33).alias("task"), F.col("__taken").alias("taken"))
    tasks = rows.groupBy("source", "task", "taken").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = tasks.withColumn("before", before).filter("before < taken and taken <= before + n").select(F.col("source").alias("__s"), F.col("task").alias("__t"), (F.col("taken") - F.col("before")).alias("left"))
    ends = broadcast_if_small(materialize(ends, "ends"), 100_000)
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("__s")) & (F.col("task") == F.col("__t")))
    numbered = inside.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("at"))).filter("i = left")
    return numbered.select("source", F.struct("k", "d").alias("some"), F.col("at").alias("upto"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 0, sorted_rows: int = SORTED_ROWS, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds __tw_size, __tw_quality, __tw_source_size, __tw_target and __tw_times (how often the mix takes the row).

    ``docs`` needs doc_id, text and source; other columns may have any name that does not begin with __tw_. Columns
    in ``drop`` are left out of the result. Null sources form one source. Null and empty texts have size 0 and weight
    0.02; texts of any length are one row and count whole. Rows with equal doc_id, text and source have equal keys; where
    a budget ends among them, as many of them are taken as it has room for. An empty table gives an empty result. The last
    document of the sample is taken if that brings the sum nearer to the target.

    Sizes, weights and keys are worked out once and written. Each source's boundary is found by summing steps of its
    keys, of 4,096 a pass, until the step where the budget ends is small enough to sort; so a source with most of the
    rows is no hot spot, whatever its weights. Only those sums and steps are shuffled; one row a source meets the rows.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    keyed = with_sizes(docs).withColumn("__tw_d", digest).drop(*drop)
    u = (F.conv(F.substring("__tw_d", 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    # the rows' numbers are written with them, so that equal rows can be told apart later
    keyed = materialize(keyed.withColumn("__tw_k", -F.log(u) / F.col("__tw_quality")).withColumn("__tw_at", F.monotonically_increasing_id()), "keyed")
    # keys lie between exp(-37) and exp(8), so the logarithm plus 64 fits seven bits before the point
    code = F.floor((F.log("__tw_k") + 64) * float(1 << (_CODE_BITS - 7)))
    narrow = keyed.select("source", F.col("__tw_size").alias("size"), F.col("__tw_k").alias("k"), F.col("__tw_d").alias("d"), F.col("__tw_at").alias("at"), code.alias("code"))

    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("int"))
    targets = materialize(targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")

    cuts = materialize(_boundary(narrow, targets, sorted_rows), "cuts")  # one row a source at most
    c = broadcast_if_small(cuts.select([F.col(x).alias(f"c_{x}") for x in cuts.columns]), 100_000)
    at_cut = narrow.join(c, F.col("source").eqNullSafe(F.col("c_source")) & (F.call_function("shiftright", "code", "c_shift") == F.col("c_prefix")))
    alike = at_cut.groupBy("source", "k", "d", "size", F.col("c_start").alias("start"), F.col("c_budget").alias("budget")).agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("source").orderBy("k", "d").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum(F.col("copies") * F.col("size")).over(order), F.lit(0))
    room = F.when(F.col("size") > 0, F.floor((2 * (F.col("budget") - before) + F.col("size")) / (2 * F.col("size")))).when(before <= F.col("budget"), F.col("copies")).otherwise(0)
    taken = alike.withColumn("taken", F.least(F.col("copies"), room)).filter("taken > 0")
    last = taken.filter("taken = copies").groupBy("source").agg(F.max(F.struct("k", "d")).alias("last"))
    some = _first_rows(narrow, materialize(taken.filter("taken < copies").select("source", "k", "d", "taken"), "partly"))
    plan = targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", "shift", "prefix").alias("p")
    plan = plan.join(last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left").select("p.*", "last").alias("q")
    plan = plan.join(some.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")), "left").select("q.*", "some", "upto")
    plan = materialize(plan, "plan").select([F.col(x).alias(f"__tw_{x}") for x in plan.columns])

    code = F.floor((F.log("__tw_k") + 64) * float(1 << (_CODE_BITS - 7)))
    joined = keyed.join(broadcast_if_small(plan, 100_000), F.col("source").eqNullSafe(F.col("__tw_source"))).withColumn("__tw_step", F.call_function("shiftright", code, F.col("__tw_shift")))
    key = F.struct(F.col("__tw_k").alias("k"), F.col("__tw_d").alias("d"))
    partly = (key == F.col("__tw_some")) & (F.col("__tw_at") <= F.col("__tw_upto"))
    at = (F.col("__tw_step") == F.col("__tw_prefix")) & (F.coalesce(key <= F.col("__tw_last"), F.lit(False)) | F.coalesce(partly, F.lit(False)))
    chosen = F.col("__tw_prefix").isNull() | (F.col("__tw_step") < F.col("__tw_prefix")) | F.coalesce(at, F.lit(False))
    mixed = joined.withColumn("__tw_times", F.col("__tw_epochs") + chosen.cast("int"))
    added = ["__tw_size", "__tw_quality", "__tw_source_size", "__tw_target", "__tw_times"]
    return mixed.select(*[F.col(f"`{x}`") for x in docs.columns if x not in drop], *added)


def take_mix(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, without the columns that ``mix_sources`` added.

    Rows that are not taken are left out; an empty table gives an empty result.
    """
    own = [F.col(f"`{x}`") for x in mixed.columns if not x.startswith("__tw_")]
    return mixed.filter("__tw_times > 0").select(*own, F.explode(F.sequence(F.lit(1), F.col("__tw_times"))).alias("__tw_e")).select(own)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes; null texts have no words and are counted in their source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix_sources(docs, drop=("text",))
    return mixed.select(
        "doc_id", F.col("__tw_size").alias("size"), F.col("__tw_source_size").alias("source_size"), F.col("__tw_target").alias("target"), (F.col("__tw_size") * F.col("__tw_times")).alias("taken")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g'))::DOUBLE / nullif(length(text), 0)::DOUBLE AS p,
    least(1.0, 1.25 * len(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::DOUBLE / nullif(size, 0)::DOUBLE) AS v,
    CASE WHEN size > 0 THEN greatest(0.02, p * p * p * p * p * p * v * v) ELSE 0.02 END AS q,
    md5(concat_ws('|', '0', doc_id::VARCHAR, md5(coalesce(text, '')))) AS dg
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM n),
r AS (SELECT *, cap / weight AS r FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
      FROM r WINDOW b AS (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((SELECT level FROM l WHERE level <= r ORDER BY r, i LIMIT 1) * weight, cap::DOUBLE) AS target FROM l),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
k AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
      -ln((('0x' || substr(dg, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / q AS k
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, dg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN 2 * upto - size <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
