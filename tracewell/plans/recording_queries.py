"""More operators applied to the driver's tables: differences and turns of signals, trials and bursts, paired times and oxygen,
grids of model runs, analysis of variance, channel choice, components and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import events as ev
from tracewell.operators import layout, models, populations, signals, voxels
from tracewell.plans import jobs
from tracewell.plans.queries import _KEY, ORACLES, QUERIES, _ORDER, _cells, _cents, _events, _query, _table

__all__ = ["ORACLES", "QUERIES"]
_DAY = 86_400_000_000


@_query("WITH $EVENTS SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id), 6) AS diff FROM e")
def first_difference(spark, sf_dir):
    return signals.first_difference(_events(spark, sf_dir), _KEY, _ORDER, "value").select("event_id", F.round("diff", 6).alias("diff"))


@_query("WITH $EVENTS, d AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d FROM e) SELECT user_id, min(d)::BIGINT AS least_step FROM d GROUP BY user_id")
def least_step(spark, sf_dir):
    return signals.least_step(_events(spark, sf_dir), _KEY, _ORDER, "us")


_TURNS = """WITH $EVENTS, v AS (SELECT event_id, user_id, row_number() OVER w - 1 AS pos, CASE WHEN value < 100 THEN 0 ELSE value END AS v FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
n AS (SELECT *, lead(v) OVER (PARTITION BY user_id ORDER BY pos) AS nx FROM v),
t AS (SELECT event_id, user_id, pos, CASE WHEN v = 0 AND nx > 0 THEN 'on' WHEN v > 0 AND nx = 0 THEN 'off' END AS turn FROM n)"""


def _turns(spark, sf_dir):
    from pyspark.sql import Window

    placed = _events(spark, sf_dir).withColumns({"pos": F.row_number().over(Window.partitionBy("user_id").orderBy(*_ORDER)) - 1, "v": F.when(F.col("value") < 100, 0.0).otherwise(F.col("value"))})
    return signals.turns(placed, _KEY, ["pos"], "v")


@_query(_TURNS + " SELECT event_id, user_id, turn FROM t WHERE turn IS NOT NULL")
def signal_turns(spark, sf_dir):
    return _turns(spark, sf_dir).select("event_id", "user_id", "turn")


@_query(
    _TURNS
    + """, o AS (SELECT *, lead(pos) OVER w AS off, lead(pos, 2) OVER w AS nxt FROM t WHERE turn IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
k AS (SELECT *, sum(CASE WHEN nxt IS NULL OR nxt - off > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS trial FROM o WHERE turn = 'on'),
g AS (SELECT user_id, trial, min(pos) AS s, max(off) AS f FROM k WHERE trial > 0 GROUP BY user_id, trial),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trial DESC) AS r FROM g)
SELECT user_id, trial::BIGINT AS trial, s::INT AS start, f::INT AS "end", CASE WHEN s > 10 AND s < 80 THEN 1 WHEN s > 90 AND s < 200 THEN 2 ELSE 0 END AS epoch FROM r WHERE r > 2"""
)
def swim_trials(spark, sf_dir):
    return ev.swim_trials(_turns(spark, sf_dir), _KEY, "pos", (10, 80), (90, 200))


@_query("""WITH $EVENTS, s AS (SELECT user_id, us, value > 60 AS state, row_number() OVER w - 1 AS i, lag(value > 60) OVER w AS p FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM state AND i > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM s)
SELECT user_id, run::BIGINT AS run, any_value(state) AS state, (max(us) - min(us))::BIGINT AS span FROM g GROUP BY user_id, run""")
def run_spans(spark, sf_dir):
    return ev.run_spans(_events(spark, sf_dir), _KEY, _ORDER, "us", F.col("value") > 60)


@_query("""WITH $EVENTS, p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS place FROM e),
x AS (SELECT DISTINCT user_id, event_id % 50 AS place FROM e WHERE event_type = 'error')
SELECT event_id, user_id FROM p ANTI JOIN x USING (user_id, place)""")
def exclude_places(spark, sf_dir):
    """Events without those whose place among the user's is listed; the list comes from the error events."""
    e = _events(spark, sf_dir)
    places = e.filter("event_type = 'error'").select("user_id", F.pmod("event_id", F.lit(50)).alias("place")).distinct()
    return signals.exclude_places(e, _KEY, _ORDER, places).select("event_id", "user_id")


@_query("""WITH n AS (SELECT label, count(*) % 40 + 30 AS k FROM embeddings GROUP BY label)
SELECT vec_id AS cell_id, least(len(embedding), k)::INT AS frames, (least(len(embedding), k) * 0.5)::DOUBLE AS last_sec, round(list_sum(list_transform(embedding[1:k], lambda x: x::DOUBLE)), 6) AS total FROM embeddings JOIN n USING (label)""")
def paired_times(spark, sf_dir):
    """Traces cut to the recording's time stamps (twice a second, as many as its group says) or the other way round."""
    cells = _cells(spark, sf_dir)
    times = cells.groupBy("label").agg((F.count(F.lit(1)) % 40 + 30).cast("int").alias("k")).select("label", F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: i * 0.5).alias("sec"))
    paired = signals.pair_times(cells, times, "label")
    return paired.select("cell_id", F.size("trace").alias("frames"), F.element_at("sec", -1).alias("last_sec"), F.round(F.aggregate("trace", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_query("""WITH p AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY event_type)
SELECT event_type, round(avg(value), 6) AS trimmed_mean FROM events JOIN p USING (event_type) WHERE value > lo AND value < hi GROUP BY event_type""")
def trimmed_mean(spark, sf_dir):
    return signals.trimmed_mean(_events(spark, sf_dir), ["event_type"], "value").withColumn("trimmed_mean", F.round("trimmed_mean", 6))


@_query("""WITH $EVENTS, m AS (SELECT user_id, avg(round_even(value * 100, 0)) FILTER (us >= 1704326400000000 AND us < 1704758400000000) AS m FROM e GROUP BY user_id)
SELECT user_id, us, round(round_even(value * 100, 0) / nullif(m, 0), 6) AS normal FROM e JOIN m USING (user_id)""")
def normalised_by_window(spark, sf_dir):
    """Values over the user's mean of the fourth to the eighth day."""
    start = 1_704_326_400_000_000
    normal = signals.normalise_by_window(_cents(_events(spark, sf_dir)), _KEY, "us", "value", start, start + 5 * _DAY)
    return normal.select("user_id", "us", F.round("normal", 6).alias("normal"))


@_query("""WITH l AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type), g AS (SELECT *, unnest(range(50))::INT AS i FROM l),
x AS (SELECT event_type, i, CASE WHEN i = 49 THEN hi ELSE lo + (hi - lo) * i / 49 END AS x FROM g)
SELECT x.event_type, i, round(any_value(x.x), 6) AS x, round(avg((value <= x.x)::INT), 6) AS ecdf FROM x JOIN events v ON v.event_type = x.event_type GROUP BY x.event_type, i""")
def ecdf_grid(spark, sf_dir):
    return signals.ecdf_grid(_events(spark, sf_dir), ["event_type"], "value").select("event_type", "i", F.round("x", 6).alias("x"), F.round("ecdf", 6).alias("ecdf"))


@_query("""WITH s AS (SELECT l_partkey, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, min(l_tax) AS p FROM lineitem GROUP BY l_partkey)
SELECT l_partkey FROM s WHERE mean > 20 AND std > 2 AND std / mean > 0.05 AND p < 0.001""")
def active_cells(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"), F.min("l_tax").alias("p"))
    return populations.active_cells(li).select("l_partkey")


@_query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax < 0.05 AND l_quantity / 2.0 > 0 AND l_quantity / 2.0 < 24 AND l_partkey % 30 + 0.25 > 0 AND l_partkey % 30 + 0.25 < 29""")
def significant_inside(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").withColumns({"x": F.col("l_quantity") / 2.0, "y": F.pmod("l_partkey", F.lit(30)) + 0.25})
    return voxels.inside_volume(populations.significant(li, "l_tax"), ["x", "y"], (25, 30)).select("l_orderkey", "l_linenumber")


@_query("""WITH g AS (SELECT l_suppkey, rf, ls FROM (SELECT DISTINCT l_suppkey FROM lineitem), (SELECT unnest(['A', 'N', 'R', 'X']) AS rf), (SELECT unnest(['F', 'O']) AS ls)),
m AS (SELECT l_suppkey, l_returnflag AS rf, l_linestatus AS ls, avg(l_discount) AS m FROM lineitem GROUP BY ALL)
SELECT l_suppkey, rf AS l_returnflag, ls AS l_linestatus, round(m, 6) AS m FROM g LEFT JOIN m USING (l_suppkey, rf, ls)""")
def model_run_grid(spark, sf_dir):
    """A value for every unit, spec and condition, null where there was no run."""
    li = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("m"))
    return populations.on_grid(li, "l_suppkey", {"l_returnflag": ["A", "N", "R", "X"], "l_linestatus": ["F", "O"]}, "m").withColumn("m", F.round("m", 6))


@_query("""SELECT l_returnflag, l_linenumber, count(*)::BIGINT AS fits, count(l_discount)::BIGINT AS l_discount_n, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std, round(median(l_discount), 6) AS l_discount_median,
count(l_tax)::BIGINT AS l_tax_n, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_pop(l_tax), 6) AS l_tax_std, round(median(l_tax), 6) AS l_tax_median FROM lineitem GROUP BY ALL""")
def model_run_summary(spark, sf_dir):
    got = populations.summarise_runs(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], ["l_discount", "l_tax"])
    return got.select("l_returnflag", "l_linenumber", "fits", *[c for v in ("l_discount", "l_tax") for c in (f"{v}_n", *[F.round(f"{v}_{m}", 6).alias(f"{v}_{m}") for m in ("mean", "std", "median")])])


@_query()
def anova_by_condition(spark, sf_dir):
    """Quantities by line number and supplier, once a return flag and once for all."""
    return populations.two_way_anova(_table(spark, sf_dir, "lineitem"), "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")


#: Rows of a block where all events are one signal.
_BLOCK = 20_000
_ONE = "WITH e AS MATERIALIZED (SELECT event_id, epoch_us(ts)::BIGINT AS us, value FROM events)"


@_query(_ONE + """, s AS (SELECT us, value > 30 AS state, row_number() OVER w - 1 AS i, lag(value > 30) OVER w AS p FROM e WINDOW w AS (ORDER BY us, event_id)),
g AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM state AND i > 0 THEN 0 ELSE 1 END) OVER (ORDER BY i) AS run FROM s),
runs AS (SELECT run, any_value(state) AS state, min(i) AS start, max(i) AS "end" FROM g GROUP BY run),
a AS (SELECT *, CASE WHEN start - lag("end") OVER (ORDER BY start) - 1 < 3 THEN 0 ELSE 1 END AS nw FROM runs WHERE state),
b AS (SELECT *, sum(nw) OVER (ORDER BY start) AS bout FROM a), f AS (SELECT bout::BIGINT AS bout, min(start)::BIGINT AS start, max("end")::BIGINT AS "end" FROM b GROUP BY bout),
k AS (SELECT * FROM f WHERE start > 0 AND "end" < (SELECT count(*) - 1 FROM e))
SELECT bout, start, "end", ("end" - start + 1)::DOUBLE AS duration, (start - lag(start) OVER w)::DOUBLE AS initiation_gap, (start - lag("end") OVER w - 1)::DOUBLE AS gap_before FROM k WINDOW w AS (ORDER BY start)""")
def one_signal_bouts(spark, sf_dir):
    """Bouts of all events as one signal, dealt to tasks in blocks."""
    return ev.bout_features(_events(spark, sf_dir), [], _ORDER, F.col("value") > 30, 3, block=_BLOCK)


@_query(_ONE + """, v AS (SELECT event_id, us, value, row_number() OVER (ORDER BY us, event_id) AS p FROM e)
SELECT event_id, round(avg(value) OVER w, 6) AS roll_mean, round(stddev_samp(value) OVER w, 6) AS roll_std, round(sum(value) OVER t, 4) AS trailing FROM v WINDOW w AS (ORDER BY p ROWS BETWEEN 200 PRECEDING AND 200 FOLLOWING), t AS (ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def one_signal_rolling(spark, sf_dir):
    """Centred and trailing windows of all events as one signal; blocks see a halo of their neighbours."""
    rolled = signals.rolling(_events(spark, sf_dir), [], _ORDER, "value", 401, block=_BLOCK)
    both = signals.trailing_sum(rolled, [], _ORDER, "value", 100, block=_BLOCK)
    return both.select("event_id", F.round("roll_mean", 6).alias("roll_mean"), F.round("roll_std", 6).alias("roll_std"), F.round("trailing", 4).alias("trailing"))


@_query(_ONE + """, h AS (SELECT event_id, event_id AS p, CASE WHEN event_id % 97 < 60 THEN value END AS v FROM e),
k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1
 FROM h WINDOW b AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v0 + (v1 - v0) * coalesce((p - p0)::DOUBLE / nullif(p1 - p0, 0), 0), v0, v1), 6) AS filled FROM k""")
def one_signal_gap_fill(spark, sf_dir):
    """Gaps in all events as one signal; known values are carried over whole blocks."""
    holes = _events(spark, sf_dir).select("event_id", F.col("event_id").alias("p"), F.when(F.pmod("event_id", F.lit(97)) < 60, F.col("value")).alias("v"))
    return signals.gap_fill(holes, [], "p", "v", block=_BLOCK).select("event_id", F.round("filled", 6).alias("filled"))


@_query("""WITH $EVENTS, k AS (SELECT event_type, us AS t, max(value) AS v FROM e WHERE event_id % 7 = 0 GROUP BY ALL), s AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM k WINDOW w AS (PARTITION BY event_type ORDER BY t)),
o AS (SELECT event_id, event_type, us FROM e WHERE event_id % 7 <> 0), f AS (SELECT event_type, arg_min(v, t) AS v FROM k GROUP BY event_type)
SELECT event_id, round(CASE WHEN s.t IS NULL THEN f.v ELSE s.v + coalesce((s.v1 - s.v) / (s.t1 - s.t)::DOUBLE * (o.us - s.t), 0) END, 4) AS curve FROM o ASOF LEFT JOIN s ON o.event_type = s.event_type AND o.us >= s.t LEFT JOIN f ON f.event_type = o.event_type""")
def interpolated_between_events(spark, sf_dir):
    """Every seventh event of a type is a knot, at its own time; the others take the value between, ends are held."""
    e = _events(spark, sf_dir)
    knots = e.filter(F.pmod("event_id", F.lit(7)) == 0).select("event_type", F.col("us").alias("t"), F.col("value").alias("v"))
    others = e.filter(F.pmod("event_id", F.lit(7)) != 0).select("event_id", "event_type", "us")
    return signals.interpolate_at(others, ["event_type"], "us", knots, block=_BLOCK).select("event_id", F.round("curve", 4).alias("curve"))


@_query(_ONE + """, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > 60000000 THEN 1 ELSE 0 END AS g FROM e WINDOW w AS (ORDER BY us, event_id)), s AS (SELECT *, sum(g) OVER (ORDER BY us, event_id) AS session FROM n)
SELECT session::BIGINT AS session, min(us)::BIGINT AS start, max(us)::BIGINT AS "end", count(*)::BIGINT AS n FROM s GROUP BY session HAVING min(us) <> max(us)""")
def one_signal_sessions(spark, sf_dir):
    """Sessions of all events as one stream: a minute without any ends one."""
    return ev.sessions(_events(spark, sf_dir), [], "us", "event_id", 60_000_000, block=_BLOCK)


@_query("""WITH e AS (SELECT l_returnflag AS c, l_linenumber AS a, l_suppkey AS b, avg(l_quantity) AS y FROM lineitem GROUP BY ALL),
g AS (SELECT a, row_number() OVER (ORDER BY a::VARCHAR) - 1 AS i FROM (SELECT DISTINCT a FROM e)), m AS (SELECT c, i, b, y FROM e JOIN g USING (a)),
l AS (SELECT c, b, count(*) AS n, sum(y) AS t FROM m GROUP BY c, b), k AS (SELECT m.c, i, b, y, n, t FROM m JOIN l USING (c, b)), cs AS (SELECT DISTINCT c FROM m), gs AS (SELECT i FROM g),
o AS (SELECT k.c, k.i, h.i AS j, sum(1.0::DOUBLE / k.n) AS v FROM k JOIN k h ON h.c = k.c AND h.b = k.b GROUP BY ALL),
r AS (SELECT c AS condition, 'c' AS part, x.i, z.i AS j, CASE WHEN x.i = z.i THEN coalesce((SELECT count(*) FROM m WHERE m.c = cs.c AND m.i = x.i), 0) ELSE 0 END - coalesce((SELECT v FROM o WHERE o.c = cs.c AND o.i = x.i AND o.j = z.i), 0) AS v FROM cs, gs x, gs z
UNION ALL SELECT c, p, i, 0, CASE p WHEN 'q' THEN sum(y - t / n) WHEN 't' THEN sum(y) ELSE count(*) END FROM k, (SELECT unnest(['q', 't', 'n']) AS p) GROUP BY c, p, i
UNION ALL SELECT c, p, 0, 0, CASE p WHEN 'r' THEN sum(t * t / n) ELSE count(*) END FROM l, (SELECT unnest(['r', 'k']) AS p) GROUP BY c, p
UNION ALL SELECT c, p, 0, 0, CASE p WHEN 'y' THEN sum(y * y) ELSE count(*) END FROM m, (SELECT unnest(['y', 'm']) AS p) GROUP BY c, p)
SELECT condition, part, i::INT AS i, j::INT AS j, round(v, 4) AS v FROM r""")
def anova_level_sums(spark, sf_dir):
    """The normal equations of an additive model of quantities by line number and supplier, suppliers eliminated."""
    li = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber", "l_suppkey").agg(F.avg("l_quantity").alias("y"))
    levels = [str(r[0]) for r in li.select("l_linenumber").distinct().collect()]
    return populations.anova_sums(li, "l_returnflag", "l_linenumber", "l_suppkey", "y", sorted(levels)).withColumn("v", F.round("v", 4))


_OXYGEN = """$CELLS, n AS (SELECT cell_id, frame, value, 0.3 + frame * 0.95 AS sec FROM c),
o AS (SELECT frame + 1 AS sec, value AS v, lead(value) OVER (ORDER BY frame) AS nx FROM c WHERE cell_id = (SELECT min(vec_id) FROM embeddings)),
x AS (SELECT cell_id, frame, value, greatest(least(sec, 64.0), 1.0) AS t FROM n WHERE sec > 10 AND sec < 60),
y AS (SELECT cell_id, frame, value, v + (coalesce(nx, v) - v) * (t - o.sec) AS oxygen FROM x JOIN o ON o.sec = floor(t)::INT),
k AS (SELECT cell_id, rank() OVER a + (count(*) OVER (PARTITION BY cell_id, value) - 1) / 2.0 AS p, rank() OVER b + (count(*) OVER (PARTITION BY cell_id, oxygen) - 1) / 2.0 AS q
 FROM y WINDOW a AS (PARTITION BY cell_id ORDER BY value), b AS (PARTITION BY cell_id ORDER BY oxygen))"""


@_query(f"WITH {_OXYGEN} SELECT cell_id, round(covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0), 6) AS r FROM k GROUP BY cell_id")
def oxygen_correlation(spark, sf_dir):
    """Rank correlation of every trace with the oxygen curve at its own time stamps, between two times."""
    return jobs.oxygen_correlations(*_oxygen_inputs(spark, sf_dir), "cell_id", "recording", 10, 60).select("cell_id", F.round("r", 6).alias("r"))


def _oxygen_inputs(spark, sf_dir):
    """Cells with one recording's time stamps, and the curve: the first cell's trace, a value a second."""
    cells = _cells(spark, sf_dir).withColumn("recording", F.lit(0))
    first = cells.join(F.broadcast(cells.agg(F.min("cell_id").alias("cell_id"))), "cell_id")
    curve = signals.to_frames(first, "trace", "value").select((F.col("frame") + 1).alias("sec"), "value")
    times = first.select("recording", F.transform(F.sequence(F.lit(0), F.size("trace") - 1), lambda i: 0.3 + i * 0.95).alias("sec"))
    return cells, times, curve


@_query()
def oxygen_p_values(spark, sf_dir):
    return jobs.oxygen_correlations(*_oxygen_inputs(spark, sf_dir), "cell_id", "recording", 10, 60).select("cell_id", "r", "p")


@_query(f"""WITH {_OXYGEN}, r AS (SELECT cell_id, covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0) AS r FROM k GROUP BY cell_id),
w AS (SELECT cell_id, frame, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM y WINDOW w AS (PARTITION BY cell_id)),
edges AS (SELECT unnest([-1.0, -0.8, -0.7, -0.6, -0.5, -0.4, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS lo, unnest([-0.8, -0.7, -0.6, -0.5, -0.4, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0]) AS hi, unnest(range(18)) AS bin),
f AS (SELECT bin, frame, avg(z) AS m FROM r JOIN edges ON r > lo AND r < hi JOIN w USING (cell_id) GROUP BY bin, frame),
fr AS (SELECT bin, frame, rank() OVER (PARTITION BY bin ORDER BY m) + (count(*) OVER (PARTITION BY bin, m) - 1) / 2.0 AS q FROM f),
cr AS (SELECT cell_id, frame, rank() OVER (PARTITION BY cell_id ORDER BY z) + (count(*) OVER (PARTITION BY cell_id, z) - 1) / 2.0 AS p FROM w),
s AS (SELECT cell_id, bin, covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0) AS s FROM cr JOIN fr USING (frame) GROUP BY cell_id, bin)
SELECT cell_id, round(max(s), 6) AS best_r, count(*)::INT AS bins FROM s GROUP BY cell_id""")
def oxygen_reference_match(spark, sf_dir):
    """How well each cell follows the mean trace of any bin of oxygen correlation."""
    matched = jobs.oxygen_reference_bins(*_oxygen_inputs(spark, sf_dir), "cell_id", "recording", 10, 60)
    return matched.select("cell_id", F.round("best_r", 6).alias("best_r"), F.size("rs").alias("bins"))


_OFFSETS = """WITH $CELLS, g AS (SELECT label, frame, value, unnest(range(24))::INT AS o FROM c),
x AS (SELECT label, o, value, CASE WHEN (frame + o) % 24 < 6 THEN 0.1 WHEN (frame + o) % 24 < 16 THEN -0.1 ELSE 0.05 END AS l FROM g),
s AS (SELECT label, o, round(avg(abs(value - l)), 9) AS mae, avg((abs(value - l) <= 0.02 * 0.2 + 1e-5 * abs(l))::INT) AS m FROM x GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mae, o) AS r FROM s)"""


def _offsets(spark, sf_dir):
    frames = signals.to_frames(_cells(spark, sf_dir), "trace", "value", "label")
    return models.stimulus_offsets(frames, "label", "frame", "value", [6, 16, 24], [0.1, -0.1, 0.05]).withColumn("mae", F.round("mae", 9))


@_query(_OFFSETS + ' SELECT label, o AS "offset", round(mae, 6) AS mae, round(m, 6) AS matched, m >= 0.8 AND mae <= 0.1 * 0.2 AS direct_match FROM b WHERE r = 1')
def stimulus_best_offset(spark, sf_dir):
    return models.best_offsets(_offsets(spark, sf_dir), ["label"], 0.2).withColumns({"mae": F.round("mae", 6), "matched": F.round("matched", 6)})


@_query("""WITH m AS (SELECT l_returnflag AS f, 'c' || l_linenumber AS ch, avg(l_discount) AS mae, max(l_tax) > 0.05 AS d FROM lineitem GROUP BY ALL),
a AS (SELECT * FROM m WHERE f = 'N' ORDER BY d DESC, mae, ch LIMIT 1),
b AS (SELECT * FROM m WHERE f = 'A' AND ch NOT IN (SELECT ch FROM a) ORDER BY d DESC, mae, ch LIMIT 1),
c AS (SELECT * FROM m WHERE f = 'R' AND ch NOT IN (SELECT ch FROM a UNION ALL SELECT ch FROM b) ORDER BY d DESC, mae, ch LIMIT 1)
SELECT f AS field, ch AS channel, d AS direct_match, round(mae, 9) AS mae FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def channel_choice(spark, sf_dir):
    """Fields choose channels in turn, each channel once."""
    matches = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("field"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("channel")).agg(F.avg("l_discount").alias("mae"), (F.max("l_tax") > 0.05).alias("direct_match"))
    return models.choose_channels(matches, ["N", "A", "R"]).withColumn("mae", F.round("mae", 9))


@_query()
def burst_bouts(spark, sf_dir):
    """Bursts in each user's events, values scaled to the histogram's range."""
    from pyspark.sql import Window

    placed = _events(spark, sf_dir).select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy(*_ORDER)) - 1).alias("i"), (F.col("value") / 5000).alias("v"))
    return ev.burst_bouts(placed, _KEY, "i", "v", block=50, width=1e-3, gap=6)


@_query()
def explained_variance(spark, sf_dir):
    """Cells' share explained by the first 20 principal components, and whether it passes 0.9."""
    got = models.principal_components(_cells(spark, sf_dir), "cell_id", 64, 20)
    return got.select("cell_id", "explained", (F.col("explained") > 0.9).alias("kept"))


_BASIS = np.stack([np.ones(64), np.arange(64.0) - 31.5])


@_query("""WITH $CELLS, s AS (SELECT cell_id, frame - 31.5 AS x, value AS y FROM c)
SELECT cell_id, round(avg(y), 6) AS level, round(sum(x * y) / sum(x * x), 6) AS slope FROM s GROUP BY cell_id""")
def scores_to_loadings(spark, sf_dir):
    """Least-squares loadings on two given scores, a level and a slope."""
    got = models.least_squares_loadings(_cells(spark, sf_dir), "cell_id", _BASIS)
    return got.select("cell_id", F.round(F.get("loadings", F.lit(0)), 6).alias("level"), F.round(F.get("loadings", F.lit(1)), 6).alias("slope"))


@_query()
def factor_clusters(spark, sf_dir):
    """Clusters of signed factors by size."""
    loads = models.factor_loadings(_cells(spark, sf_dir), "cell_id", 64, 8)
    return models.cluster_labels(loads, "cell_id", 8, least_cells=10)


@_query()
def band_passed(spark, sf_dir):
    both = models.causal_low_pass(models.band_pass(_cells(spark, sf_dir), 0.1, 0.4), 0.2)
    return both.select("cell_id", "band", "low")


@_query("""SELECT floor(l_quantity / 3)::INT AS panel, l_linenumber, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL""")
def panel_projection(spark, sf_dir):
    """The largest value of each panel of three planes, seen along the other axes."""
    return voxels.max_projection(voxels.z_panels(_table(spark, sf_dir, "lineitem"), "l_quantity"), ["panel", "l_linenumber"], "l_discount")


@_query("""SELECT l_orderkey, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def best_fit_per_cell(spark, sf_dir):
    return voxels.best_per_cell(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_discount", "l_linenumber").select("l_orderkey", "l_linenumber", "l_discount")


@_query("SELECT (i - 1)::BIGINT AS cell, vec_id AS frame, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id IS NOT NULL) WHERE embedding[i] IS NOT NULL")
def cell_major_traces(spark, sf_dir):
    """Each vector as a frame of a movie with a cell a place, turned into a trace a cell."""
    movie = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    long = layout.frames_to_cells(movie, "vec_id", "embedding").select("cell", F.posexplode("trace").alias("frame", "value"))
    return long.filter(~F.isnan("value")).select("cell", F.col("frame").cast("long").alias("frame"), "value")
