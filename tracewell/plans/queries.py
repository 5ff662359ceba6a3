"""The operators applied to the driver's tables: embeddings stand in for cells x frames, events for signals and bouts,
lineitem and orders for run tables, points and intervals. Each query has its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import events as ev
from tracewell.operators import models, populations, signals, voxels
from tracewell.plans import jobs

QUERIES, ORACLES = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("$CELLS", _CELLS).replace("$EVENTS", _EVENTS)
        return f

    return add


_CELLS = "c AS (SELECT vec_id AS cell_id, label, unnest(range(len(embedding)))::INT AS frame, unnest(embedding)::DOUBLE AS value FROM embeddings)"
_EVENTS = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts)::BIGINT AS us FROM events)"
_KEY, _ORDER = ["user_id"], ["us", "event_id"]


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), "label", F.col("embedding").cast("array<double>").alias("trace"))


def _events(spark, sf_dir) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", us.alias("us"))


def _cents(events) -> DataFrame:
    """Values as whole cents: their sums are exact in any order."""
    return events.select("user_id", "us", F.rint(F.col("value") * 100).alias("value"))


def _mean_reference(cells):
    return signals.vector(signals.population_mean(cells), "mean")


_RANKS = """$CELLS, m AS (SELECT frame, avg(value) AS value FROM c GROUP BY frame),
mr AS (SELECT frame, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rm FROM m),
cr AS (SELECT cell_id, label, frame, value, rank() OVER (PARTITION BY cell_id ORDER BY value) + (count(*) OVER (PARTITION BY cell_id, value) - 1) / 2.0 AS rc FROM c),
r AS (SELECT cell_id, covar_pop(rc, rm) / nullif(stddev_pop(rc) * stddev_pop(rm), 0) AS r FROM cr JOIN mr USING (frame) GROUP BY cell_id)"""
_Z = """z AS (SELECT cell_id, label, frame, value, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM c WINDOW w AS (PARTITION BY cell_id))"""


@_query(f"WITH {_RANKS} SELECT cell_id, round(r, 6) AS r FROM r")
def pop_mean_spearman(spark, sf_dir):
    """Rank correlation of every valid cell with the population mean."""
    cells = _cells(spark, sf_dir).filter(signals.valid_bounded("trace"))
    return signals.rank_correlation(cells, _mean_reference(cells)).select("cell_id", F.round(F.col("r")[0], 6).alias("r"))


@_query(f"WITH {_RANKS} SELECT CASE WHEN r < -0.1 THEN 'negative' ELSE 'positive' END AS population, frame, round(avg(value), 6) AS mean, count(*)::BIGINT AS n FROM r JOIN c USING (cell_id) WHERE r < -0.1 OR r > 0.3 GROUP BY ALL")
def threshold_populations(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    scored = signals.rank_correlation(cells, _mean_reference(cells)).withColumn("r", F.col("r")[0])
    named = scored.withColumn("population", F.when(F.col("r") < -0.1, "negative").when(F.col("r") > 0.3, "positive")).filter("population is not null")
    frames = signals.to_frames(named, "trace", "value", "population")
    return frames.groupBy("population", "frame").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@_query(f"WITH $CELLS, {_Z} SELECT cell_id, frame, round(z, 6) AS z FROM z")
def zscore_cells(spark, sf_dir):
    return signals.to_frames(signals.zscore(_cells(spark, sf_dir)), "z", "z", "cell_id").withColumn("z", F.round("z", 6))


@_query("""WITH $CELLS SELECT cell_id, round((avg(value) FILTER (frame < 24) - avg(value) FILTER (frame >= 32 AND frame < 56))
 / sqrt((var_pop(value) FILTER (frame < 24) + var_pop(value) FILTER (frame >= 32)) / 2), 6) AS d_prime FROM c GROUP BY cell_id""")
def d_prime(spark, sf_dir):
    frames = signals.to_frames(_cells(spark, sf_dir), "trace", "value", "cell_id")
    return populations.d_prime(frames, ["cell_id"], "frame", "value", (0, 24), (32, 56), (32, 64)).withColumn("d_prime", F.round("d_prime", 6))


@_query("""WITH $CELLS, k AS (SELECT frame + 1 AS sec, value AS v, lead(value) OVER (ORDER BY frame) AS nx FROM c WHERE cell_id = (SELECT min(vec_id) FROM embeddings)),
x AS (SELECT event_id, greatest(least(value / 7.5, (SELECT max(sec) FROM k)::DOUBLE), (SELECT min(sec) FROM k)::DOUBLE) AS t FROM events)
SELECT event_id, round(v + (coalesce(nx, v) - v) * (t - sec), 6) AS curve FROM x LEFT JOIN k ON sec = floor(t)::INT""")
def oxygen_interp(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    first = cells.join(F.broadcast(cells.agg(F.min("cell_id").alias("cell_id"))), "cell_id")
    curve = signals.to_frames(first, "trace", "value").select((F.col("frame") + 1).alias("sec"), "value")
    timed = _events(spark, sf_dir).select("event_id", (F.col("value") / 7.5).alias("t"))
    return signals.interpolate_curve(timed, "t", curve).select("event_id", F.round("curve", 6).alias("curve"))


def _baseline_sql(window: int, percentile: int, step: int) -> str:
    size = window // step
    left, place = size // 2, int(size * percentile / 100)
    return f"""WITH s AS (SELECT vec_id AS cell_id, list_transform(range(0, len(embedding), {step}), lambda i: embedding[i + 1]::DOUBLE) AS s, len(embedding) AS n FROM embeddings),
b AS (SELECT cell_id, n, list_transform(range(len(s)), lambda i: list_sort(list_transform(range(i - {left}, i - {left} + {size}), lambda j:
  s[CASE WHEN ((j % (2 * len(s))) + 2 * len(s)) % (2 * len(s)) < len(s) THEN ((j % (2 * len(s))) + 2 * len(s)) % (2 * len(s)) ELSE 2 * len(s) - 1 - ((j % (2 * len(s))) + 2 * len(s)) % (2 * len(s)) END + 1]))[{place + 1}]) AS b FROM s),
f AS (SELECT cell_id, b, unnest(range(n))::INT AS frame FROM b)
SELECT cell_id, frame, round(b[least(frame // {step}, len(b) - 2) + 1] + (b[least(frame // {step}, len(b) - 2) + 2] - b[least(frame // {step}, len(b) - 2) + 1]) * (frame - least(frame // {step}, len(b) - 2) * {step}) / {step}.0, 6) AS baseline FROM f"""


@_query(_baseline_sql(40, 20, 1))
def percentile_baseline(spark, sf_dir):
    based = signals.percentile_baseline(_cells(spark, sf_dir), window=40, percentile=20, step=1)
    return signals.to_frames(based, "baseline", "baseline", "cell_id").withColumn("baseline", F.round("baseline", 6))


@_query(_baseline_sql(30, 20, 3))
def percentile_baseline_stride(spark, sf_dir):
    based = signals.percentile_baseline(_cells(spark, sf_dir), window=30, percentile=20, step=3)
    return signals.to_frames(based, "baseline", "baseline", "cell_id").withColumn("baseline", F.round("baseline", 6))


@_query("WITH $CELLS SELECT cell_id, frame, round((value + 3) / ((avg(value) OVER (PARTITION BY cell_id)) + 3) - 1, 6) AS dff FROM c")
def delta_f_over_f(spark, sf_dir):
    """Change over the cell's mean, both lifted by 3 to stay positive."""
    cells = signals.with_moments(_cells(spark, sf_dir))
    dff = signals.delta_f(F.transform("trace", lambda x: x + 3), F.array_repeat(F.col("mean") + 3, F.size("trace")))
    return signals.to_frames(cells.withColumn("dff", dff), "dff", "dff", "cell_id").withColumn("dff", F.round("dff", 6))


@_query("""WITH v AS (SELECT vec_id AS cell_id, embedding AS e FROM embeddings) SELECT cell_id, list_max(e) <= 0.3 AS bounded, len(list_filter(e, lambda x: isnan(x) OR isinf(x))) = 0 AS finite FROM v""")
def validity_mask(spark, sf_dir):
    return _cells(spark, sf_dir).select("cell_id", signals.valid_bounded("trace", 0.3).alias("bounded"), signals.valid_finite("trace").alias("finite"))


_TEMPLATES = f"""WITH $CELLS, {_Z}, t AS (SELECT label AS tl, frame, avg(z) AS tv FROM z GROUP BY label, frame),
tr AS (SELECT tl, frame, rank() OVER (PARTITION BY tl ORDER BY tv) + (count(*) OVER (PARTITION BY tl, tv) - 1) / 2.0 AS rt FROM t),
cr AS (SELECT cell_id, frame, rank() OVER (PARTITION BY cell_id ORDER BY value) + (count(*) OVER (PARTITION BY cell_id, value) - 1) / 2.0 AS rc FROM c),
r AS (SELECT cell_id, tl, round(coalesce(covar_pop(rc, rt) / nullif(stddev_pop(rc) * stddev_pop(rt), 0), 0), 9) AS r FROM cr JOIN tr USING (frame) GROUP BY cell_id, tl),
b AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY r DESC, tl) AS k FROM r)"""


@_query(_TEMPLATES + " SELECT cell_id, CASE WHEN r >= 0.1 THEN tl ELSE -1 END AS assigned, round(r, 6) AS best_r FROM b WHERE k = 1")
def template_argmax(spark, sf_dir):
    cells = signals.zscore(_cells(spark, sf_dir))
    labels, traces = populations.templates(populations.label_means(cells, "label"), "label")
    return populations.assign_templates(cells, labels, traces, 0.1).select("cell_id", F.coalesce("assigned", F.lit(-1)).alias("assigned"), F.round("best_r", 6).alias("best_r"))


@_query(f"WITH $CELLS, {_Z} SELECT label, frame, round(avg(z), 6) AS mean, count(*)::BIGINT AS n FROM z GROUP BY label, frame HAVING count(*) >= 50")
def cluster_activity(spark, sf_dir):
    means = populations.label_means(signals.zscore(_cells(spark, sf_dir)), "label", least=50)
    return means.withColumn("mean", F.round("mean", 6))


@_query("""WITH $CELLS, m AS (SELECT cell_id, max(abs(value)) AS m FROM c GROUP BY cell_id),
a AS (SELECT cell_id, frame, value, abs(value) > 0.9 * m AS big, row_number() OVER (PARTITION BY cell_id ORDER BY abs(value) DESC, frame) AS k FROM c JOIN m USING (cell_id)),
s AS (SELECT cell_id, min(frame) FILTER (k = 1) AS component, min(sign(value)) FILTER (k = 1)::INT AS sgn FROM a GROUP BY cell_id HAVING count(*) FILTER (big) = 1)
SELECT component::INT AS component, sgn AS sign, count(*)::BIGINT AS n FROM s GROUP BY ALL""")
def sparse_seed_groups(spark, sf_dir):
    marked = populations.seed_groups(_cells(spark, sf_dir), "trace", 0.9)
    return marked.filter("seed").groupBy("component", "sign").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_RANKS}, {_Z}, b AS (SELECT cell_id, round(r / 0.1, 9) AS s, r FROM r),
n AS (SELECT cell_id, CASE WHEN r > -1 AND s < -8 THEN 0 WHEN s > 8 AND r < 1 THEN 17 WHEN s > -8 AND s < 8 AND s <> floor(s) THEN floor(s)::INT + 9 END AS bin FROM b)
SELECT bin::INT AS bin, frame, round(avg(z), 6) AS mean FROM n JOIN z USING (cell_id) WHERE bin IS NOT NULL GROUP BY ALL""")
def oxygen_ref_bins(spark, sf_dir):
    cells = signals.zscore(_cells(spark, sf_dir))
    scored = signals.rank_correlation(cells, _mean_reference(cells)).withColumn("bin", populations.reference_bin(F.col("r")[0]))
    return populations.label_means(scored, "bin").select("bin", "frame", F.round("mean", 6).alias("mean"))


@_query("""WITH $CELLS, m AS (SELECT frame, avg(value) AS x FROM c GROUP BY frame),
g AS (SELECT cell_id, covar_pop(x, value) AS k, var_pop(x) AS v, var_pop(value) AS vy, avg(x) AS mx, avg(value) AS my, count(*) AS n FROM c JOIN m USING (frame) GROUP BY cell_id),
w AS (SELECT *, k * n / (v * n + 0.1) AS w FROM g)
SELECT cell_id, round(w, 6) AS weight, round(my - mx * w, 6) AS intercept, round(1 - (vy - 2 * w * k + w * w * v) / nullif(vy, 0), 6) AS r2 FROM w""")
def ridge_one_lag(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    mean = signals.population_mean(cells).withColumnRenamed("mean", "x")
    paired = signals.to_frames(cells, "trace", "y", "cell_id").join(F.broadcast(mean), "frame")
    fits = models.ridge_one_lag(paired, "cell_id", "x", "y")
    return fits.select("cell_id", *[F.round(c, 6).alias(c) for c in ("weight", "intercept", "r2")])


@_query("WITH $CELLS SELECT cell_id, (frame // 9)::INT AS bin, round(avg(value), 6) AS value FROM c GROUP BY ALL HAVING count(*) = 9")
def bin_mean(spark, sf_dir):
    frames = signals.to_frames(_cells(spark, sf_dir), "trace", "value", "cell_id")
    return signals.bin_means(frames, ["cell_id"], "frame", "value", 9).withColumn("value", F.round("value", 6))


@_query("""WITH $CELLS SELECT cell_id, frame, round(0.25 * coalesce(lead(value) OVER w, 0) + 0.5 * value + 0.25 * coalesce(lag(value) OVER w, 0), 6) AS smooth FROM c WINDOW w AS (PARTITION BY cell_id ORDER BY frame)""")
def smooth_trace(spark, sf_dir):
    done = signals.smooth(_cells(spark, sf_dir), [0.25, 0.5, 0.25])
    return signals.to_frames(done, "smooth", "smooth", "cell_id").withColumn("smooth", F.round("smooth", 6))


@_query("WITH $EVENTS SELECT event_id, round(cume_dist() OVER (PARTITION BY user_id ORDER BY value), 9) AS ecdf FROM e")
def ecdf(spark, sf_dir):
    return signals.ecdf(_events(spark, sf_dir), _KEY, "value").select("event_id", F.round("ecdf", 9).alias("ecdf"))


@_query("""WITH p AS (SELECT user_id, quantile_cont(value, 0.7) AS t FROM events GROUP BY user_id)
SELECT event_id, round(t, 6) AS threshold, round(sqrt(greatest(value - t, 0)), 6) AS power FROM events JOIN p USING (user_id)""")
def signal_percentiles(spark, sf_dir):
    powered = signals.swim_power(_events(spark, sf_dir), _KEY, "value")
    return powered.select("event_id", F.round("threshold", 6).alias("threshold"), F.round("power", 6).alias("power"))


@_query("""WITH $EVENTS SELECT event_id, round(avg(value) OVER w, 6) AS roll_mean, round(stddev_samp(value) OVER w, 6) AS roll_std FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""")
def rolling_mean_std(spark, sf_dir):
    rolled = signals.rolling(_events(spark, sf_dir), _KEY, _ORDER, "value", 6)
    return rolled.select("event_id", F.round("roll_mean", 6).alias("roll_mean"), F.round("roll_std", 6).alias("roll_std"))


@_query("""WITH $EVENTS SELECT event_id, round(quantile_cont(value, 0.2) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS roll_quantile FROM e""")
def rolling_percentile(spark, sf_dir):
    rolled = signals.rolling(_events(spark, sf_dir), _KEY, _ORDER, "value", 7, 0.2)
    return rolled.select("event_id", F.round("roll_quantile", 6).alias("roll_quantile"))


@_query("""WITH $EVENTS SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS trailing FROM e""")
def trailing_sum(spark, sf_dir):
    return signals.trailing_sum(_events(spark, sf_dir), _KEY, _ORDER, "value", 5).select("event_id", F.round("trailing", 6).alias("trailing"))


@_query("""WITH $EVENTS SELECT event_id, value AS lag_0, coalesce(lag(value, 1) OVER w, 0) AS lag_1, coalesce(lag(value, 2) OVER w, 0) AS lag_2, coalesce(lag(value, 3) OVER w, 0) AS lag_3
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def lag_design(spark, sf_dir):
    return signals.lag_design(_events(spark, sf_dir), _KEY, _ORDER, "value", 4).select("event_id", *[f"lag_{k}" for k in range(4)])


@_query("""WITH $EVENTS, b AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM e)
SELECT user_id, count(*)::BIGINT AS edges, min(us)::BIGINT AS first_us FROM b WHERE p < 100 AND value > 100 GROUP BY user_id""")
def rising_edges(spark, sf_dir):
    edges = signals.rising_edges(_events(spark, sf_dir), _KEY, _ORDER, "value", 100.0)
    return edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("edges"), F.min("us").alias("first_us"))


@_query("""WITH $EVENTS, b AS (SELECT *, lead(value, 1) OVER w AS n1, lead(value, 2) OVER w AS n2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, user_id FROM b WHERE n1 > value AND n2 < n1""")
def local_maxima(spark, sf_dir):
    return signals.local_maxima(_events(spark, sf_dir), _KEY, _ORDER, "value").select("event_id", "user_id")


@_query("""WITH $EVENTS, x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS p, CASE WHEN value < 350 THEN value END AS v FROM e),
k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1,
 last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1
 FROM x WINDOW b AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v0 + (v1 - v0) * coalesce((p - p0)::DOUBLE / nullif(p1 - p0, 0), 0), v0, v1), 6) AS filled FROM k""")
def gap_fill(spark, sf_dir):
    from pyspark.sql import Window

    placed = _events(spark, sf_dir).withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy(*_ORDER)))
    holes = placed.withColumn("v", F.when(F.col("value") < 350, F.col("value")))
    return signals.gap_fill(holes, _KEY, "p", "v").select("event_id", F.round("filled", 6).alias("filled"))


@_query("""WITH $EVENTS, h AS (SELECT user_id, us // 86400000000 AS day, floor(value / 25)::INT AS bin, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT d.user_id, d.day, b.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT user_id, day FROM h) d JOIN (SELECT DISTINCT user_id, bin FROM h) b USING (user_id) LEFT JOIN h ON h.user_id = d.user_id AND h.day = d.day AND h.bin = b.bin),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id, bin ORDER BY day)::BIGINT AS s FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s DESC, bin) AS k FROM c)
SELECT user_id, day::BIGINT AS day, bin::INT AS mode_bin, s::BIGINT AS n FROM k WHERE k = 1""")
def histogram_mode(spark, sf_dir):
    daily = _events(spark, sf_dir).withColumn("day", F.expr("us div 86400000000"))
    return signals.histogram_mode(daily, _KEY, "day", "value", 25.0)


_RUNS = """WITH $EVENTS, s AS (SELECT user_id, value > 60 AS state, row_number() OVER w - 1 AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
d AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY user_id ORDER BY i) IS NOT DISTINCT FROM state AND i > 0 THEN 0 ELSE 1 END AS c FROM s),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM d),
runs AS (SELECT user_id, run::BIGINT AS run, any_value(state) AS state, min(i)::INT AS start, max(i)::INT AS "end", count(*)::BIGINT AS length FROM g GROUP BY user_id, run)"""


@_query(_RUNS + " SELECT * FROM runs")
def bout_runs(spark, sf_dir):
    return ev.find_runs(_events(spark, sf_dir), _KEY, _ORDER, F.col("value") > 60)


@_query(_RUNS + """, a AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY user_id ORDER BY start) - 1 < 2 THEN 0 ELSE 1 END AS nw FROM runs WHERE state),
b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY start) AS bout FROM a),
f AS (SELECT user_id, bout::BIGINT AS bout, min(start)::INT AS start, max("end")::INT AS "end" FROM b GROUP BY user_id, bout),
l AS (SELECT user_id, max("end") AS last FROM runs GROUP BY user_id),
k AS (SELECT f.* FROM f JOIN l USING (user_id) WHERE start > 0 AND "end" < last)
SELECT user_id, bout, start, "end", ("end" - start + 1)::DOUBLE AS duration, (start - lag(start) OVER w)::DOUBLE AS initiation_gap, (start - lag("end") OVER w - 1)::DOUBLE AS gap_before FROM k WINDOW w AS (PARTITION BY user_id ORDER BY start)""")
def bout_features(spark, sf_dir):
    return ev.bout_features(_events(spark, sf_dir), _KEY, _ORDER, F.col("value") > 60)


@_query("""WITH $EVENTS, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS g FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM n)
SELECT user_id, session::BIGINT AS session, min(us)::BIGINT AS start, max(us)::BIGINT AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, session HAVING min(us) <> max(us)""")
def burst_sessions(spark, sf_dir):
    return ev.sessions(_events(spark, sf_dir), _KEY, "us", "event_id", 7_200_000_000)


@_query("""WITH $EVENTS, o AS (SELECT event_id AS onset_id, user_id, us AS onset FROM e WHERE event_type = 'purchase')
SELECT onset_id, floor((e.us - onset) / 3600000000.0)::BIGINT AS bin, avg(round_even(value * 100, 0)) AS mean, count(*)::BIGINT AS n
FROM o JOIN e ON e.user_id = o.user_id AND e.us >= onset - 21600000000 AND e.us < onset + 43200000000 GROUP BY ALL""")
def bout_windows(spark, sf_dir):
    e = _events(spark, sf_dir)
    onsets = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("onset_id"), "user_id", F.col("us").alias("onset"))
    met = ev.event_windows(onsets, _cents(e), _KEY, "onset", "us", 21_600_000_000, 43_200_000_000)
    return met.groupBy("onset_id", F.floor(F.col("offset") / 3600000000.0).alias("bin")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


@_query("""WITH $EVENTS, iv AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'a' ELSE 'b' END AS kind, us // 1000000 AS s, us // 1000000 + 60 + floor(value)::BIGINT * 30 AS t FROM e),
p AS (SELECT user_id, pos, sum(CASE WHEN kind = 'a' THEN d ELSE 0 END) AS a, sum(CASE WHEN kind = 'b' THEN d ELSE 0 END) AS b
 FROM (SELECT user_id, kind, s AS pos, 1 AS d FROM iv UNION ALL SELECT user_id, kind, t, -1 FROM iv) GROUP BY user_id, pos),
r AS (SELECT user_id, lead(pos) OVER w - pos AS l, sum(a) OVER w AS a, sum(b) OVER w AS b FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, coalesce(sum(CASE WHEN a > 0 AND b > 0 THEN l END), 0)::BIGINT AS both_open, coalesce(sum(CASE WHEN a <= 0 AND b > 0 THEN l END), 0)::BIGINT AS only_b FROM r GROUP BY user_id""")
def interval_overlap(spark, sf_dir):
    """Seconds in which intervals of both kinds are open, and of the second kind alone."""
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "a").otherwise("b")
    start = F.expr("us div 1000000")
    intervals = e.select("user_id", kind.alias("kind"), start.alias("s"), (start + 60 + F.floor("value") * 30).alias("t"))
    return ev.overlap_length(ev.sweep(intervals, _KEY, "kind", "s", "t"), _KEY)


@_query("""WITH $EVENTS, o AS (SELECT user_id, us AS onset, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS epoch FROM e WHERE event_type = 'purchase'),
w AS (SELECT epoch, floor((e.us - onset) / 3600000000.0)::BIGINT AS hour, round_even(value * 100, 0) AS value FROM o JOIN e ON e.user_id = o.user_id AND e.us >= onset - 21600000000 AND e.us < onset + 43200000000),
b AS (SELECT epoch, avg(value) AS b FROM w WHERE hour < 0 GROUP BY epoch)
SELECT epoch, hour, avg(value) - coalesce(any_value(b), 0) AS mean FROM w LEFT JOIN b USING (epoch) GROUP BY epoch, hour""")
def trial_mean_by_epoch(spark, sf_dir):
    e = _events(spark, sf_dir)
    epoch = F.when(F.pmod("event_id", F.lit(2)) == 0, "even").otherwise("odd")
    onsets = e.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("onset"), epoch.alias("epoch"))
    met = ev.event_windows(onsets, _cents(e), _KEY, "onset", "us", 21_600_000_000, 43_200_000_000)
    trials = met.select("epoch", F.floor(F.col("offset") / 3600000000.0).alias("hour"), "value")
    return ev.epoch_means(trials, "epoch", "hour", "value", 0)


@_query("""WITH y AS (SELECT l_returnflag || l_linestatus AS a, l_linenumber AS b, avg(l_quantity) AS y FROM lineitem GROUP BY ALL),
c AS (SELECT * FROM y), g AS (SELECT avg(y) AS g FROM c),
sa AS (SELECT sum(n * (m - g) ** 2) AS s, count(*) - 1 AS d FROM (SELECT avg(y) AS m, count(*) AS n FROM c GROUP BY a), g),
sb AS (SELECT sum(n * (m - g) ** 2) AS s, count(*) - 1 AS d FROM (SELECT avg(y) AS m, count(*) AS n FROM c GROUP BY b), g),
st AS (SELECT sum((y - g) ** 2) AS s, count(*) - 1 AS d FROM c, g)
SELECT round(sa.s, 6) AS ss_a, round(sb.s, 6) AS ss_b, round(st.s - sa.s - sb.s, 6) AS ss_error, sa.d::BIGINT AS df_a, sb.d::BIGINT AS df_b, (st.d - sa.d - sb.d)::BIGINT AS df_error FROM sa, sb, st""")
def two_way_anova_ss(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("a"), F.col("l_linenumber").alias("b"), "l_quantity")
    sums = populations.two_way_sums(rows, "a", "b", "l_quantity")
    return sums.select(*[F.round(c, 6).alias(c) for c in ("ss_a", "ss_b", "ss_error")], *[F.col(c).cast("bigint").alias(c) for c in ("df_a", "df_b", "df_error")])


@_query("""SELECT l_returnflag, l_linestatus, count(l_discount)::BIGINT AS n, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, round(quantile_cont(l_discount, 0.5), 6) AS median FROM lineitem GROUP BY ALL""")
def run_summary(spark, sf_dir):
    got = populations.summarise(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount")
    return got.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])


@_query("""WITH p AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS se, count(m)::BIGINT AS units FROM p GROUP BY ALL""")
def mean_over_animals(spark, sf_dir):
    got = populations.mean_of_means(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey", "l_quantity")
    return got.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), "units")


@_query("""SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber)::INT AS rank FROM (SELECT l_returnflag, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL)""")
def cluster_sizes(spark, sf_dir):
    return populations.bin_counts(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber")


def _points(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    z, y, x = F.pmod("l_suppkey", F.lit(12)) + 0.5, F.pmod("l_partkey", F.lit(30)) * 1.0, F.col("l_quantity") / 2
    return li.select(z.alias("z"), y.alias("y"), x.alias("x"), F.rint(F.col("l_discount") * 100).alias("v"), F.pmod("l_orderkey", F.lit(5)).alias("animal"))


@_query("""WITH p AS (SELECT round_even(l_suppkey % 12 + 0.5, 0)::INT AS z, round_even((l_partkey % 30)::DOUBLE, 0)::INT AS y, round_even(l_quantity / 2, 0)::INT AS x, round_even(l_discount * 100, 0) AS v FROM lineitem),
s AS (SELECT z, y, x, sum(v) AS s, count(*) AS n FROM p WHERE z > 0 AND z < 12 AND y > 0 AND y < 29 AND x > 0 AND x < 25 GROUP BY ALL),
wz AS (SELECT vz AS z, y, x, sum(s) AS s, sum(n) AS n FROM (SELECT *, unnest(range(greatest(z - 1, 0), least(z, 12) + 1)) AS vz FROM s) GROUP BY vz, y, x),
wy AS (SELECT z, vy AS y, x, sum(s) AS s, sum(n) AS n FROM (SELECT *, unnest(range(greatest(y - 2, 0), least(y + 1, 29) + 1)) AS vy FROM wz) GROUP BY z, vy, x),
w AS (SELECT z, y, vx AS x, sum(s) AS s, sum(n) AS n FROM (SELECT *, unnest(range(greatest(x - 2, 0), least(x + 1, 25) + 1)) AS vx FROM wy) GROUP BY z, y, vx)
SELECT z::INT AS z, y::INT AS y, x::INT AS x, n::BIGINT AS n, s / n AS mean FROM w WHERE n >= 10""")
def box_support_map(spark, sf_dir):
    """Values are whole numbers, so sums are exact and means need no rounding."""
    return voxels.box_map(_points(spark, sf_dir), ["z", "y", "x"], "v", (1, 2, 2), (13, 30, 26), 10)


@_query("""WITH d AS (SELECT DISTINCT l_orderkey % 5 AS animal, (l_suppkey % 12)::INT AS z, (l_partkey % 2000)::INT AS y FROM lineitem),
k(o, w) AS (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)),
a AS (SELECT animal, CASE WHEN z + o < 0 THEN -1 - (z + o) WHEN z + o >= 12 THEN 23 - (z + o) ELSE z + o END AS z, y, sum(w) AS v FROM d, k GROUP BY ALL),
b AS (SELECT animal, z, CASE WHEN y + o < 0 THEN -1 - (y + o) WHEN y + o >= 2000 THEN 3999 - (y + o) ELSE y + o END AS y, sum(v * w) AS v FROM a, k GROUP BY ALL),
m AS (SELECT animal, max(v) AS top FROM b GROUP BY animal)
SELECT z::INT AS z, y::INT AS y, count(*)::BIGINT AS animals FROM b JOIN m USING (animal) WHERE v > top * 0.5 GROUP BY z, y""")
def animal_overlap_map(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    points = li.select(F.pmod("l_orderkey", F.lit(5)).alias("animal"), F.pmod("l_suppkey", F.lit(12)).cast("int").alias("z"), F.pmod("l_partkey", F.lit(2000)).cast("int").alias("y"))
    kernel = [0.25, 0.5, 0.25]
    return voxels.overlap_map(points, "animal", ["z", "y"], [kernel, kernel], (12, 2000), 0.5)


@_query("""SELECT vec_id AS cell_id, round((0.9 * e[1]::DOUBLE * 2 + 0.1 * e[2]::DOUBLE * 2 + 1.5) / 4, 6) AS x_reg, round((e[2]::DOUBLE * 2 - 0.2 * e[3]::DOUBLE * 5 - 2) / 4, 6) AS y_reg, round((e[3]::DOUBLE * 5 + 0.5) / 8, 6) AS z_reg
FROM (SELECT vec_id, embedding AS e FROM embeddings)""")
def affine_points(spark, sf_dir):
    at = _cells(spark, sf_dir).select("cell_id", *[F.col("trace")[i].alias(a) for i, a in enumerate("xyz")])
    moved = voxels.affine(at, ["x", "y", "z"], [[0.9, 0.1, 0], [0, 1, -0.2], [0, 0, 1]], [1.5, -2, 0.5], [2, 2, 5], [4, 4, 8])
    return moved.select("cell_id", *[F.round(f"{a}_reg", 6).alias(f"{a}_reg") for a in "xyz"])


@_query("""WITH w AS (SELECT l_orderkey, CASE WHEN l_discount > 0.005 THEN l_discount ELSE 0 END AS w, l_quantity AS x, l_tax * 100 AS y FROM lineitem)
SELECT l_orderkey, round(sum(w * x) / nullif(sum(w), 0), 6) AS x, round(sum(w * y) / nullif(sum(w), 0), 6) AS y FROM w GROUP BY l_orderkey""")
def weighted_centroid(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"))
    got = voxels.weighted_centroid(li, ["l_orderkey"], ["x", "y"], "l_discount")
    return got.select("l_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@_query("""WITH p AS (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, round(greatest(least(value, hi) - lo, 0) / nullif(hi - lo, 0), 6) AS normal FROM events, p""")
def intensity_normalise(spark, sf_dir):
    return voxels.normalise_intensity(_events(spark, sf_dir), "value", 0.1, 0.99).select("event_id", F.round("normal", 6).alias("normal"))


@_query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS b1, l_discount AS b0, l_tax AS r2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(log2(b1 / b0), 6) AS ratio FROM f WHERE b0 > 0 AND r2 >= 0.02 AND b1 / b0 > 0""")
def beta_ratio_filter(spark, sf_dir):
    """log2 ratio of two fits where both are finite, the reference is positive and r2 suffices."""
    li = _table(spark, sf_dir, "lineitem").withColumns({"b1": populations.finite(F.try_divide("l_extendedprice", "l_quantity")), "b0": populations.finite("l_discount")})
    kept = li.filter((F.col("b0") > 0) & (F.col("l_tax") >= 0.02)).withColumn("ratio", F.log2(F.try_divide("b1", "b0"))).filter("ratio is not null")
    return kept.select("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio"))


@_query("""WITH $CELLS, g AS (SELECT label, frame, value, unnest(range(24))::INT AS o FROM c),
x AS (SELECT label, o, value, CASE WHEN (frame + o) % 24 < 6 THEN 0.1 WHEN (frame + o) % 24 < 16 THEN -0.1 ELSE 0.05 END AS l FROM g)
SELECT label, o AS "offset", round(avg(abs(value - l)), 6) AS mae, round(avg((abs(value - l) <= 0.02 * 0.2 + 1e-5 * abs(l))::INT), 6) AS matched FROM x GROUP BY ALL""")
def stimulus_alignment(spark, sf_dir):
    frames = signals.to_frames(_cells(spark, sf_dir), "trace", "value", "label")
    got = models.stimulus_offsets(frames, "label", "frame", "value", [6, 16, 24], [0.1, -0.1, 0.05])
    return got.select("label", "offset", F.round("mae", 6).alias("mae"), F.round("matched", 6).alias("matched"))


@_query("""SELECT n_name AS animal, coalesce(count(o_orderkey), 0)::BIGINT AS files FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def recordings_presence(spark, sf_dir):
    """Every catalog entry with its number of files, those with none included."""
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    files = _table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))
    nations = _table(spark, sf_dir, "nation").join(files, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return nations.select(F.col("n_name").alias("animal"), F.coalesce("n", F.lit(0)).alias("files"))


# fitted models: no SQL twin; tests hold them against closed forms


@_query()
def ridge_lag_scan(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return models.ridge_scan(cells, "cell_id", _mean_reference(cells))


@_query()
def logit_fit(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(*_ORDER)
    rows = _events(spark, sf_dir).withColumns({"before": F.lag("value").over(w) / 500, "second": F.lag("value", 2).over(w) / 500, "y": F.col("value") > 60})
    return models.logistic_fits(rows, _KEY, ["before", "second"], "y")


@_query()
def low_pass(spark, sf_dir):
    return models.low_pass(_cells(spark, sf_dir)).select("cell_id", "low")


@_query()
def fa_clusters(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return models.loading_labels(models.factor_loadings(cells, "cell_id", 64, 8), "cell_id")


@_query()
def ward_clusters(spark, sf_dir):
    return models.ward_groups(signals.zscore(_cells(spark, sf_dir)), "label", "cell_id", k=3)


def _fits(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    states = {"normal": (0, 32), "hypoxia": (32, 64)}
    return jobs.swim_fits(cells, "cell_id", _mean_reference(cells), states, lags=(2, 4, 6, 8), least=0.1)


@_query()
def swim_fit_states(spark, sf_dir):
    return _fits(spark, sf_dir)


@_query()
def beta_ratio_map(spark, sf_dir):
    """Ratio map of the fits, with the first three coordinates of each cell as its place."""
    at = _cells(spark, sf_dir).select("cell_id", *[((F.col("trace")[i] + 1) * 20).alias(a) for i, a in enumerate("zxy")])
    return jobs.ratio_map(jobs.beta_ratios(_fits(spark, sf_dir), "cell_id", "normal", "hypoxia"), at, ["cell_id"], (40, 40, 40), least=3)


@_query()
def behaviour_model_runs(spark, sf_dir):
    """Four lag specs, twenty runs, every user in both conditions; separated fits are flagged, not drawn again (``tries`` is 1 by default)."""
    bins = _events(spark, sf_dir).withColumns(
        {"o2": F.col("value") / 500, "swim": (F.col("value") > 60).cast("double"), "y": F.col("event_type") == "purchase", "condition": F.when(F.col("us") % 2 == 0, "normal").otherwise("hypoxia")}
    )
    specs = [{"o2": 2}, {"swim": 2}, {"o2": 2, "swim": 2}, {"o2": 4, "swim": 3}]
    return jobs.model_runs(bins, "user_id", "condition", _ORDER, "y", {"o2": "o2", "swim": "swim"}, specs, 20, identity=["event_id"])


@_query()
def pop_mean_p_values(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    scored = signals.rank_correlation(cells, _mean_reference(cells)).withColumn("r", F.get("r", F.lit(0)))
    return scored.withColumn("p", signals.spearman_p("r", F.size("trace").cast("long"))).select("cell_id", "r", "p")


@_query()
def baseline_clusters(spark, sf_dir):
    return jobs.baseline_clusters(_cells(spark, sf_dir), "cell_id", 64, k=8, loading=0.8, least_cells=3, assign=0.2)[0]


@_query()
def factor_subclusters(spark, sf_dir):
    """Subclusters by factors within each label, all labels in the same passes."""
    return jobs.factor_subclusters(_cells(spark, sf_dir), "label", "cell_id", 64, k=4, loading=0.3, least_cells=5)


@_query()
def baseline_subclusters(spark, sf_dir):
    return jobs.subclusters(_cells(spark, sf_dir), "label", "cell_id", 3)


@_query()
def hierarchical_clusters(spark, sf_dir):
    """All values by default but ``noisy``: places of an embedding have no order in time, so no score counts as noise."""
    return jobs.hierarchical_labels(_cells(spark, sf_dir), "cell_id", 64, noisy=1.01)
