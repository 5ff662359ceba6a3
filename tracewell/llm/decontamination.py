"""Benchmark decontamination: exact windows of benchmark words found in training texts.

The hashes of the benchmark's windows form a set that is broadcast. Its size is checked: of a larger set only a Bloom
filter is broadcast, and the text windows that pass it meet the set by shuffle.
Texts are scanned once: every window start becomes one narrow row (place, hash), which probes the set; the words
themselves are compared only where a hash hits. Results are kept by text, so copies are judged once and identically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower, text_key, with_window_hashes, with_words
from tracewell.llm.url_filter import bloom_filter, filter_blocks, may_be_listed
from tracewell.session import broadcast_if_small, materialize

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def _words(df: DataFrame, name: str) -> DataFrame:
    """Adds the lower-cased words of ``text``; null texts have none."""
    return with_words(df, name, ascii_lower(F.col("text")), _SEPARATOR)


def _spelled(m: int):
    return lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice("words", i + 1, F.lit(m)), " ").alias("w"))


def _placed(m: int):
    return lambda h, i: F.struct(i.alias("pos"), F.lit(m).alias("m"), h.alias("h"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """(a written table of item (id as text), m, h, w (words joined by spaces): one row an item and distinct window; the lengths m).

    An item of fewer words than ``window``, but not none, is one window. Items without an id count no item.
    """
    items = _words(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), "words").filter(F.size("words") > 0)
    items = materialize(items.select("item", "words", F.least(F.lit(window), F.size("words")).alias("m")), "items")
    lengths = sorted(r.m for r in items.select("m").distinct().collect())  # at most ``window`` values
    rows = items.select("item", "m", F.lit(0).cast("bigint").alias("h"), F.lit("").alias("w")).limit(0)
    for m in lengths:
        hashed = with_window_hashes(items.filter(F.col("m") == m), "words", [m])
        pairs = F.transform(f"__tw_h{m}", _spelled(m))
        rows = rows.unionByName(hashed.select("item", "m", F.explode(pairs).alias("p")).select("item", "m", "p.h", "p.w"))
    return materialize(rows.distinct(), "windows"), lengths


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast_windows: int = 500_000) -> DataFrame:
    """(k1, k2, hits, items) for every text with a hit: text key, sorted [start, end) word spans, sorted item ids."""
    windows, lengths = benchmark_windows(benchmark, window)
    known = materialize(windows.select(F.xxhash64("m", "h").alias("key")).distinct(), "known")
    texts = docs.select(*[c.alias(n) for n, c in zip(("k1", "k2"), text_key(), strict=True)], "text")
    hashed = with_window_hashes(_words(texts, "words"), "words", lengths or [window])
    # the outer forms: the inner ones would have Catalyst split each text a second time to skip empty ones
    if len(lengths) > 1:
        every = F.concat(*[F.transform(f"__tw_h{m}", _placed(m)) for m in lengths])
        rows = hashed.select("k1", "k2", F.explode_outer(every).alias("s")).select("k1", "k2", "s.*")
    else:
        m = lengths[0] if lengths else window
        rows = hashed.select("k1", "k2", F.posexplode_outer(f"__tw_h{m}").alias("pos", "h")).withColumn("m", F.lit(m))
    rows = rows.filter("h is not null").withColumn("key", F.xxhash64("m", "h"))
    few = known.limit(max_broadcast_windows + 1).count() <= max_broadcast_windows  # of 8 bytes each
    if few:
        rows = rows.join(F.broadcast(known), "key")
    else:
        blocks = filter_blocks(known.count())
        rows = may_be_listed(rows.withColumn("text_key", F.hex("key")), bloom_filter(known.select(F.hex("key").alias("key")), blocks), "text_key", blocks)
        rows = rows.drop("text_key").join(known.hint("shuffle_merge"), "key")
    places = rows.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("pos", "m", "h"))).alias("at"))
    places = materialize(places, "candidates")
    # where a hash hit, the words decide
    again = _words(texts.join(broadcast_if_small(places, 100_000), ["k1", "k2"]), "words")
    spelled = F.transform("at", lambda s: F.struct(s["pos"].alias("pos"), s["m"].alias("m"), s["h"].alias("h"), F.array_join(F.slice("words", s["pos"] + 1, s["m"]), " ").alias("w")))
    found = again.select("k1", "k2", F.explode(spelled).alias("s")).select("k1", "k2", "s.*").distinct()
    met = found.join(broadcast_if_small(windows, 500_000), ["m", "h", "w"])
    return met.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("m")).alias("end")))).alias("hits"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )


def covered(hits: Column) -> Column:
    """The number of words inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("int").alias("reach"))
    grown = lambda s, h: F.struct(
        (s["n"] + F.greatest(h["end"] - F.greatest(h["pos"], s["reach"]), F.lit(0))).alias("n"), F.greatest(s["reach"], h["end"]).alias("reach")
    )
    return F.aggregate(hits, start, grown, lambda s: s["n"])


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, max_broadcast_windows: int = 500_000) -> DataFrame:
    """Adds __tw_spans and __tw_items."""
    found = materialize(find_hits(docs, benchmark, window, max_broadcast_windows), "hits")
    found = found.select(F.col("k1").alias("__tw_k1"), F.col("k2").alias("__tw_k2"), F.col("hits").alias("__tw_spans"), F.col("items").alias("__tw_items"))
    k1, k2 = text_key()
    joined = docs.withColumns({"__tw_k1": k1, "__tw_k2": k2}).join(broadcast_if_small(found, 100_000), ["__tw_k1", "__tw_k2"], "left").drop("__tw_k1", "__tw_k2")
    return joined.withColumns(
        {"__tw_spans": F.coalesce("__tw_spans", F.array().cast("array<struct<pos:int,end:int>>")), "__tw_items": F.coalesce("__tw_items", F.array().cast("array<string>"))}
    )


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast_windows: int = 500_000) -> DataFrame:
    """Adds hit_spans (array<struct<pos, end>>, word positions) and hit_items (array<string>), both empty where clean.

    ``docs`` needs a text column; null and empty texts are clean, and so is everything if the benchmark has no words.
    Existing columns of the added names are replaced; repeated rows are judged alike; texts of any length are
    searched whole; an empty table gives an empty result.
    """
    marked = _marked(docs.drop("hit_spans", "hit_items"), benchmark, window, max_broadcast_windows)
    return marked.withColumnsRenamed({"__tw_spans": "hit_spans", "__tw_items": "hit_items"})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Only the documents without a hit, with their own columns, whatever their names; null and empty texts stay.

    Texts of any length are searched whole. An empty table gives an empty result, an empty benchmark drops nothing.
    """
    return _marked(docs, benchmark, window).filter(F.size("__tw_spans") == 0).select([F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, with the hit words cut out of the texts; what stands between words stays as it is.

    Null and empty texts and the other columns, whatever their names, are untouched; an empty table gives an empty result.
    """
    marked = _marked(docs, benchmark, window)
    pieces = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    marked = marked.withColumn("__tw_p", F.when(F.size("__tw_spans") > 0, pieces)).withColumn("__tw_f", F.when(F.element_at("__tw_p", 1).rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0))

    def stays(_: Column, i: Column) -> Column:
        at = i - F.col("__tw_f")  # words have even places, counted from the first word
        return (F.pmod(at, F.lit(2)) != 0) | ~F.exists("__tw_spans", lambda s: (s["pos"] * 2 <= at) & (at < s["end"] * 2))

    cut = F.array_join(F.filter("__tw_p", stays), "")
    return marked.withColumn("text", F.when(F.size("__tw_spans") > 0, cut).otherwise(F.col("text"))).select([F.col(f"`{c}`") for c in docs.columns])


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """The digest of every document's hits; null and empty texts have no words and no hits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _words(marked, "__tw_w").select(
        "doc_id",
        F.size("__tw_w").cast("bigint").alias("n_words"),
        covered(F.col("hit_spans")).alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM bl)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT rid, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w
       FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, ms WHERE len(ws) >= m)),
h AS (SELECT rid, dw.m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.w = bw.w),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""
