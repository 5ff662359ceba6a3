"""URL filter: a blocked Bloom filter of listed entries, then an exact hash join.

Listed entries are rules (host and path prefix, which fit the host and its subdomains) and canonical URLs: of one page,
of a directory or of a host. Every page's canonical URL, its parents and its host's suffixes are looked up in the filter,
whose size follows the list's; the few survivors meet the list in an exact join, which removes the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import LOWER, UPPER, with_words
from tracewell.session import broadcast_if_small, materialize

#: Bits of a block, and bits set by a key.
_BLOCK_BITS, _BITS = 256, 8
#: Bits of filter a listed key, and the largest filter that is broadcast (80 MB). A larger list fills it more densely, so
#: more false positives reach the exact join; none is missed.
_KEY_BITS, _MOST_BLOCKS = 16, 1 << 20


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., and path without ending slashes: what a listed URL is known by."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.lit(" "), F.regexp_replace(path, r"/+$", ""))


def directory(host: Column, path: Column) -> Column:
    """The parent that stands for all pages of a host below the first part of the path; no page's path has its sign."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.lit(" "), F.regexp_extract(path, r"^/?[^/]*", 0), F.lit("?"))


def whole_host(host: Column) -> Column:
    """The parent that stands for all pages of a host."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.lit(" ?"))


def listed_under(host: Column, path: Column) -> Column:
    """All keys by which a list may know a page: its canonical URL, its directory, its host."""
    return F.array(canonical(host, path), directory(host, path), whole_host(host))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The key's bits in its block, as four longs; their positions come from a second hash."""
    at = [F.shiftrightunsigned(F.xxhash64(F.lit("bits"), key), 8 * j).bitwiseAND(F.lit(255)).cast("int") for j in range(_BITS)]
    one = F.lit(1).cast("bigint")
    bit = [F.call_function("shiftleft", one, a % 64) for a in at]
    return [reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.floor(a / 64) == w, b).otherwise(F.lit(0).cast("bigint")) for a, b in zip(at, bit, strict=True)]) for w in range(4)]


def filter_blocks(n: int) -> int:
    """Blocks of a filter of ``n`` keys."""
    return min(_MOST_BLOCKS, max(1024, -(-n * _KEY_BITS // _BLOCK_BITS)))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of a table with a string column ``key``: one row a block at most."""
    masked = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return masked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def may_be_listed(rows: DataFrame, bloom: DataFrame, key: str, blocks: int) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and few others."""
    named = bloom.select(F.col("block").alias("__tw_block"), *[F.col(f"w{i}").alias(f"__tw_w{i}") for i in range(4)])
    masked = rows.withColumns({"__tw_block": _block(F.col(key), blocks)} | {f"__tw_m{i}": m for i, m in enumerate(_masks(F.col(key)))})
    hit = reduce(lambda x, y: x & y, [F.col(f"__tw_w{i}").bitwiseAND(F.col(f"__tw_m{i}")) == F.col(f"__tw_m{i}") for i in range(4)])
    return masked.join(F.broadcast(named), "__tw_block").filter(hit).drop("__tw_block", *[f"__tw_{x}{i}" for x in "wm" for i in range(4)])


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds host, path, rule and verdict to every page; existing columns of these names are replaced.

    ``rules``: host, path, verdict (of repeated rules the lesser verdict wins); ``listed``: canonical URLs in a column
    ``key``, of pages, directories or hosts. The longest rule that fits wins, then what is listed blocks, then the page is
    allowed. Null URLs and those
    without :// have an empty host and path, which fit no rule with a host. An empty table gives an empty result.

    Distinct host and path pairs are judged once, so a URL that fills the table is no hot spot. A host is looked up by
    as many of its last labels as any rule has, and its path by the lengths of that host's rules only, so neither long
    URLs nor long lists multiply the lookups.
    """
    rules = materialize(rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")), "rules")
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first().n or 1
    entries = rules.select(F.concat(F.lit("r "), "host", F.lit(" "), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length(F.concat("host", "path")).alias("rank"))
    exact = listed.select(F.concat(F.lit("u "), "key").alias("key")).distinct().select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(-1).alias("rank"))
    entries = materialize(entries.unionByName(exact), "entries")
    by_host = rules.groupBy(F.concat(F.lit("h "), "host").alias("key")).agg(F.collect_set(F.char_length("path")).alias("lengths"))
    index = materialize(by_host.unionByName(entries.filter("rank < 0").select("key", F.lit(None).cast("array<int>").alias("lengths"))), "index")
    blocks = filter_blocks(index.count())
    bloom = bloom_filter(index.select("key"), blocks)

    seen = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, pages.count() // _TASK_URLS)
    # dealt out by a stated number: their bytes are few, but each is looked up many times
    urls = seen.select("host", "path").distinct().repartition(tasks, "host", "path")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.", labels + 1)), F.lit(labels))), lambda n: F.concat(F.lit("h "), F.call_function("substring_index", "host", F.lit("."), -n)))
    urls = urls.withColumn("key", F.explode(F.concat(F.transform(listed_under(F.col("host"), F.col("path")), lambda k: F.concat(F.lit("u "), k)), ends)))
    met = may_be_listed(urls, bloom, "key", blocks).join(broadcast_if_small(index, 200_000), "key")
    fitting = F.filter("lengths", lambda k: k <= F.char_length("path"))
    prefixed = F.transform(fitting, lambda k: F.concat(F.lit("r "), F.call_function("substr", "key", F.lit(3)), F.lit(" "), F.call_function("substr", "path", F.lit(1), k)))
    asked = met.select("host", "path", F.explode(F.coalesce(prefixed, F.array("key"))).alias("key"))
    hits = asked.join(broadcast_if_small(entries, 200_000), "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias("b"))
    verdicts = best.select(F.col("host").alias("__tw_host"), F.col("path").alias("__tw_path"), "b.rule", "b.verdict")
    # as many verdicts as there may be URLs: joined by shuffle at every size
    joined = seen.join(materialize(verdicts, "verdicts").hint("shuffle_merge"), (F.col("host") == F.col("__tw_host")) & (F.col("path") == F.col("__tw_path")), "left")
    return joined.drop("__tw_host", "__tw_path").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


#: Distinct URLs that a task looks up, on average.
_TASK_URLS = 500_000
#: Fixed by the query's contract: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Buckets of words, and counts added to each.
BUCKETS, PRIOR = 1 << 16, 1
#: Millionths of a nat per word below which a page's text is unlike the trusted ones.
LEAST_RATIO = -750_000
#: Bad pages that a page's URL, a directory and a host must have to be listed, besides being half of all there.
LEAST_BAD = (1, 2, 3)


def visible_text(html: Column) -> Column:
    """Html without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")


def _buckets(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """``keep`` and ``buckets``: a bucket for every word, from its md5, which any SQL engine has."""
    bucket = F.transform("__tw_w", lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int"))
    return with_words(df, "__tw_w", text).select(*keep, bucket.alias("buckets"))


def bad_pages(pages: DataFrame, trusted: DataFrame) -> DataFrame:
    """(url, bad) of every page: whether its visible text is unlike the texts of ``trusted``.

    Word buckets are counted over the trusted texts and over all pages' texts, two multinomials; a page's ratio is the
    mean log ratio of its words, in whole millionths. Null and empty html and pages without words are not bad. Equal
    html is judged once, however many pages have it.
    """
    k1, k2 = (F.xxhash64("html"), F.xxhash64(F.lit("second"), "html"))
    read = materialize(_buckets(pages.withColumn("k1", k1).withColumn("k2", k2), visible_text(F.col("html")), "url", "k1", "k2"), "page_words")
    raw = read.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"))
    good = _buckets(trusted, F.col("text")).select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("good"))
    counts = materialize(raw.join(good, "bucket", "left"), "buckets")  # a row a bucket at most
    total = counts.agg(F.sum("raw").cast("double").alias("raw")).first()
    trust = materialize(good, "trusted").agg(F.sum("good").cast("double").alias("good")).first()
    size = float(PRIOR * BUCKETS)
    ratio = F.log((F.coalesce("good", F.lit(0)) + PRIOR) / ((trust.good or 0.0) + size)) - F.log((F.col("raw") + PRIOR) / ((total.raw or 0.0) + size))
    weights = F.broadcast(counts.select("bucket", F.round(ratio * 1e6).cast("bigint").alias("ratio")))  # BUCKETS rows at most
    met = read.select("k1", "k2", F.explode("buckets").alias("bucket")).join(weights, "bucket").groupBy("k1", "k2").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"))
    # without trusted texts there is nothing to compare with
    unlike = materialize(met.filter((F.col("sum") < LEAST_RATIO * F.col("n")) & F.lit(bool(trust.good))).select("k1", "k2"), "unlike")
    joined = read.select("url", "k1", "k2").join(broadcast_if_small(unlike.withColumn("bad", F.lit(True)), 1_000_000), ["k1", "k2"], "left")
    return joined.select("url", F.coalesce("bad", F.lit(False)).alias("bad"))


def urls_of_bad_pages(judged: DataFrame, least: tuple[int, int, int] = LEAST_BAD) -> DataFrame:
    """(key): canonical URLs, directories and hosts of whose pages (url, bad) at least half are bad, and at least as many
    as ``least`` says for the three."""
    keys = F.transform(listed_under(host_of(F.col("url")), path_of(F.col("url"))), lambda k, i: F.struct(k.alias("key"), F.get(F.array(*map(F.lit, least)), i).alias("least")))
    counted = judged.select(F.explode(keys).alias("k"), F.col("bad").cast("bigint").alias("bad")).groupBy("k.key", "k.least").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    return counted.filter("bad >= least and 2 * bad >= n").select("key").distinct()


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages; listed are pages, directories and hosts that mostly serve texts unlike the documents labelled good and
    not toxic. Null urls have an empty host, which may be listed as any other; null html is never bad; an empty table gives an
    empty result; further columns are ignored."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = docs.join(broadcast_if_small(materialize(labels, "trusted_ids"), 1_000_000), "doc_id", "left_semi")
    listed = urls_of_bad_pages(bad_pages(pages.select("url", "html"), trusted))
    fixed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])
    rules = spark.range(1).select(F.inline(fixed))
    return judge_urls(pages.select("page_id", "url"), rules, listed).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH g AS (SELECT ('0x' || substr(md5(w), 1, 4))::INT AS b, count(*) AS t FROM (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0)) GROUP BY 1),
p AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS shown,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
w AS MATERIALIZED (SELECT i, ('0x' || substr(md5(w), 1, 4))::INT AS b FROM (SELECT i, unnest(regexp_extract_all(shown, '[^\x20\x09-\x0D]+')) AS w FROM (SELECT html AS i, any_value(shown) AS shown FROM p GROUP BY html))),
a AS (SELECT html AS i, count(*) AS copies FROM p GROUP BY html),
f AS (SELECT b, sum(copies) AS r FROM w JOIN a USING (i) GROUP BY b),
v AS (SELECT b, round(1e6 * (ln((coalesce(t, 0) + 1)::DOUBLE / ((SELECT sum(t) FROM g) + 65536)::DOUBLE) - ln((r + 1)::DOUBLE / ((SELECT sum(r) FROM f) + 65536)::DOUBLE)))::BIGINT AS v FROM f LEFT JOIN g USING (b)),
u AS (SELECT i FROM w JOIN v USING (b) GROUP BY i HAVING sum(v) < -750000 * count(*)),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') AS h, html IN (SELECT i FROM u) AS bad FROM p),
k AS (SELECT page_id, host, path, coalesce(bad, false) AS bad, [h || ' ' || regexp_replace(path, '/+$', ''), h || ' ' || regexp_extract(path, '^/?[^/]*', 0) || '?', h || ' ?'] AS keys FROM c),
l AS (SELECT key FROM (SELECT bad, unnest(keys) AS key, unnest([1, 2, 3]) AS least FROM k) GROUP BY key, least HAVING sum(bad::INT) >= least AND 2 * sum(bad::INT) >= count(*)),
r(h, pre, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT host, path, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY host, path)
SELECT page_id, k.host, k.path, rule, coalesce(verdict, CASE WHEN keys[1] IN (FROM l) OR keys[2] IN (FROM l) OR keys[3] IN (FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN m ON k.host = m.host AND k.path = m.path
"""
