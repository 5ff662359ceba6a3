"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio of trusted documents to the raw corpus.

Word uni- and bigrams are hashed into a fixed number of buckets. Bucket counts over the trusted documents and over the
whole corpus are two multinomials; a document's ratio is the mean of its n-grams' log ratios, so long and short texts
compare, and every document is held against one fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import text_key, with_window_hashes, with_words
from tracewell.session import broadcast_if_small, materialize

#: Half of the buckets for single words, half for pairs; the table of their log ratios is broadcast (2 MB).
BUCKETS = 1 << 17
#: Counts added to each bucket: those of a uniform prior.
PRIOR = 1.0
#: Nats per n-gram below which a document is unlike the trusted ones.
LEAST_RATIO = -0.6
WINDOW = 5


def _with_repeats(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """Adds the number of words inside 5-word windows that occur twice or more, the first occurrence included.

    ``hashes`` holds a hash a window. Where one occurs again (few texts), hashes are sorted with their places in their
    lowest bits, so equal ones are neighbours and longs suffice; if two different ones share their upper bits, which
    shows in the order too, that text is sorted by whole hashes.
    """
    h, n = F.col(hashes), F.size(hashes)
    shift, place, top = F.col("__tw_bits"), lambda x: x.bitwiseAND(F.col("__tw_mask")), lambda x: F.call_function("shiftright", x, F.col("__tw_bits"))
    df = df.withColumn("__tw_bits", F.when(F.size(F.array_distinct(h)) < n, F.length(F.bin(n))))
    df = df.withColumn("__tw_mask", F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1)
    packed = F.transform(h, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("__tw_sorted", F.when(shift.isNotNull(), F.array_sort(packed)))
    ordered = F.col("__tw_sorted")
    both = F.zip_with(F.slice(ordered, F.lit(1), n - 1), F.slice(ordered, F.lit(2), n - 1), lambda a, b: F.when(top(a) == top(b), F.shiftleft(place(a), 31).bitwiseOR(place(b))))
    df = df.withColumn("__tw_pairs", F.when(shift.isNotNull(), F.array_compact(both)))
    first, second = lambda p: F.shiftright(p, 31).cast("int"), lambda p: p.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    clash = F.exists("__tw_pairs", lambda p: F.get(h, first(p)) != F.get(h, second(p)))
    near = F.array_sort(F.array_distinct(F.concat(F.transform("__tw_pairs", first), F.transform("__tw_pairs", second))))
    df = df.withColumn("__tw_places", F.when(shift.isNotNull(), F.when(clash, _repeated_places(h)).otherwise(near)))
    gaps = F.zip_with("__tw_places", F.slice("__tw_places", F.lit(2), F.greatest(F.size("__tw_places") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)
    return df.withColumn(name, F.coalesce(F.when(shift.isNotNull(), total), F.lit(0).cast("bigint"))).drop("__tw_bits", "__tw_mask", "__tw_sorted", "__tw_pairs", "__tw_places")


def _repeated_places(hashes: Column) -> Column:
    """Sorted places of the hashes that occur again, by whole hashes."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(ranked, F.lit(1), F.size(ranked) - 1))
    after = F.slice(ranked, F.lit(2), F.size(ranked) - 1)
    trio = F.arrays_zip(ranked.alias("a"), before.alias("b"), after.alias("c")).cast("array<struct<a:struct<h:bigint,i:int>,b:struct<h:bigint,i:int>,c:struct<h:bigint,i:int>>>")
    same = F.filter(trio, lambda t: F.coalesce(t["a"]["h"] == t["b"]["h"], F.lit(False)) | F.coalesce(t["a"]["h"] == t["c"]["h"], F.lit(False)))
    return F.array_sort(F.transform(same, lambda t: t["a"]["i"]))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null and empty texts have none of these and fail. Existing columns of the added names are replaced; repeated rows are
    judged alike; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = with_words(docs.drop(*STATISTICS, "base_failed"), "__tw_w")
    hashed = _with_repeats(with_window_hashes(split, "__tw_w", [WINDOW]), f"__tw_h{WINDOW}", "n_repeat_words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")
    counted = hashed.withColumn("__tw_l", F.when(F.contains(text, F.lit("\n")), lines).otherwise(F.array(F.lit(""))))
    counted = counted.withColumns(
        {
            "n_words": F.size("__tw_w").cast("bigint"),
            "word_chars": F.char_length(F.array_join("__tw_w", "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": (F.size("__tw_l") - F.size(F.array_distinct("__tw_l"))).cast("bigint"),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("__tw_w", "__tw_l", f"__tw_h{WINDOW}")


def _grams(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row an n-gram of ``text``: its bucket, with the columns ``keep``."""
    words = F.col("__tw_w")
    ahead = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    zipped = F.arrays_zip(words.alias("w0"), ahead.alias("w1")).cast("array<struct<w0:string,w1:string>>")
    # outer: the inner form would have Catalyst split each text a second time to skip empty ones
    rows = with_words(docs, "__tw_w").select(*keep, F.explode_outer(zipped).alias("z")).filter("z is not null")
    half = BUCKETS // 2
    one = F.pmod(F.xxhash64("z.w0"), F.lit(half)).cast("int")
    two = F.when(F.col("z.w1").isNotNull(), (F.pmod(F.xxhash64("z.w0", "z.w1"), F.lit(half)) + half).cast("int"))
    return rows.select(*keep, F.explode(F.array(one, two)).alias("bucket")).filter("bucket is not null")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, ratio) of every bucket with an n-gram in the corpus; ``trusted`` has the doc_ids of trusted rows.

    Without trusted documents all ratios are 0; null ids are never trusted.
    """
    ids = materialize(trusted.select(F.col("doc_id").alias("__tw_id")).filter("__tw_id is not null").distinct(), "trusted")
    marked = docs.select("doc_id", "text").join(broadcast_if_small(ids, 1_000_000), F.col("doc_id") == F.col("__tw_id"), "left")
    marked = marked.select("text", F.col("__tw_id").isNotNull().cast("bigint").alias("target"))
    counts = materialize(_grams(marked, ["target"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target")), "buckets")
    total = counts.agg(F.sum("raw").cast("double").alias("r"), F.sum("target").cast("double").alias("t")).first()
    size = PRIOR * BUCKETS
    ratio = F.log((F.col("target") + PRIOR) / ((total.t or 0.0) + size)) - F.log((F.col("raw") + PRIOR) / ((total.r or 0.0) + size))
    # without trusted documents there is nothing to compare with
    return counts.select("bucket", (ratio if total.t else F.lit(0.0)).alias("ratio"))


def apply_quality_rules(docs: DataFrame, trusted: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Adds the statistics, base_failed, ratio (mean log ratio of the text's n-grams; 0 without any), and kept.

    Null texts count as empty and fail the base rules; texts of any length count whole. Existing columns of the added names are replaced. An empty table
    gives an empty result. Ratios are kept by text, so equal texts are judged alike however many they are.
    """
    weights = F.broadcast(log_ratios(docs, trusted))  # BUCKETS rows at most
    keys = dict(zip(("__tw_k1", "__tw_k2"), text_key(), strict=True))
    grams = _grams(docs.select("text", *[c.alias(n) for n, c in keys.items()]), list(keys))
    ratios = materialize(grams.join(weights, "bucket").groupBy(*keys).agg(F.avg("ratio").alias("ratio")), "ratios")
    judged = with_statistics(docs.drop("ratio", "kept")).withColumns(keys).join(broadcast_if_small(ratios, 20_000), list(keys), "left")
    ratio = F.coalesce("ratio", F.lit(0.0))
    return judged.withColumn("ratio", ratio).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least_ratio)).drop(*keys)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled good and not toxic. Null, empty, long and repeated texts: as in
    ``apply_quality_rules``; an empty table gives an empty result; further columns are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = apply_quality_rules(docs, labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
