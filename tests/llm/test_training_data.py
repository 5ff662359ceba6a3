"""Each training-data operator against a brute-force version, on ordinary and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontamination, gated_lm, language_id, lm_scoring, mixing, near_duplicates, quality_classifier, quality_rules, sharding, token_counts, url_filter
from tracewell.llm.common import crc_id

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 10),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "de", "b", 0),
    (None, "no id here and some more words", None, "a", 5),
    (None, None, None, None, None),
    (4, " \t\n ", "fr", "c", 4),
    (5, "one", "en", "c", 3),
    (6, "Élan Été über straße ÉLAN. *** ### <x> | $5", "fr", None, 9),
    (7, "same line\nsame line\nsame line\n\n\nother", "en", "b", 9),
    (8, _LONG, "en", "c", len(_LONG)),
    (9, "a b c d e a b c d e a b c d e", "en", "b", 29),
    (10, "x" * 30_000, "en", "b", 30_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


# sharding


@pytest.mark.parametrize("n", [0, 1, 2, 5, 17, 1000, 1025])
def test_shards_are_computable_and_even(spark, n):
    got = sharding.shard_rows(spark.range(n).select(F.col("id").alias("doc_id")), 7, 3).collect()
    assert sorted(r.row_number for r in got) == list(range(n))
    assert all((r.shard, r.slot) == sharding.locate(r.row_number, n, 7, 3) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert not by or n < 7 or max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shards_do_not_depend_on_layout_or_columns(spark, odd, none):
    clash = odd.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("bucket", F.lit(2))
    a = sharding.shard_rows(clash.repartition(5, "source"), 4).collect()
    b = sharding.shard_rows(clash.coalesce(1), 4).collect()
    key = lambda r: (str(r.doc_id), str(r.text)[:50], r.shard, r.slot)
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == len(ODD)
    assert sharding.shard_rows(none, 4).count() == 0


def test_shard_query(spark, sf, tmp_path):
    spark.createDataFrame(ODD, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for d in (sf, str(tmp_path)):
        docs = spark.read.parquet(f"{d}/documents.parquet").collect()
        rows = sharding.op1_sharding(spark, d).collect()
        part = lambda x: "-" if x is None else hashlib.md5(str(x).encode()).hexdigest()
        order = sorted(docs, key=lambda r: hashlib.md5((part(r.doc_id) + part(r.text)).encode()).hexdigest())
        want = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()), "rows", *sharding.locate(i, len(docs), 40), None) for i, r in enumerate(order)]
        assert [(*r,)[:7] for r in sorted(rows, key=lambda r: r.row_number)] == want


# quality classifier


def test_trees_match_a_walk_one_by_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    m = quality_classifier.fit_trees(x, y, trees=30)

    def walk(row):
        total = m.base
        for at in m.roots:
            while not m.leaf[at]:
                at = m.left[at] + (row[m.feature[at]] > m.threshold[at])
            total += m.value[at]
        return 1 / (1 + math.exp(-total))

    got = m.score(x)
    assert np.allclose(got, [walk(r) for r in x])
    assert ((got > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("text", [None, "", " ", "One two.\nTwo two!\n\n#3 | x, y?", "Été ÉTÉ été", _LONG[:3000]])
def test_text_statistics_match_brute_force(text):
    got = dict(zip(quality_classifier.FEATURES, quality_classifier.statistics(None if text is None else text.encode()), strict=True))
    b = (text or "").encode()
    ws, lines, n = re.findall(rb"[^\x20\x09-\x0D]+", b), b.split(b"\n"), len(b)
    if not n:
        assert not any(got.values())
        return
    k = max(1, len(ws))
    share = lambda f: sum(map(f, b)) / n
    want = {
        "log_chars": math.log1p(n), "log_words": math.log1p(len(ws)), "word_length": sum(map(len, ws)) / k, "distinct_words": len(set(ws)) / k,
        "repeats_last": sum(x == y for x, y in zip(ws, ws[1:], strict=False)) / k, "commonest_word": max(collections.Counter(ws).values(), default=0) / k,
        "upper": share(lambda c: 65 <= c <= 90), "digit": share(lambda c: 48 <= c <= 57), "space": share(lambda c: c in b" \t\n\v\f\r"), "non_ascii": share(lambda c: c > 127),
        "symbol": share(lambda c: c in b"#*$%&<>@^~_=+\\{}[]"), "exclaim": b.count(b"!") / n, "bar": b.count(b"|") / n, "stop": b.count(b".") / n, "comma": b.count(b",") / n, "line_end": b.count(b"\n") / n,
        "log_lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / len(lines), "ends_marked": sum(x[-1:] in (b".", b"!", b"?", b":") for x in lines) / len(lines),
        "entropy": -sum(c / n * math.log2(c / n) for c in collections.Counter(b).values()), "last_letter": sum(w[-1] >= 97 or 65 <= w[-1] <= 90 for w in ws) / k,
    }
    assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], abs_tol=1e-9) for f in want)


def test_quality_on_held_out_and_odd(spark, sf, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in known if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out for d in held)
    assert np.mean([got[d].predicted == known[d] for d in held]) > 0.9
    model = quality_classifier.learn_quality(odd.withColumn("score", F.lit("x")), spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (9, None)], "doc_id long, quality int"))
    rows = quality_classifier.score_quality(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    empty = quality_classifier.learn_quality(none, labels.limit(0))
    assert {r.score for r in quality_classifier.score_quality(odd, empty).collect()} == {0.5}
    assert quality_classifier.score_quality(none, empty).count() == 0


# mixing


def _targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free} | {s: 3 * sizes[s] for s in capped}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize(("table", "rows"), [("odd", 50_000), ("real", 50_000), ("real", 3)])
def test_mix_meets_targets(request, table, rows):
    docs = request.getfixturevalue(table)
    mixed = mixing.mix_sources(docs.withColumn("size", F.lit("x")), sorted_rows=rows).collect()
    assert len(mixed) == docs.count() and {r["size"] for r in mixed} == {"x"}
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in mixed:
        assert r["__tw_size"] == len(words(r.text)) and 0 <= r["__tw_times"] <= 3
        sizes[r.source] += r["__tw_size"]
        taken[r.source] += r["__tw_size"] * r["__tw_times"]
        largest[r.source] = max(largest[r.source], r["__tw_size"])
    want = _targets(sizes)
    for r in mixed:
        assert r["__tw_source_size"] == sizes[r.source] and math.isclose(r["__tw_target"], want[r.source], abs_tol=1e-6)
        assert abs(taken[r.source] - r["__tw_target"]) <= largest[r.source] / 2 + 1e-6


@pytest.mark.parametrize("rows", [50_000, 7])
def test_equal_rows_are_taken_in_part(spark, rows):
    """One row repeated many times, over many tasks: as many are taken as the budget has room for."""
    same = spark.range(0, 300, 1, 7).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("w " * 10).alias("text"), F.when(F.col("id") < 100, "a").when(F.col("id") < 200, "c").alias("source"))
    others = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("v" * 3), "id", F.lit(" v" * 9)).alias("text"), F.lit("b").alias("source"))
    mixed = mixing.mix_sources(same.union(others), sorted_rows=rows).collect()
    taken, targets, times = collections.Counter(), {}, collections.defaultdict(set)
    for r in mixed:
        taken[r.source] += r["__tw_size"] * r["__tw_times"]
        targets[r.source] = r["__tw_target"]
        times[r.source].add(r["__tw_times"])
    assert all(abs(taken[s] - targets[s]) <= 5 + 1e-6 for s in targets) and len(targets) == 4
    assert len(times["a"]) == 2 and max(times["a"]) - min(times["a"]) == 1


def test_mix_follows_keys(real):
    """By hand: keys in order, whole epochs first, the last document where it brings the sum nearer."""
    mixed = mixing.mix_sources(real).collect()
    by = collections.defaultdict(list)
    for r in mixed:
        ws, text = words(r.text), r.text or ""
        plain = len(re.sub(r"[\x21-\x40\x5B-\x60\x7B-\x7E]", "", text)) / len(text) if text else 0
        q = max(0.02, plain**6 * min(1, 1.25 * len(set(ws)) / len(ws)) ** 2) if ws else 0.02
        assert math.isclose(r["__tw_quality"], q, rel_tol=1e-9)
        digest = hashlib.md5("|".join(["0", *([] if r.doc_id is None else [str(r.doc_id)]), hashlib.md5(text.encode()).hexdigest()]).encode()).hexdigest()
        by[r.source].append((-math.log((int(digest[:13], 16) + 0.5) / 2**52) / q, digest, r))
    for rows in by.values():
        first = rows[0][2]
        epochs = int(first["__tw_target"] // max(1, first["__tw_source_size"]))
        budget, upto = first["__tw_target"] - epochs * first["__tw_source_size"], 0
        for _, _, r in sorted(rows, key=lambda x: x[:2]):
            upto += r["__tw_size"]
            assert r["__tw_times"] == epochs + (2 * upto - r["__tw_size"] <= 2 * budget)


def test_mix_repeats_and_agrees(spark, odd, none):
    a, b = (sorted((str(r.doc_id), str(r.text)[:40], r["__tw_times"]) for r in mixing.mix_sources(d).collect()) for d in (odd, odd.repartition(6)))
    assert a == b
    kept = mixing.take_mix(mixing.mix_sources(odd))
    assert kept.columns == odd.columns and kept.count() == sum(t for *_, t in a)
    assert mixing.mix_sources(none).count() == 0 and mixing.take_mix(mixing.mix_sources(none)).count() == 0


# decontamination

_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _ascii_words(text):
    return re.findall(_W, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute_hits(docs, items):
    out = []
    for text in docs:
        ws, hit, found = _ascii_words(text), set(), set()
        for item, t in items:
            iw = _ascii_words(t)
            m = min(10, len(iw))
            grams = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
            for i in range(len(ws) - m + 1) if m else ():
                if tuple(ws[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    found.add(str(item))
        out.append((text, len(hit), sorted(found)))
    return sorted(out, key=str)


def test_contamination_matches_brute_force(spark, odd, none, sf):
    items = [(3, "eta THETA, iota"), (20, "Alpha beta gamma delta epsilon zeta eta theta iota kappa nothing"), (4, None), (5, ""), (100, "one"), (7, "b c d e a b c d e a"), (7, "b c d e a b c d e a"), (8, "élan été"), (9, "word5 word6 word7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [d[1] for d in ODD]
    got = decontamination.mark_contamination(odd.withColumn("hit_spans", F.lit(1)).withColumn("w", F.lit(2)), bench).select("text", decontamination.covered(F.col("hit_spans")), "hit_items").collect()
    assert sorted(((a, b, c) for a, b, c in got), key=str) == _brute_hits(texts, items)
    by_filter = decontamination.mark_contamination(odd, bench, max_broadcast_windows=3).select("text", decontamination.covered(F.col("hit_spans")), "hit_items").collect()
    assert sorted(((a, b, c) for a, b, c in by_filter), key=str) == _brute_hits(texts, items)
    clean = decontamination.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == sum(n == 0 for _, n, _ in _brute_hits(texts, items))
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(odd, bench).filter("doc_id in (1, 3, 5, 7)").collect()}
    assert cut[1].split() == ["lambda"] and cut[5] == "" and cut[7] == ODD[9][1]
    assert decontamination.mark_contamination(none, bench).count() == 0
    assert decontamination.mark_contamination(odd, bench.limit(0)).filter("size(hit_spans) > 0").count() == 0


def test_contamination_query_digest(spark, sf):
    rows = decontamination.op4_decontamination(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in rows[:60]:
        ((_, n, found),) = _brute_hits([texts[r.doc_id]], items)
        assert (r.n_hit, r.n_items, r.items_sha256) == (n, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
        assert r.n_words == len(_ascii_words(texts[r.doc_id])) and r.contaminated == (n > 0)


# quality rules


def _statistics(text):
    ws, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    rep = {j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(rep), n < 10 or 100 * len(rep) > 20 * n


@pytest.mark.parametrize("table", ["odd", "real"])
def test_statistics_match_brute_force(request, table):
    docs = request.getfixturevalue(table)
    for r in quality_rules.with_statistics(docs.withColumn("n_words", F.lit("x"))).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _statistics(r.text), r.doc_id


def test_ratio_matches_brute_force(spark, odd, none):
    import xxhash

    def grams(text):
        ws, half = words(text), quality_rules.BUCKETS // 2
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in ws]
        two = [xxhash.xxh64_intdigest(b.encode(), a) for a, b in zip(one, ws[1:], strict=False)]
        return [signed(h) % half for h in one] + [signed(h) % half + half for h in two]

    trusted = spark.createDataFrame([(1,), (7,), (7,), (None,)], "doc_id long")
    raw, good = collections.Counter(), collections.Counter()
    for d, text, *_ in ODD:
        raw.update(grams(text))
        good.update(grams(text) if d in (1, 7) else [])
    r, t, s = sum(raw.values()), sum(good.values()), quality_rules.BUCKETS * quality_rules.PRIOR
    ratio = lambda b: math.log((good[b] + 1) / (t + s)) - math.log((raw[b] + 1) / (r + s))
    rows = quality_rules.apply_quality_rules(odd.withColumn("ratio", F.lit("x")).withColumn("bucket", F.lit(1)), trusted).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        g = grams(row.text)
        assert math.isclose(row.ratio, sum(map(ratio, g)) / len(g) if g else 0.0, abs_tol=1e-9)
        assert row.kept == (not row.base_failed and row.ratio >= quality_rules.LEAST_RATIO)
    assert {x.ratio for x in quality_rules.apply_quality_rules(odd, trusted.limit(0)).collect()} == {0.0}
    assert quality_rules.apply_quality_rules(none, trusted).count() == 0


# token counts


def test_token_counts_equal_the_library(spark, odd, none):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["", None, " ", "  ", "   a", "a  ", "\n\n a\n", "▁▁ ▁x", "a▁b", "a" * 25, "😀é漢字ひらがな", "<s></s><unk>", "<0x0A>", "\x00a\x01", "x" * 5000, "ab" * 3000]
    texts += ["".join(rng.choice("aehinorst 0123 -_=ßü€\n▁") for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    assert token_counts.count_tokens(texts, path) == [len(model.encode(t or "")) for t in texts]
    rows = token_counts.with_token_counts(odd.withColumn("n_tokens", F.lit("x")), path).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == len(model.encode(r.text or "")) for r in rows)
    assert token_counts.with_token_counts(none, path).count() == 0


# url filter


def _judge(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if listed & set(_keys(host, path)) else "allow"


def _keys(host, path):
    """Page, directory, host."""
    bare = re.sub(r"^(www|m)\.", "", host)
    return bare + " " + re.sub(r"/+$", "", path), bare + " " + re.match(r"/?[^/]*", path)[0] + "?", bare + " ?"


def test_urls_match_brute_force(spark, sf):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y", "http://www.example.com/en/", "https://com/", "http://x.net/es/1#f", "http://x.net/fr", "http://netx/fr/", "x://y://z.net/fr/", "http://www.spam.org/a/", "http://spam.org/a", "http://spam.org/b", "http://a.b.c.d.e.com/", "http://example.com?q=/en/", "ftp://exAmple.com/en/é"] * 2
    rules = [*url_filter.RULES, ("d.e.com", "", "block")]
    listed = {"spam.org /a", "x y", "dirs.org /x?", "all.org ?", "dirs.org /"}
    urls += ["http://m.dirs.org/x/1", "http://dirs.org/x", "http://dirs.org/xy/1", "http://dirs.org/x//", "http://all.org", "http://www.all.org/q/r?s", "http://sub.all.org/"]
    urls += ["http://" + "a." * 20_000 + "net/fr/" + "x" * 60_000, "http://spam.org/" + "b/" * 30_000, "http://d.e.com/" + "y" * 50_000]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, key int")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(k,) for k in sorted(listed)], "key string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == _judge(r.url, rules, listed), r.url
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([], "key string")).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = url_filter.filter_blocks(3000)
    bloom = url_filter.bloom_filter(keys, blocks)
    assert url_filter.may_be_listed(keys, bloom, "key", blocks).count() == 3000
    others = spark.range(20000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert url_filter.may_be_listed(others, bloom, "key", blocks).count() < 200
    assert url_filter.filter_blocks(0) >= 1 and url_filter.filter_blocks(10_000_000) * 256 == 160_000_000


def _pages_list(rows, trusted):
    """By hand: (bad, listed) from rows (page_id, url, html), ids told by place."""
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
    shown = [[bucket(w) for w in words(re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ", r[2] or "")))] for r in rows]
    raw, good = collections.Counter(b for s in shown for b in s), collections.Counter(bucket(w) for t in trusted for w in words(t))
    ratio = {b: round(1e6 * (math.log((good[b] + 1) / (sum(good.values()) + 65536)) - math.log((raw[b] + 1) / (sum(raw.values()) + 65536)))) for b in raw}
    bad = [bool(s) and bool(good) and sum(ratio[b] for b in s) < -750_000 * len(s) for s in shown]
    seen = collections.defaultdict(list)
    for (_, url, _), b in zip(rows, bad, strict=True):
        host, path, *_ = _judge(url, [], set())
        for key, least in zip(_keys(host, path), (1, 2, 3), strict=True):
            seen[key, least].append(b)
    return bad, {key for (key, least), v in seen.items() if sum(v) >= least and 2 * sum(v) >= len(v)}


def test_lists_alone_change_verdicts(spark, sf, tmp_path):
    """Good pages are blocked by what their URL, their directory or their host mostly serves."""
    fine, junk = "<p>Plain words of a fine page.</p>", "<script>Plain words</script><b>" + "buy! *** $$$ " * 30 + "</b>"
    rows = [
        (1, "http://www.shop.org/a/", junk), (2, "https://shop.org/a?x=1", fine), (3, "https://shop.org/b", fine), (4, "http://m.shop.org/c", None), (5, None, fine), (6, "http://shop.net/fr/", junk), (7, "http://shop.com/z", junk),
        (10, "http://d.org/en/1", junk), (11, "http://d.org/en/2", junk), (12, "http://m.d.org/en/3", fine), (13, "http://d.org/en/4?q", fine), (14, "http://d.org/de/1", fine), (15, "http://d.org/de/2", fine),
        (20, "http://h.org/1", junk), (21, "http://h.org/2/x", junk), (22, "http://www.h.org/3", junk), (23, "http://h.org/4", fine), (23, "http://h.org/4", fine), (24, "http://h.org/", fine),
    ]
    docs = [(1, "Plain words of a fine page. " * 5), (2, "buy! *** $$$"), (3, None), (None, "x")]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bad, listed = _pages_list(rows, [docs[0][1]])
    assert bad == [r[2] == junk for r in rows]
    got = {r.page_id: r.verdict for r in url_filter.op7_url_filter(spark, str(tmp_path)).collect()}
    assert got == {r[0]: _judge(r[1], url_filter.RULES, listed)[3] for r in rows}
    blocked = {i for i in got if got[i] == "block"}
    assert {2, 12, 13, 23, 24} <= blocked and not {3, 4, 5, 7, 14, 15} & blocked
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("url", "html")
    assert not any(r.bad for r in url_filter.bad_pages(pages, spark.createDataFrame([], "text string")).collect())


# language


def test_languages(spark, odd, none):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = language_id.op8_language_id(spark, d).collect()
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    model = language_id.learn_languages(spark.read.parquet(f"{d}/documents.parquet"))
    rows = language_id.identify_languages(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    assert {r.lang_pred for r in language_id.identify_languages(odd, language_id.learn_languages(none)).collect()} == {"und"}


def test_kernel_matches_brute_force():
    """Presence kernel by sets, the Nystroem map and the ridge solution by dense algebra."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(20, 90))) for a in ("abcd ef", "efgh ij", "klm abn") for _ in range(25)]
    langs = [x for x in ("x", "y", "z") for _ in range(25)]
    grams = [language_id.ngrams(t) for t in texts]
    for t, g in zip(texts, grams, strict=True):  # as many buckets as distinct n-grams, but for rare collisions
        padded = " " + re.sub(" +", " ", t).strip() + " " if t.strip() else t
        assert len({padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)}) - len(g) <= 3
    model = language_id.fit_kernel(grams, langs, 12)
    size = lambda i: len(grams[i])
    turns = [sorted((i for i, y in enumerate(langs) if y == x), key=lambda i: (-min(size(i), 400), i)) for x in ("x", "y", "z")]
    marks = [t[k] for k in range(4) for t in turns]
    kernel = lambda i, j: len(set(grams[i]) & set(grams[j])) / math.sqrt(size(i) * size(j))
    k = np.array([[kernel(i, j) for j in marks] for i in range(len(texts))])
    assert np.allclose(model.kernel(grams), k, atol=1e-5)
    # ridge in the map's feature space, every language weighing the same
    values, vectors = np.linalg.eigh(k[marks])
    keep = values > 1e-6 * values.max()
    x = k @ (vectors[:, keep] / np.sqrt(values[keep]))
    y = np.where(np.array(langs)[:, None] == np.array(["x", "y", "z"])[None], 1.0, -1.0)
    xc, yc, s = x - x.mean(0), y - y.mean(0), 1 / 25
    w = np.linalg.solve(s * xc.T @ xc + 1e-3 * np.eye(x.shape[1]), s * xc.T @ yc)
    want = xc @ w + y.mean(0)
    got = model.kernel(grams) @ model.weights + model.bias
    assert np.allclose(got, want, atol=1e-3)
    assert model.predict(texts)[0] == [("x", "y", "z")[i] for i in want.argmax(1)]


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + 7 * lang)}{chr(0x4E00 + 7 * lang + 1)} " * 9, f"l{lang:03}") for i, lang in enumerate(x for x in range(300) for _ in range(3))]
    model = language_id.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=450)
    assert len(model.languages) == 300


# language model


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in gated_lm.new_model(np.ones(130)).items()}
    texts = [np.r_[rng.integers(2, 130, rng.integers(0, 9)), 0] for _ in range(7)]
    n = sum(map(len, texts))
    adam = {"step": 0, "m": {k: np.zeros_like(v) for k, v in p.items()}, "v": {k: np.zeros_like(v) for k, v in p.items()}}
    gated_lm.train({k: v.copy() for k, v in p.items()}, texts, adam, 0.0, 3, 50)
    for k, at in (("embed", (texts[0][0], 3)), ("bx", (5,)), ("ug", (3, 7)), ("uc", (2, 9)), ("wc", (4, 1)), ("ww", (0, 3, 5)), ("wx", (2, 40))):
        ends = []
        for step in (1e-4, -1e-4):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += step
            ends.append(-gated_lm.score(q, texts, 3, 50).sum() * math.log(10) / n)
        assert math.isclose((ends[0] - ends[1]) / 2e-4, adam["m"][k][at] * 10, rel_tol=0.05, abs_tol=1e-6), k


def test_state_is_carried_and_lanes_do_not_matter():
    assert gated_lm.score(gated_lm.new_model(np.ones(9)), []).tolist() == []
    p = gated_lm.new_model(1 / np.arange(1, 131), 3)
    rng = np.random.default_rng(2)
    texts = [np.r_[rng.integers(2, 130, n), 0] for n in (0, 1, 5, 200, 33, 64, 7)]
    alone = np.array([gated_lm.score(p, [t], 1, 1000)[0] for t in texts])
    assert np.allclose(gated_lm.score(p, texts, 3, 8), alone, rtol=1e-4) and np.allclose(gated_lm.score(p, texts, 99, 32), alone, rtol=1e-4)
    wide = np.array([[0.0, 1.0, -500.0], [-900.0, -901.0, -950.0], [5.0, 5.0, 5.0]])
    logp, every = gated_lm._softmax_terms(wide.copy(), np.array([1, 0, 2]))
    assert np.allclose(every.sum(1), 1) and np.allclose(logp, [r[k] - r.max() - np.log(np.exp(r - r.max()).sum()) for r, k in zip(wide, (1, 0, 2), strict=True)])


def test_words_are_counted_before_the_shuffle(spark, monkeypatch):
    """Against Python, in pieces of a few words; tasks hand on counts, not a row a word."""
    monkeypatch.setattr(lm_scoring, "_COUNT_WORDS", 5)
    texts = [None, "", "  ", "A a\tB\x0bb\x0c\r\n É é", "\u00a0 x\u2003y a", *["w%d a" % (i % 4) for i in range(40)]]
    counted = lm_scoring.count_words(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    want = collections.Counter(w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t)))
    assert {r.word: r.c for r in counted.collect()} == dict(want)


@pytest.mark.parametrize("head", [3, 1 << 17])
def test_base_scores_match_brute_force(spark, odd, none, head):
    held = crc_id() % 7 == 2
    vocabulary, counts = lm_scoring.learn_vocabulary(odd.filter(~held), head)
    encoded = lm_scoring.encode_documents(odd.withColumn("base", F.lit("x")).withColumn("place", F.lit("y")), vocabulary, ~held)
    model = lm_scoring.train_model(encoded, vocabulary)
    got = lm_scoring.score_documents(encoded, vocabulary, counts, model).collect()
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = collections.Counter(w for d, t, *_ in ODD if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for w in split(t))
    n, v = sum(c.values()), len(c)
    assert (vocabulary.n, vocabulary.v) == (n, v)
    want = sorted((str(d), len(split(t)), sum(w in c for w in split(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 5)) for d, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    nothing, counts = lm_scoring.learn_vocabulary(none)
    encoded = lm_scoring.encode_documents(odd, nothing, F.lit(False))
    assert lm_scoring.score_documents(encoded, nothing, counts, lm_scoring.train_model(encoded, nothing)).count() == len(ODD)
    encoded = lm_scoring.encode_documents(none, nothing)
    assert lm_scoring.score_documents(encoded, nothing, counts, lm_scoring.train_model(encoded, nothing)).count() == 0


def test_probabilities_of_all_words_sum_to_one(spark):
    """Over every next token: each known word, the end, and the mass of the words never seen."""
    texts = [" ".join(f"w{int(4000 * random.Random(i * 1000 + j).random() ** 3)}" for j in range(300)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary, counts = lm_scoring.learn_vocabulary(docs, 3000)
    encoded = lm_scoring.encode_documents(docs, vocabulary)
    model = lm_scoring.train_model(encoded, vocabulary)
    known = [r.word for r in counts.collect()]
    assert len(known) > lm_scoring.MODEL_WORDS > 2000 and not all(r["head"] for r in counts.collect())
    start = "w1 w2 w3"
    probes = spark.createDataFrame([(i, f"{start} {w}") for i, w in enumerate([*known, "neverseen"])] + [(-1, start), (-2, start + " w1 w1")], "doc_id long, text string")
    scored = {r.doc_id: r for r in lm_scoring.score_documents(lm_scoring.encode_documents(probes, vocabulary), vocabulary, counts, model).collect()}
    assert all(math.isfinite(r.score) for r in scored.values())
    # by hand: the model's probability of each id after the start, shared out for words without one
    place = {w: i for i, w in enumerate(vocabulary.words)}
    ids = lambda text: np.array([place[w] + 2 if place.get(w, lm_scoring.MODEL_WORDS) < lm_scoring.MODEL_WORDS else 1 for w in text.split()])
    prefix = gated_lm.score(model, [ids(start)])[0]  # no end: the start alone
    after = np.array([10 ** (gated_lm.score(model, [np.r_[ids(start), y]])[0] - prefix) for y in range(lm_scoring.MODEL_WORDS + 2)])
    assert math.isclose(after.sum(), 1, rel_tol=1e-4)
    c = {r.word: r.c for r in counts.collect()}
    total = vocabulary.n + vocabulary.v + 1.0
    others = [w for w in known if place.get(w, lm_scoring.MODEL_WORDS) >= lm_scoring.MODEL_WORDS]
    shares = sum((c[w] + 1) / total for w in others) + 1 / total  # of each other word, and of all that were never seen
    assert math.isclose(shares, vocabulary.other_share(), rel_tol=1e-9)
    for i, w in list(enumerate(known))[::97]:
        extra = math.log10((c[w] + 1) / total / vocabulary.other_share()) if w in others else 0.0
        want = gated_lm.score(model, [np.r_[ids(f"{start} {w}"), gated_lm.END]])[0] + extra
        assert math.isclose(scored[i].score, want, rel_tol=1e-4)


def test_model_beats_counts(spark):
    rows = [r for r in lm_scoring.op9_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("texts", [60, 2100])
def test_every_training_token_reaches_the_model(spark, monkeypatch, texts):
    docs = spark.range(texts).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(999)), lambda x: F.concat(F.lit("w"), (x * (F.col("id") + 1)) % 301))).alias("text"))
    seen, averaged = [], lm_scoring._averaged
    monkeypatch.setattr(lm_scoring, "_averaged", lambda parts: seen.append(parts.filter("k = 0").agg(F.sum("weight")).first()[0]) or averaged(parts))
    vocabulary, _ = lm_scoring.learn_vocabulary(docs)
    lm_scoring.train_model(lm_scoring.encode_documents(docs, vocabulary), vocabulary)
    assert vocabulary.n == texts * 1000 == sum(seen) and min(seen) > vocabulary.n / 6


# near duplicates


def _fingerprint(text):
    import xxhash

    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def _components(rows):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    ids = collections.defaultdict(list)
    for d, f in rows:
        ids[find(f)].append(d)
    return {f: min((d for d in ids[find(f)] if d is not None), default=None) for f in fps}


@pytest.mark.parametrize("table", ["odd", "real"])
def test_classes_match_brute_force(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, _fingerprint(r.text)) for r in docs.collect()]
    want = _components(rows)
    got = near_duplicates.near_duplicate_classes(docs.withColumn("fp", F.lit("x"))).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == sorted(((d, f, want[f]) for d, f in rows), key=str)
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({want[f] if want[f] is not None else ("none", f) for _, f in rows})


@pytest.mark.parametrize("n", [10, 1 << 23, 1 << 27, 1 << 40])
def test_every_ring_finds_all_links(spark, n):
    rng = random.Random(n)
    fps = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 10)):
            y = x
            for k in rng.sample(range(64), rng.randrange(6)):
                y ^= 1 << k
            fps.add(y)
    signed = {(f - (1 << 64) if f >> 63 else f): f for f in fps}
    links = near_duplicates.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"), n)
    root = {r.node: r.root for r in near_duplicates.connected_components(links).collect()}
    want = _components([(s, f) for s, f in signed.items()])
    a, b = collections.defaultdict(set), collections.defaultdict(set)
    for s, f in signed.items():
        a[want[f]].add(s)
        b[root.get(s, s)].add(s)
    assert sorted(map(sorted, a.values())) == sorted(map(sorted, b.values()))


@pytest.mark.parametrize("run", [1, 7, 40, 1 << 15])
def test_runs_cut_into_blocks_lose_no_link(spark, run):
    rng = random.Random(9)
    x = rng.getrandbits(64)
    fps = {x}
    while len(fps) < 260:  # one crowd of near fingerprints, and some others
        y = rng.choice(sorted(fps))
        for k in rng.sample(range(64), rng.randrange(1, 4)):
            y ^= 1 << k
        fps.add(y)
    fps |= {rng.getrandbits(64) for _ in range(40)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    written = near_duplicates.materialize(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), "fps")
    root = {r.node: r.root for r in near_duplicates.connected_components(near_duplicates.link_fingerprints(written, len(fps), run)).collect()}
    want = _components([(s, f) for f, s in signed.items()])
    a, b = collections.defaultdict(set), collections.defaultdict(set)
    for f, s in signed.items():
        a[want[f]].add(s)
        b[root.get(s, s)].add(s)
    assert sorted(map(sorted, a.values())) == sorted(map(sorted, b.values())) and max(map(len, a.values())) >= 260


def test_no_part_of_a_crowd_is_large(spark):
    """A crowd within three bits of one fingerprint: exact rows and variants alike are cut."""
    x, run = random.Random(3).getrandbits(63), 500
    near = [x ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(30) for j in range(i) for k in range(j)] + [x ^ (1 << i) for i in range(63)] + [x]
    written = near_duplicates.materialize(spark.createDataFrame([(f,) for f in near], "fp long"), "fps")
    parts = near_duplicates.keys_in_parts(written, len(near), run).groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("role") == near_duplicates.MEETS).cast("int")).alias("m")).cache()
    assert parts.agg(F.max("n")).first()[0] <= 2 * run
    whole = near_duplicates.keys_in_parts(written, len(near), 1 << 15).groupBy("key").count()
    assert whole.agg(F.max("count")).first()[0] > 2 * run


def test_no_documents(none):
    assert near_duplicates.near_duplicate_classes(none).count() == 0 and near_duplicates.drop_near_duplicates(none).count() == 0


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "u long, v long")
    rows = near_duplicates.connected_components(links).collect()
    assert {r.root for r in rows} == {0} and len(rows) == 299
