"""The prefix trie, the WARC archive and periodic runs against brute-force versions, on ordinary and on odd tables."""

import base64
import collections
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.llm import periodic_runs, prefix_trie, warc

# prefix trie


def _trie(rows):
    """By hand: (conv_id, depth) to the node's other figures."""
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = f"{len(role or '')}:{role or ''}{text or ''}"
            said[c].append(((turn is not None, turn or 0, hashlib.md5(key.encode()).digest()), role or "", text or ""))
    said = {c: [x[1:] for x in sorted(v)] for c, v in said.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(said.get(c - c % 100, [])[:h] + said[c][h:])
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = {}
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[min(of), len(path)] = (parent, len(of), sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def _talks(seed, convs, longest, ids):
    rnd = random.Random(seed)
    rows = []
    for c in ids(convs):
        for turn in range(rnd.randint(1, longest)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["", "a", "bb", "é¿"])))
    return rows


_ODD_TALKS = [
    (None, 0, "user", "nobody's"), (0, None, "user", "first"), (0, 3, None, None), (0, 3, "user", "tie"), (0, 3, "user", "tie"), (7, 1, "user", None),
    (7, 0, None, "x" * 70_000), (100, 0, "user", "first"), (250, 0, "user", "no head"), (251, 1, "user", "no head"), (252, 5, "user", "no head"),
]


@pytest.mark.parametrize(
    ("rows", "step", "piece"),
    [
        (_talks(1, 60, 8, lambda n: [i * 7 for i in range(n)]), 4096, 4096),
        (_talks(2, 12, 40, lambda n: range(n)), 2, 2),
        (_talks(3, 150, 3, lambda n: range(n)), 1, 3),
        (_ODD_TALKS, 4096, 4096),
        ([(5, 0, "user", "alone")], 4096, 4096),
    ],
)
def test_trie_matches_brute_force(spark, monkeypatch, rows, step, piece):
    monkeypatch.setattr(prefix_trie, "_STEP", step)
    monkeypatch.setattr(prefix_trie, "_PIECE", piece)
    monkeypatch.setattr(prefix_trie, "_MANY", 3)
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, place int").repartition(3)
    got = prefix_trie.prefix_trie(prefix_trie.continue_heads(prefix_trie.number_turns(table))).collect()
    want = _trie(rows)
    assert len(got) == len(want)
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == want


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.continue_heads(prefix_trie.number_turns(none))).count() == 0


# WARC

PAGES = [
    (5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (9, None, "same"), (1, "http://b/é x\r\nWARC-Type: response", None), (2, "http://b/3", ""), (None, "http://c", "same"),
    (None, "http://d", "only here"), (4, "http://e", "\r\n\r\nWARC/1.1\r\n" * 9), (6, "http://f", "long " * 400_000), (3, "http://a/2", "same"), (7, "http://g", "é¿"),
]


def _captures(pages, least=0):
    first = {}
    for page, _, html in pages:
        key = (html or "").encode()
        if page is not None and len(key) >= least:
            first[key] = min(page, first.get(key, page))
    out = []
    for page, _, html in pages:
        key = (html or "").encode()
        low = first.get(key) if sum((h or "").encode() == key for *_, h in pages) > 1 else None
        again = low is not None and (page is None or page > low)
        out.append((page, len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, tmp_path, least):
    table = spark.createDataFrame([(p, u, (h or "").encode() if h is not None else None, "x") for p, u, h in PAGES], "page_id long, url string, payload binary, record_type string")
    warc.write_archive(table.repartition(3), f"{tmp_path}/a", least)
    got = sorted((tuple(r) for r in warc.read_archive(spark, f"{tmp_path}/a").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == _captures(PAGES, least)
    warc.write_archive(table.limit(0), f"{tmp_path}/none")
    assert warc.read_archive(spark, f"{tmp_path}/none").count() == 0


def test_query_over_odd_pages(spark, tmp_path):
    spark.createDataFrame([(*p, "x", 3) for p in PAGES], "page_id long, url string, html string, payload string, record_type int").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op12_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == _captures(PAGES)


def _records(n):
    return [warc.encode_record({"WARC-Type": "resource" if i % 2 else "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Target-URI": f"http://h{i}/"}, f"HTTP/1.1 20{i % 3} OK\r\nA: b\r\n\r\nbody {i}".encode()) for i in range(n)]


def test_any_archive_is_read(spark, tmp_path):
    """Members without lengths, several of them, and files that are not compressed; folded headers; whole and by predicate."""
    warc.register_warc(spark)
    plain = [gzip.decompress(r).replace(b"WARC-Target-URI: ", b"WARC-Target-URI:\r\n ") for r in _records(7)]
    folder = tmp_path / "x"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(plain))
    (folder / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, plain)))
    (folder / "c.warc.gz").write_bytes(b"".join(_records(7)))
    (folder / "ignored.txt").write_bytes(b"x")
    rows = spark.read.format("warc").load(str(folder)).collect()
    assert len(rows) == 21 and {(r.record_id, r.target_uri, r.http_status) for r in rows} == {(f"<urn:page:{i}>", f"http://h{i}/", None if i % 2 else 200 + i % 3) for i in range(7)}
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {f"body {i}".encode() for i in range(0, 7, 2)}
    some = spark.read.format("warc").load(str(folder)).filter("record_type in ('resource', 'x') and target_uri like 'http://h3%' and not record_id = '<urn:page:5>'")
    assert {r.record_id for r in some.collect()} == {"<urn:page:3>"} and some.count() == 3
    assert spark.read.format("warc").load(f"{folder}/a.warc").count() == 7


def test_unwanted_payloads_are_not_decoded(spark, tmp_path):
    """A payload whose compressed bytes are damaged hurts only readers that want it."""
    warc.register_warc(spark)
    rnd = random.Random(0)
    big = warc.encode_record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:page:1>"}, bytes(rnd.randrange(256) for _ in range(50_000)))
    damaged = big[:30_000] + bytes(5_000) + big[35_000:]
    (tmp_path / "a.warc.gz").write_bytes(damaged + _records(1)[0])
    read = spark.read.format("warc")
    assert [r.record_id for r in read.schema("record_id string").load(str(tmp_path)).collect()] == ["<urn:page:1>", "<urn:page:0>"]
    assert [bytes(r.payload) for r in spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'response'").collect()] == [b"body 0"]
    with pytest.raises(Exception, match="(?i)error"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_files_roll_split_and_are_committed(spark, tmp_path):
    warc.register_warc(spark)
    rows = spark.range(40).select(F.concat(F.lit("<urn:page:"), "id", F.lit(">")).alias("record_id"), F.lit("resource").alias("record_type"), F.md5(F.col("id").cast("string")).cast("binary").alias("payload"))
    rows.coalesce(2).write.format("warc").option("bytes", 900).option("split", 300).mode("append").save(str(tmp_path))
    (tmp_path / "part-left-by-a-failed-task.warc.gz").write_bytes(b"not to be read")
    read = spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'resource'")
    assert len(list(tmp_path.glob("part-*.warc.gz"))) > 4 and read.rdd.getNumPartitions() > 8
    assert read.select("record_id").distinct().count() == 40 == read.count()
    rows.limit(3).write.format("warc").mode("overwrite").save(str(tmp_path))
    assert spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'resource'").count() == 3


# periodic runs


def _runs(ws):
    """(start, length, period) of all runs, trying every period."""
    n, out = len(ws), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            if ws[at] != ws[at + q]:
                at += 1
                continue
            s = at
            while at + q < n and ws[at] == ws[at + q]:
                at += 1
            size = at - s + q
            if size >= max(12, 2 * q) and not any(all(ws[s + i] == ws[s + i + r] for i in range(q - r)) and q % r == 0 for r in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _expected(doc_id, text):
    ws = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(ws)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = _runs(ws)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), digest(listed.encode()), digest(b" ".join(w for i, w in enumerate(ws) if i not in gone)))


def _repeating(seed, n_docs, longest):
    rnd = random.Random(seed)
    docs = []
    for i in range(n_docs):
        ws = [rnd.choice(["a", "b", "é", "dd"][: rnd.randint(1, 4)]) if i % 3 else f"w{rnd.randrange(400)}" for _ in range(rnd.randint(0, longest))]
        for _ in range(rnd.randint(0, 4)):
            if len(ws) > 20:
                s, p = rnd.randrange(len(ws) - 10), rnd.randint(1, len(ws) // 3)
                for j in range(s + p, min(len(ws), s + rnd.randint(p, 4 * p + 9))):
                    ws[j] = ws[j - p]
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(ws)))
    return docs


_ODD_DOCS = [(None, None), (None, "x " * 40), (1, ""), (2, " \n\t "), (3, "one"), (4, None), (5, "a b c " * 100), (5, "a b c " * 100), (6, "z" * 5000), (7, "\x1c  a b " * 30), (10, "q r s t u v w x y z " * 9)]


@pytest.mark.parametrize(("docs", "base"), [(_ODD_DOCS, 1 << 14), (_ODD_DOCS, 64), (_repeating(0, 60, 200), 1 << 14), (_repeating(1, 40, 600), 64), (_repeating(2, 30, 900), 128)])
def test_runs_match_brute_force(spark, docs, base):
    """Whole documents in one tile, and documents cut into tiles of 64 words and more."""
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, start string, runs int").repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.periodic_runs(table, base).collect()), key=str)
    assert got == sorted((_expected(d, t) for d, t in docs), key=str)


def test_runs_of_nothing_and_of_one_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(none).count() == 0
    words = [f"w{i}" for i in range(60_000)] * 2 + ["end"]
    (row,) = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 120_000, 60_000)
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(words[:60_000] + ["end"]).encode()).hexdigest()


def test_every_two_periods_lie_in_one_tile():
    for base in (64, 256):
        for n in (0, 1, 63, 64, 65, 500, 4097):
            plan = list(periodic_runs.tiles(n, base))
            for octave in range(max(0, n.bit_length() - 2) + 1):
                of = sorted((a, b) for a, b, low, high in plan if low <= octave <= high)
                need = max(12, 4 << octave)
                assert of[0][0] == 0 and of[-1][1] == n
                assert all(b - c >= need for (_, b), (c, _) in zip(of, of[1:], strict=False))
