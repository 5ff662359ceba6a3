"""SimHash near-duplicates: fingerprints linked within a Hamming distance by pigeonring filtering.

A 64-bit fingerprint is a ring of ``m`` segments. If two fingerprints differ in at most ``t`` bits, some chain of
consecutive segments has cumulative differences of at most floor(l * t / m) over its first l segments, for every l.
The first segments of such a chain must be equal and the next ones may differ in one bit, so an equality join on the
chain (and its one-bit variants) yields all candidates; the rest of the chain prunes them before the full check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import row_digest, small_batches
from tracewell.session import broadcast_if_small, materialize

DISTANCE = 4
SHINGLE = 4
#: (segments, segments of the chain that are joined on), for up to so many distinct fingerprints. More fingerprints
#: need longer keys to keep chance candidates few; each entry is exact at any size.
_RINGS = ((1 << 21, 5, 2), (1 << 25, 9, 4), (1 << 29, 13, 6), (1 << 63, 17, 8))
_PAIRS = 1 << 18
#: Rows of one key that are paired in one task, about. Keys that may have more are cut into blocks of half as many, of
#: exact rows and of variants, whose pairs are dealt out.
RUN = 1 << 15
#: Fingerprints of a class beyond which its id is broadcast.
_MANY = 1000
#: Key rows a task makes, on average.
_TASK_KEYS = 2_000_000


def fingerprint(text: bytes | None) -> int:
    """SimHash of one text as a signed 64-bit number; no words give 0."""
    import xxhash

    words = (text or b"").lower().split()  # of bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    buffer, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(buffer[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([fingerprint(t) for t in batch.cast(pa.binary()).to_pylist()], pa.int64())


def ring(n: int) -> tuple[list[int], int]:
    """Segment widths and chain length for n fingerprints."""
    m, chain = next((m, c) for most, m, c in _RINGS if n <= most)
    return [64 // m + (i < 64 % m) for i in range(m)], chain


def _chain_keys(fp: Column, widths: list[int], chain: int) -> tuple[Column, Column]:
    """(exact keys, one-bit variants) of every chain. A variant sets a bit that is 0, so a pair meets once."""
    m, exact, variants = len(widths), [], []
    for i in range(m):
        offset = sum(widths[:i])
        bits = sum(widths[(i + j) % m] for j in range(chain))
        first = sum(widths[(i + j) % m] for j in range(chain) if (j + 1) * DISTANCE // m == 0)
        turned = F.shiftrightunsigned(fp, offset).bitwiseOR(F.shiftleft(fp, 64 - offset)) if offset else fp
        key = turned.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(i << 48))
        exact.append(key)
        for b in range(first, bits):
            bit = F.lit(1 << b).cast("bigint")
            variants.append(F.when(key.bitwiseAND(bit) == 0, key.bitwiseOR(bit)))
    return F.array(*exact), F.array_compact(F.array(*variants))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as stars: every node but the least of each component, with that least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


#: What a row of a run does: meets the plain rows before it; meets every plain row; is only met.
PLAIN, MEETS, MET = 0, 1, 2


def _links(widths: list[int], chain: int):
    """Reads (key, part, fp, role) sorted by key, part and role; yields stars of the fingerprints within the distance."""
    m = len(widths)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def near(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        diff, keep = (a ^ b).view(np.uint64), np.ones(len(a), bool)
        offsets = np.cumsum([0, *widths])
        total = np.zeros(len(a), np.int64)
        for j in range(m - 1):  # the chain's budgets, segment after segment
            seg = (start + j) % m
            width = np.array(widths, np.uint64)[seg]
            part = (diff >> offsets[seg].astype(np.uint64)) & ((np.uint64(1) << width) - np.uint64(1))
            total += np.bitwise_count(part)
            if j >= chain - 1:
                keep &= total <= (j + 1) * DISTANCE // m
        at = np.flatnonzero(keep)
        return at[np.bitwise_count(diff[at]) <= DISTANCE]

    def runs(key: np.ndarray, part: np.ndarray, fp: np.ndarray, role: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs of equal key and part, in blocks of about _PAIRS pairs; one row's partners are never cut."""
        if not len(key):
            return
        new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        begin, run = np.flatnonzero(new), np.cumsum(new) - 1
        base = np.bincount(run, role != MEETS, minlength=len(begin)).astype(np.int64)  # these stand first in a run
        partners = np.where(role == MEETS, base[run], np.where(role == PLAIN, np.arange(len(key)) - begin[run], 0))
        upto = np.cumsum(partners)
        at = 0
        while at < len(key):
            past = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, past + _PAIRS, "right")))
            n = partners[at:stop]
            if n.sum():
                row = np.repeat(np.arange(at, stop), n)
                other = begin[run[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                hit = near(fp[row], fp[other], key[row] >> 48)
                if len(hit):
                    u, v = _stars(fp[row[hit]], fp[other[hit]])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)
            at = stop

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
            key, part = held[-1][:2]
            if len(held) < 32 or not len(key) or (key[0] == key[-1] and part[0] == part[-1]):
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.flatnonzero((rows[0] != key[-1]) | (rows[1] != part[-1]))[-1]) + 1  # the last run may go on
            yield from runs(*(x[:cut] for x in rows))
            held = [tuple(x[cut:] for x in rows)]
        if held:
            yield from runs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return work


def _crowded(dealt: DataFrame, widths: list[int], chain: int, run: int) -> DataFrame:
    """(key, blocks, others): keys that may have more than ``run`` rows, with the blocks of their exact rows and variants.

    A variant of a key is a fingerprint whose own key lacks one of its bits. So the variants of a key are summed
    from the counts of exact keys; those below run / (2 x bits) are left out, which miss half a run together.
    """
    exact, _ = _chain_keys(F.col("fp"), widths, chain)
    bits = max(sum(widths[(i + j) % len(widths)] for j in range(chain)) for i in range(len(widths)))
    counts = dealt.select(F.explode(exact).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.filter(F.col("n") > run / (2 * bits)), "crowded_keys")
    over = F.array_compact(F.array(*(F.when(F.col("key").bitwiseAND(F.lit(1 << b)) == 0, F.col("key").bitwiseOR(F.lit(1 << b))) for b in range(bits))))
    variants = counts.select(F.explode(over).alias("key"), F.lit(0).alias("n"), F.col("n").alias("v"))
    both = counts.select("key", "n", F.lit(0).alias("v")).unionByName(variants).groupBy("key").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    heavy = both.filter((2 * F.col("n") > run) | (F.col("v") > 0))
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("n") / run))
    others = F.ceil((2 * F.col("v") + run) / run)
    return materialize(heavy.select("key", blocks.cast("int").alias("blocks"), others.cast("int").alias("others")), "heavy_keys")


def _in_blocks(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Cuts the rows of ``heavy`` keys into blocks of fingerprints; every pair of blocks becomes a part.

    In the part of exact blocks i < j, the rows of i are met by those of j; in that of i alone, rows meet the ones before
    them. Variants are cut too: in the part of exact block i and variant block j, the rows of i are met by those of j.
    """
    hot = rows.join(broadcast_if_small(heavy.withColumnRenamed("key", "__k"), 1_000_000), F.col("key") == F.col("__k"), "left").drop("__k")
    e, v = F.col("blocks").cast("bigint"), F.col("others").cast("bigint")
    mine, other = F.pmod(F.xxhash64("fp"), e), F.pmod(F.xxhash64("fp"), v)
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), e - 1),
        lambda j: F.struct((F.least(mine, j) * e + F.greatest(mine, j)).alias("part"), F.when(mine == j, PLAIN).when(mine < j, MET).otherwise(MEETS).alias("role")),
    )
    met = F.transform(F.sequence(F.lit(0).cast("bigint"), v - 1), lambda j: F.struct((e * e + mine * v + j).alias("part"), F.lit(MET).alias("role")))
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), e - 1), lambda i: F.struct((e * e + i * v + other).alias("part"), F.lit(MEETS).alias("role")))
    own = F.array(F.struct(F.lit(0).cast("bigint").alias("part"), F.col("role")))
    spread = F.when(F.col("blocks").isNull(), own).when(F.col("role") == MEETS, meets).otherwise(F.concat(pairs, met))
    return hot.withColumn("b", F.explode(spread)).select("key", "b.part", "fp", "b.role")


def keys_in_parts(distinct: DataFrame, n: int, run: int = RUN) -> DataFrame:
    """(key, part, fp, role): every fingerprint under its chain keys and their one-bit variants, in parts of about
    ``run`` rows at most."""
    widths, chain = ring(n)
    exact, variants = _chain_keys(F.col("fp"), widths, chain)
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, distinct.count() * 5 * len(widths) // _TASK_KEYS)
    dealt = distinct.select("fp").repartition(tasks, "fp")  # a few files would make a few tasks of many keys
    heavy = _crowded(dealt, widths, chain, run)
    keys = F.concat(F.transform(exact, lambda k: F.struct(k.alias("key"), F.lit(PLAIN).alias("role"))), F.transform(variants, lambda k: F.struct(k.alias("key"), F.lit(MEETS).alias("role"))))
    rows = dealt.select("fp", F.explode(keys).alias("k")).select("k.key", F.lit(0).cast("bigint").alias("part"), "fp", "k.role")
    return _in_blocks(rows, heavy) if heavy.limit(1).count() else rows


def link_fingerprints(distinct: DataFrame, n: int, run: int = RUN) -> DataFrame:
    """Links (u, v) that connect all fingerprints within the distance; ``distinct`` (written) has each fp once.

    ``n`` chooses the ring, any of which is exact. Keys that may have more than ``run`` rows, exact or variants, are
    found first and cut into blocks, so a task holds about ``run`` rows of a key whatever the crowd.
    """
    widths, chain = ring(n)
    rows = keys_in_parts(distinct, n, run)
    # roles by (is MEETS): those that are met stand first
    met = rows.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part", F.col("role") == MEETS)
    return met.mapInArrow(_links(widths, chain), "u long, v long")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node with a link, by alternating large and small stars.

    Each round relinks all larger neighbours of a node, then all smaller ones, to its least neighbour; the rounds
    grow with the logarithm of the number of nodes. Minimums are pre-aggregated and written before they are joined, so
    AQE can split a node with very many neighbours. Every round is a written table.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        own = least.select("u", F.col("m").alias("v"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()
        edges = materialize(small, "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, row_key (128-bit digest of the whole row), fp (signed) and component_id.

    component_id is the smallest doc_id whose document is reachable over links of at most four differing bits; null
    ids count only where a class has no other. Null and empty texts have fingerprint 0; texts of any length are read
    whole. Copies, however many, share
    one fingerprint and are linked once. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    table = materialize(docs.select("doc_id", row_digest(docs).alias("row_key"), _fingerprints("text").alias("fp")), "fingerprints")
    distinct = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = connected_components(link_fingerprints(distinct.select("fp"), distinct.count()))
    rooted = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("least"), F.count(F.lit(1)).alias("n")), "ids")
    # classes of many fingerprints, which are few, are met by broadcast: no task gets one whole
    many = ids.filter(F.col("n") > _MANY).select("root", F.col("least").alias("component_id"))
    hot = rooted.join(broadcast_if_small(many.withColumnRenamed("root", "__r"), 1_000_000), F.col("root") == F.col("__r"), "left")
    rest = hot.filter("__r is null").drop("component_id").join(ids.filter(F.col("n") <= _MANY).select("root", F.col("least").alias("component_id")), "root")
    classes = hot.filter("__r is not null").select("fp", "component_id").unionByName(rest.select("fp", "component_id"))
    return table.join(broadcast_if_small(materialize(classes, "classes"), 100_000), "fp").select("doc_id", "row_key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the least doc_id (nulls last), then the least row digest.

    Rows that are equal in every column are one document.
    """
    members = near_duplicate_classes(docs)
    ranked = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    rows = members.groupBy("fp", "component_id", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("copies"))
    # classes without any id have a null component and are told apart by fingerprint
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")]
    kept = materialize(rows.groupBy(*group).agg(F.min(F.struct(ranked.alias("r"), "copies")).alias("b")).select(F.col("b.r.row_key").alias("__tw_h"), F.col("b.copies").alias("__tw_n")), "kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # as many rows as documents stay: joined by shuffle at every size, against hash tables of keys, so texts are not sorted
    chosen = docs.withColumn("__tw_h", row_digest(docs)).join(kept.hint("shuffle_hash"), "__tw_h")
    if not kept.filter("__tw_n > 1").limit(1).count():
        return chosen.select(columns)
    once = chosen.filter("__tw_n > 1").dropDuplicates(["__tw_h"])
    return chosen.filter("__tw_n = 1").union(once).select(columns)


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least id of its class; texts without words are one class, with fingerprint 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicate_classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
