"""Sharding: a keyed Feistel permutation over global row numbers.

Row numbers are a pure function of the rows' contents, so the shuffle is the same for every file layout,
partition count and rerun. ``position = permutation(row_number)`` gives ``shard = position % n_shards`` and
``slot = position // n_shards``, so shard sizes differ by one row at most and a row's place can be computed
from its number alone (``locate``).
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import row_digest
from tracewell.session import materialize

_PRIME = 2_147_483_647
_ROUNDS = 6
#: Rows that one numbering window sorts, on average, once the input is large.
_BUCKET_ROWS = 50_000
_MIN_BUCKETS = 1024


def _keys(seed: int) -> tuple[list[int], list[int]]:
    rng = random.Random(f"shards {seed}")
    return [rng.randrange(1, _PRIME) for _ in range(_ROUNDS)], [rng.randrange(_PRIME) for _ in range(_ROUNDS)]


def _sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds ``n`` numbers; fewer than ``left`` cells lie beyond n."""
    left = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return left, max(1, -(-n // left))


def locate(row_number: int, n_rows: int, n_shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of one row number, computed without any data."""
    (mults, adds), (left, right) = _keys(seed), _sides(n_rows)
    x = row_number
    while True:
        l, r = divmod(x, right)
        for i in range(_ROUNDS):
            t = ((r if i % 2 == 0 else l) * mults[i] + adds[i]) % _PRIME
            f = t * (t + 1) % _PRIME
            l, r = ((l + f) % left, r) if i % 2 == 0 else (l, (r + f) % right)
        x = l * right + r
        if x < n_rows:
            return x % n_shards, x // n_shards


def _div(x: Column, by: int) -> Column:
    """Whole quotient of a long; ``floor`` of a double quotient would lose digits beyond 2**53."""
    return F.call_function("div", x, F.lit(by).cast("bigint"))


def with_position(df: DataFrame, n_rows: int, seed: int = 0, number: str = "row_number", name: str = "position") -> DataFrame:
    """Adds the Feistel permutation of 0..n_rows-1 at ``number``.

    Halves live on a left x right grid. Numbers beyond ``n_rows`` walk on along their cycle; a walk that began
    inside is back inside after at most as many steps as there are cells outside, so the bound is exact.
    """
    (mults, adds), (left, right) = _keys(seed), _sides(n_rows)
    rounds = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(a).cast("bigint").alias("a"), F.lit(i % 2 == 0).alias("on_left")) for i, (m, a) in enumerate(zip(mults, adds, strict=True))])

    def half_round(s: Column, k: Column) -> Column:
        t = (F.when(k["on_left"], s["r"]).otherwise(s["l"]) * k["m"] + k["a"]) % _PRIME
        f = t * (t + 1) % _PRIME
        return F.struct(
            F.when(k["on_left"], (s["l"] + f) % left).otherwise(s["l"]).alias("l"),
            F.when(k["on_left"], s["r"]).otherwise((s["r"] + f) % right).alias("r"),
        )

    def once(x: Column) -> Column:
        return F.aggregate(rounds, F.struct(_div(x, right).alias("l"), (x % right).alias("r")), half_round, lambda s: s["l"] * right + s["r"])

    y, outside = F.col(name), left * right - n_rows
    first = df.withColumn(name, once(F.col(number)))
    if outside <= 0:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), y, lambda at, _: F.when(at < n_rows, at).otherwise(once(at)))
    return first.withColumn(name, F.when(y < n_rows, y).otherwise(walk))


def number_rows(docs: DataFrame, n_rows: int, name: str = "row_number", digest: str | None = None) -> DataFrame:
    """Adds contiguous global row numbers from 0, in the order of the rows' digests, or of those in a column ``digest``,
    which goes: so rows may be numbered without what is long in them.

    Ranges of the digest's first 32 bits are the buckets, so neither a common id nor a common text makes one large;
    bucket sizes are counted first, and their running sum is each bucket's offset. Only the numbering window moves the
    rows, once. Rows that are equal in every column get consecutive numbers in either order; other rows are told
    apart by 128 bits, so reruns agree at any size.
    """
    rows = docs.drop(name)
    buckets = max(_MIN_BUCKETS, -(-n_rows // _BUCKET_ROWS))
    hashed = rows.withColumn("__tw_h", F.col(digest) if digest else row_digest(rows)).drop(*([digest] if digest else []))
    first = F.conv(F.hex(F.substring("__tw_h", 1, 4)), 16, 10).cast("bigint")
    hashed = hashed.withColumn("__tw_b", F.shiftright(first * buckets, 32))
    sizes = hashed.groupBy("__tw_b").agg(F.count(F.lit(1)).alias("__tw_n"))
    before = F.sum("__tw_n").over(Window.orderBy("__tw_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__tw_b", F.coalesce(before, F.lit(0)).alias("__tw_before"))
    if buckets <= 100_000:  # as many rows at most
        offsets = F.broadcast(offsets)
    within = F.row_number().over(Window.partitionBy("__tw_b").orderBy("__tw_h"))
    numbered = hashed.withColumn("__tw_i", within).join(offsets, "__tw_b")
    return numbered.withColumn(name, F.col("__tw_before") + F.col("__tw_i") - 1).drop("__tw_b", "__tw_h", "__tw_i", "__tw_before")


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 0, digest: str | None = None) -> DataFrame:
    """Adds row_number, shard and slot (all bigint but shard int); existing columns of these names are replaced.

    Every row gets a place, whatever its values: nulls, empty and very long texts and repeated rows count like any other.
    An empty table gives an empty result. Shard counts differ by one at most and slots are gapless from 0.
    """
    n = docs.count()
    placed = with_position(number_rows(docs.drop("shard", "slot"), n, digest=digest), max(n, 1), seed, name="__tw_p")
    p = F.col("__tw_p")
    return placed.withColumn("shard", (p % n_shards).cast("int")).withColumn("slot", _div(p, n_shards)).drop("__tw_p")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law ``rows``; null texts have size 16 and the checksum of no bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    # texts are read once, for what is asked of them and the digest that numbers the rows; they are not moved
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), row_digest(docs).alias("digest"))
    return shard_rows(materialize(sized, "sized"), 40, digest="digest").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _sql(n_shards: int = 40, seed: int = 0) -> str:
    """The query in SQL: numbers by digest, then the permutation's rounds written out, walked until inside."""
    mults, adds = _keys(seed)
    rounds = []
    for i in range(_ROUNDS):
        side, other, size = ("l", "r", "lft") if i % 2 == 0 else ("r", "l", "rgt")
        rounds.append(f"(({other}{i} * {mults[i]} + {adds[i]}) % {_PRIME}) AS t{i}, ({side}{i} + t{i} * (t{i} + 1) % {_PRIME}) % {size} AS {side}{i + 1}, {other}{i} AS {other}{i + 1}")
    once = "x // rgt AS l0, x % rgt AS r0, " + ", ".join(rounds) + f", l{_ROUNDS} * rgt + r{_ROUNDS} AS y"
    return f"""
WITH RECURSIVE c AS (SELECT count(*)::BIGINT AS n FROM documents),
s AS (SELECT n, lft, greatest(1, (n + lft - 1) // lft)::BIGINT AS rgt FROM (SELECT n, greatest(1, floor(sqrt(greatest(n - 1, 0)))::BIGINT + 1) AS lft FROM c)),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY md5(coalesce(md5(doc_id::VARCHAR), '-') || coalesce(md5(text), '-'))) - 1 AS row_number FROM documents),
w AS (SELECT row_number, y, 0 AS walked FROM (SELECT row_number, {once} FROM (SELECT row_number, row_number AS x, lft, rgt FROM d, s))
  UNION ALL SELECT row_number, y, walked FROM (SELECT row_number, walked, {once} FROM (SELECT row_number, w.y AS x, lft, rgt, walked + 1 AS walked FROM w, s WHERE w.y >= s.n))),
p AS (SELECT row_number, y FROM w, s WHERE y < s.n),
t AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda v, b: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i))),
k AS (SELECT row_number, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT), lambda v, x: xor(v >> 8, t[(xor(v, x) & 255) + 1]), 4294967295), 4294967295) AS crc FROM d, t)
SELECT doc_id, (octet_length(encode(text)) + 16)::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (y % {n_shards})::INT AS shard, (y // {n_shards})::BIGINT AS slot, NULL::INT AS grown_shard, row_number::BIGINT AS row_number
FROM d JOIN p USING (row_number) JOIN k USING (row_number)
"""


OP1_SQL = _sql()
