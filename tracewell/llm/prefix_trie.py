"""Conversations as a trie of their prefixes, by ROLLUP over positional turn columns.

Turns stand in blocks of ``WIDTH`` columns. ``ROLLUP`` over the columns of a block aggregates all its prefixes at
once, ``grouping_id`` tells their depth; a long conversation goes on in further blocks, each keyed by the node that the
block before ended in, so one pass serves conversations of any length. A node's key is the exclusive-or of a
128-bit hash of every (place, turn) on its path, so keys of blocks are running sums and those of parents differ by one turn.

Sums over subtrees need no walk over the depths. A node's smallest member owns it; a conversation owns the lower end
of its path, so what all nodes of a subtree sum up to is the sum of what its members own, less what the smallest member
owns above. A second ROLLUP adds this up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import broadcast_if_small, materialize

#: Turn columns of a block.
WIDTH = 8
#: Blocks, or depths, of a conversation that one window task takes in order.
_STEP = 4096
#: Ids that one piece of a list of ends holds.
_PIECE = 4096
#: Children beyond which a parent is broadcast.
_MANY = 1000


def number_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, place, id, chars): turns numbered from 0 in the order of ``turn``, nulls first.

    ``id`` is a 128-bit digest of role and text (nulls are empty), ``chars`` the text's code points. Turns of equal
    number stand in the order of their ids. Rows without conv_id belong to no conversation. The order is a range
    partitioning, ``part`` its piece: one conversation may be spread over many tasks, whose counts are added up.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("id"), F.char_length(text).alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("conv_id", "id", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ordered_turns")
    parts = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "part", (before - F.col("first")).alias("shift"))
    placed = dealt.join(parts, ["conv_id", "part"])
    return placed.select("conv_id", "part", (F.col("at") + F.col("shift")).cast("int").alias("place"), "id", "chars")


def continue_heads(turns: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt on a shared head: (conv_id, n, place, id, chars), ``turns`` (written) being numbered.

    Conversation c takes the first h turns of conversation c - c % ``family`` (all of them where there are fewer, none
    where that is absent) in place of its own first h, h being crc32(c as text) % ``most``. ``n`` is its number of turns
    then; one without any keeps a row with null place.
    """
    parts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    owned = materialize(parts.groupBy("conv_id").agg(F.sum("n").cast("int").alias("own")).withColumn("h", h), "conversations")
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("place") < most - 1)).groupBy(F.col("conv_id").alias("head")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "chars"))).alias("turns"))
    joined = owned.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head"), "left")
    taken = F.slice(F.coalesce("turns", F.array().cast("array<struct<place:int,id:binary,chars:int>>")), F.lit(1), F.col("h"))
    plan = joined.select("conv_id", "h", taken.alias("taken"), F.size(taken).alias("m"), (F.size(taken) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    plan = materialize(plan, "plan")
    shift = parts.select("conv_id", "part").join(plan.select("conv_id", "h", "m", "n"), "conv_id")
    own = turns.join(shift, ["conv_id", "part"]).filter("place >= h").select("conv_id", "n", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "id", "chars")
    head = plan.filter("m > 0 or n = 0").select("conv_id", "n", F.explode_outer("taken").alias("t")).select("conv_id", "n", "t.place", "t.id", "t.chars")
    return own.unionByName(head)


def _keys(place: Column, turn_id: Column) -> tuple[Column, Column]:
    return F.xxhash64(place, turn_id), F.xxhash64(F.lit("second"), place, turn_id)


def _running(df: DataFrame, order: str, sums: dict[str, Column], add) -> DataFrame:
    """Adds, under its name, what ``add`` makes of each column over the rows of the same conv_id before this one.

    ``order`` numbers the rows of a conversation with few gaps. Windows take ``_STEP`` numbers at a time; what the steps
    before come to is joined, so no task gets a long conversation whole.
    """
    kept = df.columns
    df = df.withColumn("__tw_step", F.floor(F.col(order) / _STEP).cast("int"))
    total = df.groupBy("conv_id", "__tw_step").agg(*(add(c).alias(f"__tw_t_{name}") for name, c in sums.items()))
    earlier = Window.partitionBy("conv_id").orderBy("__tw_step").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select("conv_id", "__tw_step", *(add(F.col(f"__tw_t_{name}")).over(earlier).alias(f"__tw_c_{name}") for name in sums)).filter("__tw_step > 0")
    inside = Window.partitionBy("conv_id", "__tw_step").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *(add(c).over(inside).alias(f"__tw_l_{name}") for name, c in sums.items())).join(carry, ["conv_id", "__tw_step"], "left")
    both = {name: F.array_compact(F.array(F.col(f"__tw_l_{name}"), F.col(f"__tw_c_{name}"))) for name in sums}
    return local.select(*kept, *(v.alias(name) for name, v in both.items()))


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, n, blk, turns, x1, x2, y1, y2): blocks of up to ``WIDTH`` turns, the key before each and behind it."""
    placed = F.col("place").isNotNull()
    x1, x2 = _keys(F.col("place"), F.col("id"))
    blk = F.coalesce(F.floor(F.col("place") / WIDTH).cast("int"), F.lit(0))
    grouped = turns.groupBy("conv_id", "n", blk.alias("blk")).agg(
        F.sort_array(F.collect_list(F.when(placed, F.struct("place", "id", "chars")))).alias("turns"),
        F.coalesce(F.bit_xor(F.when(placed, x1)), F.lit(0)).alias("z1"),
        F.coalesce(F.bit_xor(F.when(placed, x2)), F.lit(0)).alias("z2"),
    )
    ran = _running(materialize(grouped, "turn_blocks"), "blk", {"a1": F.col("z1"), "a2": F.col("z2")}, F.bit_xor)
    fold = lambda name: F.aggregate(name, F.lit(0).cast("bigint"), lambda a, v: a.bitwiseXOR(v))
    ran = ran.select("conv_id", "n", "blk", "turns", fold("a1").alias("x1"), fold("a2").alias("x2"), "z1", "z2")
    return ran.select("*", F.col("x1").bitwiseXOR(F.col("z1")).alias("y1"), F.col("x2").bitwiseXOR(F.col("z2")).alias("y2")).drop("z1", "z2")


def _rolled(rows: DataFrame, measures: str) -> DataFrame:
    """``measures`` of every prefix: one ROLLUP over the turn columns of all blocks, each keyed by the node before it."""
    turns = ", ".join(f"t{i}" for i in range(WIDTH))
    columns = [F.get("turns", F.lit(i)) for i in range(WIDTH)]
    split = rows.select("*", F.struct("blk", "x1", "x2").alias("node"), *(F.when(c.isNotNull(), F.struct(c["id"].alias("id"), c["chars"].alias("chars"))).alias(f"t{i}") for i, c in enumerate(columns)))
    rolled = rows.sparkSession.sql(f"SELECT node, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, {measures} FROM {{rows}} GROUP BY node, ROLLUP ({turns})", rows=split)
    last = F.get(F.array(*(f"t{i}" for i in range(WIDTH))), F.col("level") - 1)
    # a conversation that ends in the block has null columns, which are no nodes; level 0 is the node before
    real = F.when(F.col("level") == 0, F.col("node.blk") == 0).otherwise(last.isNotNull())
    return rolled.withColumn("last", F.when(F.col("level") > 0, last)).filter(real).withColumn("depth", F.col("node.blk") * WIDTH + F.col("level"))


def _nodes(blocks: DataFrame) -> DataFrame:
    """(conv_id, depth, n_convs, chars, x1, x2, p1, p2): every node with its smallest member, key and parent's key."""
    rolled = _rolled(blocks.select("conv_id", "blk", "x1", "x2", "turns"), "min(conv_id) AS conv_id, count(*) AS n_convs")
    own = [F.col("node.x1"), F.col("node.x2")]
    for i in range(WIDTH):
        keys = _keys((F.col("node.blk") * WIDTH + i).cast("int"), F.col(f"t{i}.id"))
        own = [a.bitwiseXOR(F.when(F.col(f"t{i}").isNotNull(), k).otherwise(F.lit(0).cast("bigint"))) for a, k in zip(own, keys, strict=True)]
    turn = _keys((F.col("depth") - 1).cast("int"), F.col("last.id"))
    keyed = rolled.select("conv_id", "depth", "n_convs", F.coalesce("last.chars", F.lit(0)).alias("chars"), own[0].alias("x1"), own[1].alias("x2"), *(k.alias(f"l{i}") for i, k in enumerate(turn)))
    return keyed.select("conv_id", "depth", "n_convs", "chars", "x1", "x2", F.col("x1").bitwiseXOR(F.col("l0")).alias("p1"), F.col("x2").bitwiseXOR(F.col("l1")).alias("p2"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads pieces of lists sorted by node and place; yields each node's SHA-256, holding one state and one batch."""
    node, state, out = None, None, []

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"depth": d, "x1": a, "x2": b, "ends_sha256": s} for (d, a, b), s in rows], schema=pa.schema([("depth", pa.int32()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for depth, x1, x2, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (depth, x1, x2) != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = (depth, x1, x2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield flush(out)
            out = []
    if node is not None:
        out.append((node, state.hexdigest()))
    yield flush(out)


def _ends(blocks: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of the nodes where conversations end.

    The ids of one node, however many, are put in order by a range partitioning and joined in pieces of at most
    ``_PIECE``; only the pieces meet in one task, which hashes them as they pass.
    """
    last = F.col("blk") == F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / WIDTH)
    ends = blocks.filter(last).select(F.col("n").alias("depth"), F.col("y1").alias("x1"), F.col("y2").alias("x2"), "conv_id")
    order = ["depth", "x1", "x2", "conv_id"]
    dealt = materialize(ends.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ends")
    pieces = dealt.groupBy("depth", "x1", "x2", F.floor(F.col("at") / _PIECE).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    told = pieces.repartition("depth", "x1", "x2").sortWithinPartitions("depth", "x1", "x2", "piece").select("depth", "x1", "x2", "ids")
    return told.mapInArrow(_digests, "depth int, x1 long, x2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of the trie of all conversations, from rows (conv_id, n, place, id, chars).

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. The root is there for any conversation, also one without turns (one row with null place); no rows
    give no nodes. Conversations may have any length and any number of copies: what long ones and large groups need is
    aggregated before it is shuffled and dealt out in steps, blocks and pieces.
    """
    blocks = materialize(_blocks(turns), "blocks")
    nodes = materialize(_nodes(blocks), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    weight = (F.col("n_convs") - 1) * F.col("chars")
    known = nodes.join(children, ["depth", "x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    known = materialize(known.withColumn("weight", weight).withColumn("leaf", (F.col("n_children") == 0).cast("bigint")), "known")
    ran = _running(known, "depth", {"above": F.col("weight")}, F.sum)
    first = F.size("above") == 0  # of the nodes that its smallest member owns, the highest
    ran = materialize(ran.withColumn("first", first).withColumn("above", F.aggregate("above", F.lit(0).cast("bigint"), lambda a, v: a + v)), "owned")

    owners = known.groupBy("conv_id").agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaves"))
    heavy = owners.filter("weight <> 0 or leaves <> 0")
    sums = _rolled(blocks.select("conv_id", "blk", "x1", "x2", "turns").join(heavy, "conv_id", "left"), "min(conv_id) AS conv_id, sum(weight) AS total, sum(leaves) AS n_leaves").select("conv_id", "depth", "total", "n_leaves")

    # the highest owned node has its parent elsewhere; parents of very many children, which are few, are broadcast
    parents = ran.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    links = ran.filter("first and depth > 0").select("conv_id", "depth", "p1", "p2")
    many = broadcast_if_small(parents.filter(F.col("n_children") > _MANY).drop("n_children"), 1_000_000)
    met = links.join(many, ["depth", "p1", "p2"], "left")
    rest = met.filter("parent_conv_id is null").drop("parent_conv_id").join(parents.filter(F.col("n_children") <= _MANY).drop("n_children"), ["depth", "p1", "p2"])
    linked = met.filter("parent_conv_id is not null").unionByName(rest).select("conv_id", "depth", "parent_conv_id")

    nobody = hashlib.sha256(b"").hexdigest()
    whole = ran.join(sums, ["conv_id", "depth"]).join(linked, ["conv_id", "depth"], "left").join(_ends(blocks), ["depth", "x1", "x2"], "left")
    return whole.select(
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(0).cast("bigint")).alias("n_leaves"),
        (F.coalesce("total", F.lit(0).cast("bigint")) - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations after each has been rebuilt on the head of its hundred (``continue_heads``).

    Null roles and texts are empty, null turns come first, equal turn numbers stand in the order of their digests,
    rows without conv_id are left out, an empty table has no nodes; further columns are ignored.
    """
    turns = materialize(number_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), "turns")
    return prefix_trie(continue_heads(turns))


OP11_SQL = """
WITH t AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda v, b: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i))),
s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS place, length(role) || ':' || role || text AS said, length(text) AS chars FROM s),
h AS (SELECT conv_id, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT), lambda v, x: xor(v >> 8, t[(xor(v, x) & 255) + 1]), 4294967295), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), t),
r AS (SELECT conv_id, h, o.place AS place, o.said, o.chars, 0 AS own FROM h JOIN (SELECT conv_id AS head, place, said, chars FROM o) o ON head = conv_id - conv_id % 100 AND place < h
  UNION ALL SELECT conv_id, h, place, said, chars, 1 AS own FROM h JOIN o USING (conv_id) WHERE place >= h),
c AS MATERIALIZED (SELECT h.conv_id, coalesce(list(md5(said) ORDER BY own, place) FILTER (said IS NOT NULL), []) AS path, coalesce(list(chars ORDER BY own, place) FILTER (said IS NOT NULL), []) AS chars FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id),
p AS (SELECT conv_id, depth, path[:depth] AS path, CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END AS chars, len(path) = depth AS last FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM c)),
n AS MATERIALIZED (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
u AS (SELECT up AS depth, path[:up] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, m.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (depth, path) LEFT JOIN n m ON m.depth = f.depth - 1 AND m.path = f.path[:f.depth - 1]
"""
