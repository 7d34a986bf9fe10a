"""Trie of conversation prefixes by ROLLUP over positional turn-id columns.

A conversation is a row of turn ids. Its first ``WIDTH`` turns are the columns t1, t2, ... of one block;
``GROUP BY block, key, ROLLUP (t1, t2, ...)`` with ``grouping_id`` gives every prefix, its members' count and
its smallest member in one aggregate. A longer conversation goes on in further blocks whose ``key`` names the
node where the block before it ended, so conversations that have parted never meet again. All blocks of all
conversations are rows of the same ROLLUP. The keys come from the blocks' contents by doubling: after round
k a key covers 2**k blocks, so their number is the logarithm of the longest conversation's.

A node is named by its depth and its smallest member, because a conversation passes one node a depth. Sums
over subtrees are a second ROLLUP, of the nodes: a node gives its value to all its prefixes in its block, and
what lies below the block arrives through the nodes' smallest members, by a running sum over their blocks.

No conversation is collected: turns are numbered by an ordered scan that cuts long series, and blocks are
rows. Members that end in a node are joined to text in pieces of bounded size, and a hash runs over the
pieces in order, whatever their number. Joins on hot nodes are plain equality joins that adaptive execution
splits.

Turn ids are SHA-256 of role and text with the role's length, so equal turns are equal ids and the texts
themselves are never exchanged.

Defined results: rows with a null conversation id are left out; a null role or text is empty; null turns come
first; turns that tie are ordered by role, the first 16 characters of the text, and the id, and equal rows are
turns of their own; empty texts are turns; extra columns are ignored; an empty table has no root, so it gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.llm.common import one_row, shared_table
from plantscope.operators.ordered import BUCKET, OrderedScan

WIDTH = 8
ENDS_PER_PIECE = 200_000
GROUP = 5  # the query rebuilds a conversation on the first one of its group of five
HEADS = 9  # ... and takes fewer than this many of its turns
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, id, bytes) of every turn in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.substring(text, 1, 16).alias("start"),
        F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)).alias("id"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    scan = OrderedScan(turns, ["conv_id"], ["turn", "role", "start", "id"]).row_number("pos")
    return scan.rows().select("conv_id", (F.col("pos") - 1).alias("pos"), "id", "bytes")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, turns) and their turns (conv_id, pos, id, bytes), each rebuilt: the first h
    turns of the first conversation of its group, then its own after its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = shared_table(convs.select("conv_id", "base", "h", "taken", "own"), "trie-convs")
    first = turns.where(F.col("pos") < heads - 1).select(F.col("conv_id").alias("base"), "pos", "id", "bytes")
    prefixes = convs.select("conv_id", "base", "h").join(first, "base").where("pos < h")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    rows = prefixes.select("conv_id", "pos", "id", "bytes").unionByName(
        rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "bytes")
    )
    return convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), rows


def _columns(width: int) -> list[str]:
    return [f"t{k + 1}" for k in range(width)]


def _name(key: Column | str, turns: list[str]) -> Column:
    """Name of the node at the end of these turns below ``key``; ids and keys have fixed lengths."""
    return F.sha2(F.concat(F.unhex(key), *[F.coalesce(F.col(t)["id"], F.lit(b"")) for t in turns]), 256)


def _blocks(convs: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """(conv_id, block, key, next, t1, ...): a row for each block; a conversation without turns has an empty one.

    ``next`` is the key of the following block, if there is one.
    """
    t = _columns(width)
    turn = F.struct("id", "bytes")
    cells = [F.max(F.when(F.col("pos") % width == k, turn)).alias(c) for k, c in enumerate(t)]
    rows = turns.withColumn("block", F.floor(F.col("pos") / width)).groupBy("conv_id", "block").agg(*cells)
    rows = rows.join(convs, "conv_id")
    rows = rows.withColumn("more", F.col("turns") > (F.col("block") + 1) * width).drop("turns")
    nothing = [F.lit(None).cast(turns.select(turn.alias("t")).schema[0].dataType).alias(c) for c in t]
    empty = convs.where("turns = 0").select("conv_id", F.lit(0).cast("long").alias("block"), *nothing, F.lit(False).alias("more"))
    rows = shared_table(rows.unionByName(empty), "trie-blocks")
    keys = rows.where("more").select("conv_id", "block", _name(F.lit(""), t).alias("next"))
    last = one_row(rows.sparkSession, rows.where("more").agg(F.max("block").alias("last")))["last"]
    reach = 1
    while last is not None and reach <= last:
        # a key now covers the last ``reach`` blocks; with that of the blocks before these, twice as many
        keys = shared_table(keys, "trie-keys")
        before = keys.select("conv_id", (F.col("block") + reach).alias("block"), F.col("next").alias("before"))
        both = F.sha2(F.concat(F.unhex("before"), F.unhex("next")), 256)
        keys = keys.join(before, ["conv_id", "block"], "left").select("conv_id", "block", F.coalesce(both, "next").alias("next"))
        reach *= 2
    if last is None:
        return rows.select("conv_id", "block", F.lit("").alias("key"), F.lit(None).cast("string").alias("next"), *t)
    keys = shared_table(keys, "trie-keys")
    came = keys.select("conv_id", (F.col("block") + 1).alias("block"), F.col("next").alias("key"))
    # blocks of conversations of one block alone need no key
    longer = F.col("more") | (F.col("block") > 0)
    named = rows.where(longer).join(keys, ["conv_id", "block"], "left").join(came, ["conv_id", "block"], "left")
    named = named.withColumn("key", F.coalesce("key", F.lit("")))
    alone = rows.where(~longer).withColumns({"next": F.lit(None).cast("string"), "key": F.lit("")})
    names = ["conv_id", "block", "key", "next", *t]
    return shared_table(named.select(*names).unionByName(alone.select(*names)), "trie-keyed")


def _rolled(rows: DataFrame, width: int, values: str) -> DataFrame:
    """``values`` of every prefix of the blocks: (block, key, t1, ..., level: turns of the prefix in its block)."""
    t = ", ".join(_columns(width))
    sql = f"SELECT block, key, {t}, grouping_id() AS g, {values} FROM {{rows}} GROUP BY block, key, ROLLUP ({t})"
    out = rows.sparkSession.sql(sql, rows=rows).withColumn("level", (width - F.bit_count("g")).cast("long")).drop("g")
    # a prefix ends in a turn; the prefix without turns is the root, and of later blocks a node of the block before
    ends = F.get(F.array(*[F.col(c).isNotNull() for c in _columns(width)]), (F.col("level") - 1).cast("int"))
    return out.where(F.coalesce(ends, F.col("block") == 0))


def _nodes(blocks: DataFrame, width: int) -> DataFrame:
    """Every node with its names: ``name``, ``below`` (what its children call it) and ``above`` (its parent)."""
    t = _columns(width)
    found = _rolled(blocks, width, "min(conv_id) AS conv_id, count(*) AS n_convs, max(next) AS next")
    level = F.col("level")
    name = _name("key", t)
    parent = F.array(*[_name("key", t[:k]) for k in range(width)])  # columns past the prefix are null and add nothing
    last = F.get(F.array(*t), (level - 1).cast("int"))
    return shared_table(
        found.select(
            "block",
            "key",
            *t,
            "level",
            (F.col("block") * width + level).alias("depth"),
            "conv_id",
            "n_convs",
            last["id"].alias("turn_id"),
            F.coalesce(last["bytes"], F.lit(0)).alias("bytes"),
            name.alias("name"),
            F.when(level < width, name).otherwise(F.col("next")).alias("below"),
            F.when((level == 1) & (F.col("block") > 0), F.col("key")).when(level > 0, F.get(parent, (level - 1).cast("int"))).alias("above"),
        ),
        "trie-nodes",
    )


def _subtrees(blocks: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(depth, conv_id, n_leaves, saved) summed over each node's subtree, of nodes with ``leaf`` and ``own``."""
    t = _columns(width)
    values = nodes.select("conv_id", "block", "key", *t, "leaf", "own")
    followed = blocks.where("next is not null")
    if not followed.isEmpty():
        # a node below a block belongs to its smallest member, which passes the block above
        deep = nodes.where("block > 0").groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
        path = blocks.where("block > 0").select("conv_id", "block").unionByName(followed.select("conv_id", "block")).distinct()
        path = path.join(deep, ["conv_id", "block"], "left").fillna(0, ["leaf", "own"]).withColumn("up", -F.col("block"))
        scan = OrderedScan(path, ["conv_id"], ["up"]).running({"leaves": ("sum", F.col("leaf")), "saved": ("sum", F.col("own"))})
        below = scan.rows().select(
            "conv_id", "block", (F.col("leaves") - F.col("leaf")).alias("leaf"), (F.col("saved") - F.col("own")).alias("own")
        )
        passed = followed.join(below.where("leaf <> 0 or own <> 0"), ["conv_id", "block"])
        values = values.unionByName(passed.select("conv_id", "block", "key", *t, "leaf", "own"))
    summed = _rolled(values, width, "min(conv_id) AS conv_id, sum(leaf) AS n_leaves, sum(own) AS saved")
    return summed.select((F.col("block") * width + F.col("level")).alias("depth"), "conv_id", "n_leaves", "saved")


def _joined_hash(pieces: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) of pieces (depth, name, piece, text), hashed in order of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for depth, name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (depth, name) != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (depth, name), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["depth", "name", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([state.hexdigest()])], names=["depth", "name", "ends_sha256"])

    dealt = pieces.repartition("depth", "name").sortWithinPartitions("depth", "name", "piece")
    return dealt.select("depth", "name", "text").mapInArrow(run, "depth long, name string, ends_sha256 string")


def _ends(blocks: DataFrame, convs: DataFrame, width: int, most: int) -> DataFrame:
    """(depth, name, ends_sha256) of the nodes where conversations end."""
    final = blocks.where("next is null").join(convs, "conv_id")
    final = final.select("conv_id", F.col("turns").alias("depth"), _name("key", _columns(width)).alias("name"))
    scan = OrderedScan(final, [], ["conv_id"], rows_per_bucket=most)
    piece = F.col(BUCKET) if scan.is_split else F.lit(0)
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = scan.df.groupBy("depth", "name", piece.alias("piece")).agg(F.array_join(ids, ",").alias("text"))
    return _joined_hash(pieces)


def trie(convs: DataFrame, turns: DataFrame, width: int = WIDTH, ends_per_piece: int = ENDS_PER_PIECE) -> DataFrame:
    """The nodes of all prefixes of the conversations (conv_id, turns) with turns (conv_id, pos, id, bytes).

    One row a node: conv_id (its smallest member), depth, turn_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved_bytes and ends_sha256 (of the members that end there).
    """
    blocks = _blocks(convs, turns, width)
    nodes = _nodes(blocks, width)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("below")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, ["depth", "below"], "left").fillna(0, ["n_children"])
    nodes = shared_table(
        nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "own": (F.col("n_convs") - 1) * F.col("bytes")}), "trie-counted"
    )
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("below").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.select("depth", "conv_id", "turn_id", "n_convs", "n_children", "name", "above")
    out = out.join(parents, ["depth", "above"], "left").join(_subtrees(blocks, nodes, width), ["depth", "conv_id"])
    out = out.join(_ends(blocks, convs, width, ends_per_piece), ["depth", "name"], "left")
    return out.select(
        "conv_id",
        "depth",
        "turn_id",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_bytes"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def of_conversations(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of conversations as they stand."""
    turns = shared_table(turn_ids(conversations), "trie-turns")
    return trie(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")), turns, width)


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    convs, turns = rebuilt(shared_table(turn_ids(conversations), "trie-turns"))
    nodes = trie(convs, turns)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256")


DIGEST_SQL = r"""
WITH t AS (
    SELECT conv_id, sha256(strlen(role) || ':' || role || text) AS id, strlen(text) AS bytes,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 16), sha256(strlen(role) || ':' || role || text)) - 1 AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), ids AS (SELECT DISTINCT conv_id FROM t),
-- CRC-32 bit by bit: 3988292384 is its reflected polynomial
c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
           xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
               lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h
    FROM ids
), r AS (
    SELECT c.conv_id, 0 AS own, t.pos, t.id, t.bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, t.id, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h
), s AS (
    SELECT conv_id, row_number() OVER w AS d, string_agg(id, '/') OVER w AS path, bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
), p AS (
    SELECT conv_id, d, path, bytes FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM ids
), nodes AS (
    SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
           CASE WHEN d > 1 THEN left(path, length(path) - 65) WHEN d = 1 THEN '' END AS above
    FROM p GROUP BY d, path
), kids AS (SELECT above, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above
), known AS (
    SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.above = nodes.path
), sums AS (
    SELECT p.path, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved
    FROM known n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.path
), ends AS (
    SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT * FROM p QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY path
)
SELECT k.conv_id, k.d AS depth, a.conv_id AS parent_conv_id, k.n_convs, k.n_children, sums.n_leaves, sums.saved AS saved_tokens,
       sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM known k JOIN sums ON sums.path = k.path LEFT JOIN nodes a ON a.path = k.above LEFT JOIN ends ON ends.path = k.path
"""
