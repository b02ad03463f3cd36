"""The trie of conversation prefixes, aggregated by SQL ROLLUP over columns of turns.

A conversation is laid out in blocks of ``WIDTH`` turn columns. One ROLLUP over the columns
of a block aggregates all its prefixes together, and grouping_id tells their length; the
next block of a longer conversation is keyed by the node in which the block before it
ends. A node is named by its depth and 128 bits: the xor of hashes of (position, role, text)
along its path, so that the name of a parent follows from its child's last turn.

What concerns whole subtrees is a sum over members. A conversation owns the nodes of which it
is the smallest member, always a tail of its path, so (n_convs - 1) * words summed over a
subtree is the sum, over the members, of the words on their paths that they do not own; and
the childless nodes in it are the members that own one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.llm.common import Scratch, count_words, split_heavy

#: Turn columns of a block.
WIDTH = 8
#: Bytes of ids that one row of an ends list holds.
CHUNK = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, role, text): turns from 1 by turn, null first, and a row of position 0 for each conversation.

    Equal turns go by role, then by text; repeated rows stay. Null role and text are
    empty. Rows without a conversation id are left out.
    """
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    ).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = rows.select("conv_id", F.row_number().over(order).alias("position"), "role", "text")
    tops = rows.select("conv_id").distinct().select("conv_id", F.lit(0).alias("position"), F.lit("").alias("role"), F.lit("").alias("text"))
    return turns.union(tops)


def share_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """``numbered`` turns with the first h turns of a conversation taken from the first of its group.

    h is crc32 of the decimal id modulo ``most``, the first of c's group is c - c % group.
    If that is shorter all its turns are taken, if it is absent none; c's own turns after
    its first h follow.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    heads = turns.filter((F.col("position") >= 1) & (F.col("position") < most)).withColumnRenamed("conv_id", "first")
    lengths = heads.groupBy("first").agg(F.count("*").alias("there"))
    ids = turns.filter("position = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("first"))
    taken = ids.join(heads, "first").filter("position <= h").select("conv_id", "position", "role", "text")
    moved = ids.join(lengths, "first", "left").select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    own = turns.join(moved, "conv_id").filter("position = 0 or position > h")
    place = F.when(F.col("position") == 0, 0).otherwise(F.col("position") - F.col("h") + F.col("taken")).cast("int")
    return taken.union(own.select("conv_id", place, "role", "text"))


def turn_blocks(turns: DataFrame, width: int) -> DataFrame:
    """A row for each conversation and block of ``width`` turns.

    (conv_id, block, length, before: words ahead of the block, p1, p2: the node ahead of
    it, t1 ... : struct of two hashes and the words of a turn, null beyond the end).
    """
    of_turn = lambda seed: F.when(F.col("position") > 0, F.xxhash64(F.lit(seed), "position", "role", "text")).otherwise(0)
    path = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    words = turns.select("conv_id", "position", of_turn(1).alias("a1"), of_turn(2).alias("a2"), count_words(F.col("text")).alias("w"))
    run = words.select(
        "*",
        F.bit_xor("a1").over(path).bitwiseXOR(F.col("a1")).alias("b1"),
        F.bit_xor("a2").over(path).bitwiseXOR(F.col("a2")).alias("b2"),
        (F.sum("w").over(path) - F.col("w")).alias("upto"),
        F.max("position").over(whole).alias("length"),
    )
    at = F.greatest(F.col("position") - 1, F.lit(0))
    slot = F.when(F.col("position") > 0, at % width + 1)
    placed = run.withColumn("block", F.floor(at / width).cast("int")).withColumn("slot", slot)
    first = lambda c: F.coalesce(F.max(F.when(F.col("slot") == 1, F.col(c))), F.lit(0))
    return placed.groupBy("conv_id", "block").agg(
        F.max("length").alias("length"),
        first("upto").alias("before"),
        first("b1").alias("p1"),
        first("b2").alias("p2"),
        *[F.max(F.when(F.col("slot") == i, F.struct("a1", "a2", "w"))).alias(f"t{i}") for i in range(1, width + 1)],
    )


def rolled(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """One row for each node: level in its block, depth, k1, k2 its name, u1, u2 its parent's, and the aggregates ``sums``."""
    turns = [f"t{i}" for i in range(1, width + 1)]
    nodes = blocks.sparkSession.sql(
        f"select block, p1, p2, {', '.join(turns)}, {width} - bit_count(grouping_id()) as level, {sums} "
        f"from {{blocks}} group by block, p1, p2, rollup({', '.join(turns)})",
        blocks=blocks,
    )
    last = F.element_at(F.array(*turns), F.greatest(F.col("level"), F.lit(1)).cast("int"))
    name = lambda k: _xor(F.col(f"p{k}"), *[F.coalesce(F.col(f"{t}.a{k}"), F.lit(0)) for t in turns])
    # a level beyond a conversation's end, and the node ahead of a later block, which is known
    real = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull())
    return (
        nodes.withColumn("last", last)
        .filter(real)
        .withColumns({"depth": (F.col("block") * width + F.col("level")).cast("long"), "k1": name(1), "k2": name(2)})
        .withColumns({"u1": F.col("k1").bitwiseXOR(F.coalesce("last.a1", F.lit(0))), "u2": F.col("k2").bitwiseXOR(F.coalesce("last.a2", F.lit(0)))})
        .drop("block", "p1", "p2", "last", *turns)
    )


def _xor(first: Column, *rest: Column) -> Column:
    for x in rest:
        first = first.bitwiseXOR(x)
    return first


def join_ids(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id to rows of comma-joined ids, of CHUNK bytes or little more."""
    node, ids, size, first, ready, kind = None, [], 0, None, [], None

    def flush() -> None:
        if ids:
            ready.append((*node, first, ",".join(ids)))

    for batch in rows:
        kind = batch.schema.field(3).type
        for k1, k2, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2, depth) != node or size > CHUNK:
                flush()
                node, ids, size, first = (k1, k2, depth), [], 0, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if ready:
            yield _batch(ready, kind)
            ready.clear()
    flush()
    if ready:
        yield _batch(ready, kind)


def _batch(ready: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*ready, strict=True))
    types = [pa.int64(), pa.int64(), pa.int64(), kind, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k1", "k2", "depth", "start", "ids"])


def hash_ids(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node from its rows of ids, sorted; only the running digest is kept."""
    node, digest, ready = None, None, []
    names = ["k1", "k2", "depth", "ends_sha256"]

    def packed() -> pa.RecordBatch:
        columns = list(zip(*ready, strict=True))
        ready.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names)

    for batch in rows:
        for k1, k2, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2, depth) == node:
                digest.update(b",")
            else:
                if node is not None:
                    ready.append((*node, digest.hexdigest()))
                node, digest = (k1, k2, depth), hashlib.sha256()
            digest.update(ids.encode())
        if ready:
            yield packed()
    if node is not None:
        ready.append((*node, digest.hexdigest()))
        yield packed()


def ends_hashes(blocks: DataFrame, width: int) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of the nodes in which conversations end.

    The ids are dealt out by ranges of node and id, so a node in which a third of all
    conversations end is sorted and joined to long rows by many tasks; what one task
    reads of it is only those rows, and its memory is one of them.
    """
    turns = [f"t{i}" for i in range(1, width + 1)]
    name = lambda k: _xor(F.col(f"p{k}"), *[F.coalesce(F.col(f"{t}.a{k}"), F.lit(0)) for t in turns])
    last = blocks.filter(F.col("block") == F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / width))
    ends = last.select(name(1).alias("k1"), name(2).alias("k2"), F.col("length").cast("long").alias("depth"), "conv_id")
    keys = ["k1", "k2", "depth"]
    kind = dict(ends.dtypes)["conv_id"]
    joined = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(join_ids, f"k1 long, k2 long, depth long, start {kind}, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "start").mapInArrow(hash_ids, "k1 long, k2 long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each node of the trie over ``numbered`` turns, from the textless root.

    conv_id is the node's smallest member, n_convs its members, parent_conv_id the smallest
    member of its parent (null for the root), n_children its children, n_leaves the
    childless nodes in its subtree, itself included, saved_tokens the words of the last
    texts in its subtree, each times the node's members less one, ends_sha256 the hash of
    the ids that end in it. A conversation without turns ends in the root; without any
    conversation there is no node.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    blocks = scratch.table(turn_blocks(turns, width), "blocks")
    shallow = rolled(blocks, width, "min(conv_id) as conv_id, max(length) as longest")
    owners = shallow.groupBy("conv_id").agg(F.min("depth").alias("owned"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))

    # words on a conversation's path ahead of the nodes it owns; ``width`` sums, of which a node takes that of its level
    place = lambda i: F.col("block") * width + i
    words = [F.coalesce(F.col(f"t{i}.w"), F.lit(0)) for i in range(1, width + 1)]
    owned = blocks.join(owners, "conv_id", "left").withColumns({"owned": F.coalesce("owned", F.col("length") + 1), "leaf": F.coalesce("leaf", F.lit(0))})
    ahead = sum((F.when(place(i) < F.col("owned"), w).otherwise(0) for i, w in enumerate(words, 1)), F.lit(0))
    owned = owned.withColumn("ahead", F.sum(ahead).over(Window.partitionBy("conv_id")))
    saved, upto = {"x0": F.col("ahead")}, F.col("before")
    for i, w in enumerate(words, 1):
        saved[f"x{i}"] = F.greatest(F.col("ahead") - upto, F.lit(0))
        upto = upto + w
    sums = ", ".join(f"sum(x{i}) as x{i}" for i in range(width + 1))
    nodes = rolled(owned.withColumns(saved), width, f"min(struct(conv_id, owned)) as m, count(*) as n_convs, sum(leaf) as n_leaves, {sums}")
    picked = F.element_at(F.array(*[f"x{i}" for i in range(width + 1)]), (F.col("level") + 1).cast("int"))
    nodes = nodes.select("k1", "k2", "depth", "u1", "u2", F.col("m.conv_id").alias("conv_id"), (F.col("m.owned") == F.col("depth")).alias("branch"), "n_convs", "n_leaves", picked.alias("saved_tokens"))
    nodes = scratch.table(nodes, "nodes")

    children = nodes.filter("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    keys = ["k1", "k2", "depth"]
    nodes = scratch.table(nodes.join(children, keys, "left").fillna(0, ["n_children"]).join(ends_hashes(blocks, width), keys, "left"), "counted")

    # only where a conversation's own nodes begin has the parent another smallest member
    parents = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("children_there"))
    heavy, light = (part.drop("children_there") for part in split_heavy(parents, "children_there"))
    up = ["u1", "u2", "depth"]
    begun = nodes.filter("branch and depth > 0")
    parts = [
        nodes.filter("not branch or depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))),
        begun.join(F.broadcast(heavy), up),
        begun.join(F.broadcast(heavy.select(*up)), up, "left_anti").join(light, up),
    ]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = parts[0].select(columns).union(parts[1].select(columns)).union(parts[2].select(columns))
    return out.fillna(NOTHING, ["ends_sha256"])
