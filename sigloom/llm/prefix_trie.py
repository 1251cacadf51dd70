"""Conversation prefix trie: every shared prefix of turns as a node, by ROLLUP over positional turn columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .shared import split_join, stored

#: Positions in one block of columns.
BLOCK = 8
#: Bytes of joined ids in one row before they are hashed in order.
CHUNK = 1 << 16
#: The width of a running sum of 64-bit hashes.
SUM = "decimal(38,0)"


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that stand for (role, text); null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def numbered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, pos, id, chars): turns numbered from 1, a null turn first; ties go by turn id. Texts stay behind."""
    role, text = F.col(role_col), F.col(text_col)
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        turn_id(role, text).alias("id"),
        F.char_length(F.coalesce(text, F.lit(""))).alias("chars"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "id", "chars")


def shared_openings(numbered: DataFrame, family: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, part, pos, id, chars): every conversation with its first h turns taken from its family's first.

    Conversation c takes the first h = crc32(c) % (most + 1) turns of
    conversation c - c % family (all, if it has fewer; none, if there is no
    such conversation; % keeps the sign, as in SQL), then its own turns after the first h. One row without
    an id stands for each conversation, so that turnless ones stay. A null
    conversation keeps its own turns.
    """
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1), F.lit(0))
    talks = numbered.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("first"))
    openings = numbered.where((F.col("conv_id") % family == 0) & (F.col("pos") <= most))
    openings = openings.select(F.col("conv_id").alias("first"), "pos", "id", "chars")
    heads = talks.join(openings, "first").where("pos <= h").select("conv_id", F.lit(1).alias("part"), "pos", "id", "chars")
    own = numbered.where(F.col("pos") > h).select("conv_id", F.lit(2).alias("part"), "pos", "id", "chars")
    none = talks.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).alias("chars"))
    return none.unionByName(heads).unionByName(own)


def plain_talks(numbered: DataFrame) -> DataFrame:
    """(conv_id, part, pos, id, chars): every conversation as it is."""
    none = numbered.where("pos = 1").select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).alias("chars"))
    return none.unionByName(numbered.select("conv_id", F.lit(1).alias("part"), "pos", "id", "chars"))


def node_key(depth: Column, a: Column, b: Column) -> Column:
    """The key of a node: its depth and two sums of hashes of (position, turn id) over its path."""
    return F.unhex(F.md5(F.concat_ws("/", depth.cast("string"), a.cast("string"), b.cast("string"))))


def path_hash(seed: int, pos: Column, ident: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos.cast("int"), ident).cast("decimal(20,0)")


def column_blocks(talks: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Conversations as stored rows of ``block`` turn columns, and one row per conversation.

    A block's key is the node that the blocks before it lead to: (block, a,
    b), sums over the path so far. Both come from one pass over a
    conversation's sorted turns, whose running sums need no more memory for a
    long one. Blocks: conv_id, block, a, b, before (code points before it),
    t1.. (struct of turn id and code points). Conversations: conv_id, total,
    node (where it ends).
    """
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = talks.select("*", (F.row_number().over(order) - 1).alias("depth"))
    zero = F.lit(0).cast("decimal(20,0)")
    at = {s: F.when(F.col("depth") == 0, zero).otherwise(path_hash(n, F.col("depth"), F.col("id"))) for n, s in ((1, "ha"), (2, "hb"))}
    rows = rows.withColumns(at)
    rows = rows.select(
        "conv_id", "depth", "id", "chars",
        F.sum("ha").over(so_far).cast(SUM).alias("a"), F.sum("hb").over(so_far).cast(SUM).alias("b"),
        F.sum(F.col("chars").cast("bigint")).over(so_far).alias("upto"), "ha", "hb",
    )
    rows = rows.withColumn("block", F.expr(f"greatest(depth - 1, 0) div {block}").cast("int"))
    # A block's first row tells what came before it; the conversation's own row does so for the first block.
    opens = (F.col("depth") == 0) | ((F.col("block") > 0) & (F.col("depth") == F.col("block") * block + 1))
    first = lambda c: F.max(F.when(opens, c))
    slots = [
        F.max(F.when(F.col("depth") == F.col("block") * block + i, F.struct("id", "chars"))).alias(f"t{i}")
        for i in range(1, block + 1)
    ]
    blocks = rows.groupBy("conv_id", "block").agg(
        first((F.col("a") - F.col("ha")).cast(SUM)).alias("a"),
        first((F.col("b") - F.col("hb")).cast(SUM)).alias("b"),
        first(F.col("upto") - F.col("chars")).alias("before"),
        *slots,
        F.max(F.struct("depth", rows["a"], rows["b"], "upto")).alias("e"),
    )
    blocks = stored(blocks)
    ends = blocks.groupBy("conv_id").agg(F.max("e").alias("e"))
    ends = ends.select("conv_id", F.col("e.upto").alias("total"), node_key(F.col("e.depth"), F.col("e.a"), F.col("e.b")).alias("node"))
    return blocks.drop("e"), stored(ends)


def prefix_rollup(blocks: DataFrame, measures: dict[str, str], block: int = BLOCK) -> DataFrame:
    """One row per node of depth 0 and more: node, parent, depth, chars (of its last turn), before, and ``measures``.

    ROLLUP aggregates all prefixes of a block's columns together; grouping_id
    tells their length. A prefix that a conversation does not reach has a null
    column that is not rolled up; it is no node.
    """
    names = [f"t{i}" for i in range(1, block + 1)]
    sums = ", ".join(f"{sql} AS {name}" for name, sql in measures.items())
    spark = blocks.sparkSession
    rolled = spark.sql(
        f"""
        SELECT block, a, b, {", ".join(names)}, min(before) AS before, {sums}, {block} - bit_count(grouping_id()) AS level
        FROM {{blocks}} GROUP BY block, a, b, ROLLUP({", ".join(names)})
        """,
        blocks=blocks,
    )
    last = F.element_at(F.array(*names), F.greatest("level", F.lit(1)))
    rolled = rolled.where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull()))
    depth = F.col("block") * block + F.col("level")

    def path(name: str, seed: int, upto: Column) -> Column:
        parts = [F.when(upto >= i, path_hash(seed, F.col("block") * block + i, F.col(f"t{i}.id"))).otherwise(F.lit(0)) for i in range(1, block + 1)]
        out = F.col(name)
        for p in parts:
            out = (out + p).cast(SUM)
        return out

    up = F.col("level") - 1
    key = lambda d, upto: node_key(d, path("a", 1, upto), path("b", 2, upto))
    earlier = F.col("before")
    for i in range(1, block):
        earlier = earlier + F.when(up >= i, F.col(f"t{i}.chars")).otherwise(F.lit(0))
    return rolled.select(
        key(depth, F.col("level")).alias("node"),
        F.when(depth > 0, key(depth - 1, up)).alias("parent"),
        depth.alias("depth"),
        F.when(F.col("level") > 0, last["chars"]).otherwise(F.lit(0)).cast("bigint").alias("chars"),
        earlier.alias("before"),
        *measures,
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sorted (node, id) to rows of joined ids, CHUNK bytes each at most where a node has many."""
    part = TaskContext.get().partitionId()
    node, ids, size, number = None, [], 0, 0

    def out():
        return pa.record_batch(
            [pa.array([node], pa.binary()), pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([",".join(ids)])],
            ["node", "part", "number", "ids"],
        )

    for batch in batches:
        done = []
        for key, ident in zip(batch.column("node").to_pylist(), batch.column("ident").to_pylist()):
            if ids and (key != node or size > CHUNK):
                done.append(out())
                ids, size, number = [], 0, number + 1
            node = key
            ids.append(ident)
            size += len(ident) + 1
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if ids:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sorted (node, part, number, ids) to one SHA-256 per node, over the ids joined by commas."""
    node, state = None, None
    for batch in batches:
        keys, values = [], []
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if state is None or key != node:
                if state is not None:
                    keys.append(node)
                    values.append(state.hexdigest())
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(values, pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the decimal ids of the conversations that end at each node, ascending, comma-joined.

    Ids are sorted and joined in many tasks, also those of one node; a hash
    runs over a node's joined pieces in order and holds one at a time. A null
    id comes first and is written ``null``.
    """
    named = ends.select("node", "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("ident"))
    ordered = named.repartitionByRange("node", F.col("conv_id").asc_nulls_first()).sortWithinPartitions("node", F.col("conv_id").asc_nulls_first())
    pieces = stored(ordered.mapInArrow(_joined, "node binary, part int, number bigint, ids string"))
    return pieces.repartition("node").sortWithinPartitions("node", "part", "number").mapInArrow(_digests, "node binary, ends_sha256 string")


def prefix_trie(talks: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct sequence of first turns: its members, tree shape and what sharing it saves.

    ``talks`` has (conv_id, part, pos, id, chars), as ``plain_talks`` or
    ``shared_openings`` give it. The columns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Sums over a subtree need no walk. Of the conversations through a node all
    but one count their characters from the node on as saved, and each node is
    counted once, by its smallest member: from the depth where a conversation
    is the smallest member on, it stays so. So one ROLLUP finds smallest
    members, and a second one sums what each conversation owns.

    A conversation without turns is a member of the root. Equal conversations
    end at one node. Null ids are one conversation, which is the smallest
    member only where it is alone. No conversations give no rows. Keys of
    nodes are 128-bit hashes.
    """
    blocks, ends = column_blocks(talks, block)
    first = stored(prefix_rollup(blocks, {"conv_id": "min(conv_id)"}, block))
    children = stored(first.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n")))
    branching = children.select(F.col("parent").alias("node"), F.col("n").alias("n_children"))
    first = stored(first.join(branching, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # What each conversation owns: the nodes from the first of which it is the smallest member, and the leaf at its end.
    mine = first.groupBy(F.col("conv_id").alias("__conv")).agg(
        F.min(F.struct("depth", "before"))["before"].alias("owned_from"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    worth = ends.join(mine, ends["conv_id"].eqNullSafe(mine["__conv"]), "left").select(
        F.col("conv_id").alias("__conv"),
        "total",
        F.when(F.col("owned_from").isNotNull(), F.col("total") - F.col("owned_from")).otherwise(F.lit(0)).alias("owned"),
        F.coalesce("leaves", F.lit(0)).alias("leaves"),
    )
    valued = blocks.join(worth, blocks["conv_id"].eqNullSafe(worth["__conv"])).drop("__conv")
    lowest = "coalesce(min_by({0}, conv_id), sum({0}))"
    measures = {
        "conv_id": "min(conv_id)", "n_convs": "count(*)", "n_leaves": "sum(leaves)", "total": "sum(total)", "owned": "sum(owned)",
        "lowest_total": lowest.format("total"), "lowest_owned": lowest.format("owned"),
    }
    nodes = prefix_rollup(valued, measures, block)
    all_text = F.col("total") - F.col("n_convs") * F.col("before")
    once = F.col("owned") - F.col("lowest_owned") + F.col("lowest_total") - F.col("before")
    nodes = nodes.select("node", "parent", "depth", "conv_id", "n_convs", "n_leaves", (all_text - once).alias("saved_tokens"))
    nodes = stored(nodes.join(branching, "node", "left").join(end_hashes(ends), "node", "left"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = split_join(nodes, parents, "parent", children, F.col("node"))
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    return nodes.select(
        "conv_id", whole("depth"), "parent_conv_id", whole("n_convs"), F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        whole("n_leaves"), whole("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
