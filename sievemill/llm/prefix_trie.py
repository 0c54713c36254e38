"""Prefix trie of conversations: every different beginning, how many share it, and what sharing it saves.

A turn becomes a big-endian id of fixed width, a conversation the bytes of its ids. Different
conversations are dealt by ranges of these bytes and each range goes into one adaptive radix tree. Only
prefixes of a range's first and last key can lie in other ranges too; what is known of those is
combined, and sums over their subtrees are made by pointer doubling. Nothing else leaves its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .radix_tree import RadixTree, Value, prefix_ids, told
from .shared import arrow_map, join_keyed, stored

#: Bytes of a turn's id: so many of the digest of its role and text.
WIDTH = 16
#: Bytes of keys in one tree.
TREE_BYTES = 2 << 20
#: Own turns are put after so many of the first conversation of a hundred, by the checksum of the id.
BORROWED, HUNDRED = 6, 100
#: Ids of members that are joined to one piece of text.
PIECE_IDS = 4_096

NODE = (
    "id binary, parent binary, depth long, size long, members long, least long, children long, leaves long, saved long,"
    " edge boolean, inner_children long, inner_leaves long, inner_saved long, above long"
)


def turn_id(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH))


def turn_lists(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns (``id, size``) in order. Nulls come first, turns of one number go by their ids; rows without a conversation are in none."""
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "id", "size")))
    return rows.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Every conversation with its first turns replaced: as many as the checksum of its id says are those of the first conversation of its hundred, if there is one."""
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    bases = lists.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, BORROWED - 1).alias("first"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("int")
    turns = F.concat(F.coalesce(F.slice("first", F.lit(1), n), F.slice("turns", 1, 0)), F.slice("turns", n + 1, F.size("turns")))
    return lists.withColumn("base", base).join(bases, "base", "left").select("conv_id", turns.alias("turns"))


def with_keys(lists: DataFrame) -> DataFrame:
    """``conv_id, key, sizes``: the ids one after the other, and the length of every turn's text."""
    key = F.unhex(F.concat_ws("", F.transform("turns", lambda t: F.hex(t["id"]))))
    return lists.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"].cast("long")).alias("sizes"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, first, last = RadixTree(), None, None
    for batch in batches:
        keys, members, least, sizes = (batch.column(k) for k in range(4))
        for key, n, smallest, size in zip(keys.to_pylist(), members.to_pylist(), least.to_pylist(), sizes.to_pylist()):
            tree.insert(key, Value(n, smallest, size))
            first = key if first is None or key < first else first
            last = key if last is None or key > last else last
    if first is None:
        return
    edge = frozenset(prefix_ids(first, WIDTH)) | frozenset(prefix_ids(last, WIDTH))
    rows = list(told(tree, WIDTH, edge))
    smallest = {row.id: row.least for row in rows if row.children and not row.edge}
    names = [f.split()[0] for f in NODE.split(", ")]
    kinds = [{"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in NODE.split(", ")]
    for at in range(0, len(rows), 20_000):
        columns = [*zip(*rows[at : at + 20_000])]
        columns.append([smallest.get(p) for p in columns[1]])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _subtree_sums(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of ``columns`` over each node and all below it, by doubling how far up a node's sum is handed. nodes: ``id, parent, depth`` and the columns; a handful to each range."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = nodes.select("id", F.col("parent").alias("up"), *columns)
    span = 1
    while span <= deepest:
        given = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"{c}_more") for c in columns])
        further = sums.select(F.col("id").alias("up"), F.col("up").alias("next"))
        sums = sums.join(given, "id", "left").join(further, "up", "left")
        sums = stored(sums.select("id", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in columns]), "doubled")
        span *= 2
    return sums.select("id", *columns)


def trie_nodes(keyed: DataFrame) -> DataFrame:
    """``id, parent, depth, least, above, members, children, leaves, saved`` of every different prefix of the keys of ``conv_id, key, sizes``; above: the parent's smallest member."""
    spark = keyed.sparkSession
    keys = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"), F.first("sizes").alias("sizes")), "keys")
    total, n = keys.agg(F.sum(F.length("key")), F.count(F.lit(1))).first()
    ranges = max(ceil((total or 0) / TREE_BYTES), min(spark.sparkContext.defaultParallelism, ceil(n / 1_000)), 1)
    found = stored(arrow_map(keys.repartitionByRange(ranges, "key"), _trees, NODE), "trees")
    done = ["id", "parent", "depth", "least", "above", "members", "children", "leaves", "saved"]

    merged = found.where("edge").groupBy("id").agg(
        *[F.first(c).alias(c) for c in ("parent", "depth", "size", "children", "leaves", "saved")],
        F.sum("members").alias("members"), F.min("least").alias("least"), F.count(F.lit(1)).alias("ranges"),
        *[F.sum(f"inner_{c}").alias(f"inner_{c}") for c in ("children", "leaves", "saved")],
    )
    merged = stored(merged, "edges")
    alone, shared = merged.where("ranges = 1"), merged.where("ranges > 1")
    lone = F.col("ranges") == 1
    kids = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("kids"), F.sum(F.when(lone, F.col("leaves"))).alias("kid_leaves"), F.sum(F.when(lone, F.col("saved"))).alias("kid_saved")
    )
    own = shared.join(kids, "id", "left").withColumn("children", F.col("inner_children") + F.coalesce("kids", F.lit(0)))
    own = own.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("inner_leaves") + F.coalesce("kid_leaves", F.lit(0))))
    own = stored(own.withColumn("saved", F.col("inner_saved") + F.coalesce("kid_saved", F.lit(0)) + (F.col("members") - 1) * F.col("size")), "shared")
    whole = own.drop("leaves", "saved").join(_subtree_sums(own, ["leaves", "saved"]), "id")

    every = found.where("NOT edge").select(done)
    for part in (alone, whole):
        every = every.unionByName(part.withColumn("above", F.lit(None).cast("long")).select(done))
    # A parent on the edge is known now only; most nodes of a large table have one inside their range.
    parents = merged.select(F.col("id").alias("parent"), F.col("least").alias("edge_least"), F.col("members").alias("weight"))
    rows = join_keyed(every.where("above IS NULL"), parents, "parent", "weight", n or 0, "left")
    return every.where("above IS NOT NULL").unionByName(rows.withColumn("above", F.col("edge_least")).select(done))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, member) rows as texts of members, each of one node."""
    names, node, members = ["id", "first", "text"], None, []
    for batch in batches:
        out: list[tuple] = []
        for at, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if members and (at != node or len(members) == PIECE_IDS):
                out.append((node, members[0], ",".join(map(str, members))))
                members = []
            node = at
            members.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.int64(), pa.string()))], names)
    if members:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([members[0]], pa.int64()), pa.array([",".join(map(str, members))])], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest over all the texts of a node, which come in order; never more than one of them is held."""
    node, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for at, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if at != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["id", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])


def member_digests(keyed: DataFrame) -> DataFrame:
    """``id, ends_sha256``: for each prefix that is a whole conversation, the digest of those it is, ascending and comma-joined.

    Members of any number of copies are sorted by ranges and joined to texts of thousands of ids, so
    the task that reads a node's texts in order has one row for each of them.
    """
    rows = stored(keyed.select(F.unhex(F.sha2("key", 256)).alias("id"), "conv_id"), "ends")
    ranges = max(min(keyed.sparkSession.sparkContext.defaultParallelism, 64), ceil(rows.count() / 500_000))
    pieces = arrow_map(rows.repartitionByRange(ranges, "id", "conv_id").sortWithinPartitions("id", "conv_id"), _pieces, "id binary, first long, text string")
    return arrow_map(pieces.repartition("id").sortWithinPartitions("id", "first"), _digests, "id binary, ends_sha256 string")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for every node of the rebuilt conversations.

    turns: ``conv_id, turn, role, text``. A null turn is the first, a null role or text is empty, turns
    of one number go by the digest of role and text; repeated rows are turns of their own. Rows with a
    null conv_id belong to no conversation. Other columns play no part. An empty table has no node. A
    conversation's ids (16 bytes a turn) are one value, as a text is.
    """
    keyed = stored(with_keys(rebuilt(turn_lists(turns))), "conversations")
    nodes = trie_nodes(keyed).join(member_digests(keyed), "id", "left")
    return nodes.select(
        F.col("least").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
