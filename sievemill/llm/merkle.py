"""Merkle manifest of a table: one digest for all rows, and for each row the proof that it is in there.

Rows are leaves, ranked inside their group; sixteen consecutive nodes make one of the next level. Every
node is labelled with the interval ``[lo, hi)`` of leaf ranks it covers. A node of level k starts at a
multiple of 16^k, so a containment join on the bucket ``lo div 16^(k+1)`` attaches its parent, and the
parent's interval less the node's own holds its siblings. What remains of each group is a leaf of the
top tree. No key of any join holds more than sixteen rows, whatever the sizes of the groups.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lower_az, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows a sorted range should hold.
RANGE_ROWS = 500_000
#: Every so many rows (by the checksum of their id) are tampered with in `tampered`.
TAMPER = 5


def _bytes(column: Column) -> Column:
    return F.unhex(F.sha2(column.cast("binary"), 256))


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def field(column: Column) -> Column:
    """A value so that concatenated ones can't be mistaken for others: UTF-8 bytes, a colon, the value; a null is a dash."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: dict[str, Column]) -> Column:
    return _bytes(F.concat(*[field(c) for c in columns.values()]))


def group_key(group: Column) -> Column:
    """Bytes that sort a null first and strings by their UTF-8 bytes, and that differ where the groups do."""
    return F.coalesce(F.concat(F.lit(b"\1"), group.cast("string").cast("binary")), F.lit(b"\0"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``group, doc_id, leaf, other`` for every row; other is the digest of the tampered row, null for those left alone."""
    own = {c: F.col(c) for c in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    other = F.when(chosen, row_digest(own | {"text": lower_az(F.col("text"))}))
    return docs.select(group_key(F.col("source")).alias("group"), F.col("doc_id").cast("long").alias("doc_id"), row_digest(own).alias("leaf"), other.alias("other"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, nulls first) and ``size`` of their group, without a group in one task.

    The rows lie in sorted ranges, cut anywhere inside a group; what a range holds of a group starts at
    what the ranges before it hold. ``order`` should tell any two rows apart, so that no value fills a range.
    """
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    ranges = max(min(cores, ceil(n / 10_000)), ceil(n / RANGE_ROWS), 1)
    placed = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order).withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed, "ranges").withColumn("range", F.shiftright("place", 33))
    held = placed.groupBy(group, "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    upto = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(group, "range", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    return placed.join(held, [group, "range"]).select(*rows.columns, (F.col("place") + F.col("shift")).alias("rank"), "size")


def _up(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of level + 1 over nodes of ``level``: ``group, bucket, lo, hi, size, digest, children``."""
    span = FANOUT ** (level + 1)
    inner = nodes.where(F.col("size") > FANOUT**level).withColumn("bucket", F.expr(f"lo div {span}"))
    children = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
    grouped = inner.groupBy("group", "bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("size").alias("size"), children.alias("children"))
    digest = _bytes(F.concat_ws("", F.transform("children", lambda x: _hex(x["digest"]))))
    return grouped.withColumn("digest", digest)


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """Stored nodes by level, from the leaves (``group, lo, hi, size, digest``) to where every group has one node."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    levels = [leaves]
    while FANOUT ** (len(levels) - 1) < most:
        levels.append(stored(_up(levels[-1].select("group", "lo", "hi", "size", "digest"), len(levels) - 1), f"level-{len(levels)}"))
    return levels


def _joined(digests: Column) -> Column:
    """Digests one after the other, as bytes."""
    return F.unhex(F.concat_ws("", F.transform(digests, lambda x: F.hex(x["digest"]))))


def _attached(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """Nodes of a level with their parent's way to the root, before which their own siblings are put."""
    span = FANOUT ** (level + 1)
    above = parents.select(F.col("group").alias("__g"), F.col("bucket").alias("__b"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("children").alias("__children"), F.col("path").alias("__path"), "subroot")
    inside = (F.col("group") == F.col("__g")) & (F.expr(f"lo div {span}") == F.col("__b")) & (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi"))
    left = F.filter("__children", lambda x: x["hi"] <= F.col("lo"))
    right = F.filter("__children", lambda x: x["lo"] >= F.col("hi"))
    step = F.struct(_joined(left).alias("left"), _joined(right).alias("right"))
    return nodes.join(above, inside).select(*nodes.columns, "subroot", F.concat(F.array(step), F.col("__path")).alias("path"))


def _with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``subroot`` and ``path``: for each level up to the root, the siblings left and right. tops: ``group, subroot, path`` of what remains of each group."""
    above = None
    for level in reversed(range(len(levels))):
        nodes = levels[level]
        single = nodes.where(F.col("size") <= FANOUT**level).join(tops, "group").select(*nodes.columns, "subroot", "path")
        if above is None:
            above = single
        else:
            above = single.unionByName(_attached(nodes.where(F.col("size") > FANOUT**level), above, level))
    return above


def _remaining(levels: list[DataFrame]) -> DataFrame:
    """``group, digest`` of the one node that remains of each group."""
    found = []
    for level, nodes in enumerate(levels):
        last = nodes.where(F.col("size") <= FANOUT**level)
        found.append(last.where(F.col("size") > FANOUT ** (level - 1) if level else F.lit(True)).select("group", "digest"))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda digest, step: _bytes(F.concat(_hex(step["left"]), _hex(digest), _hex(step["right"]))))


@dataclass
class Manifest:
    """levels, top_levels: nodes with their intervals, of the groups and of the tree over them. rows: the leaves, each with its siblings up to the root. root: the digest of all, None for an empty table."""

    levels: list[DataFrame]
    top_levels: list[DataFrame]
    rows: DataFrame
    root: bytes | None

    def nodes(self) -> DataFrame:
        """``tree, group, level, lo, hi, digest``: the manifest as one table; tree is 0 for those of the groups, 1 for the top. Leaf ranks in ``[lo, hi)`` lie below a node."""
        parts = [
            nodes.select(F.lit(tree).alias("tree"), "group", F.lit(level).alias("level"), "lo", "hi", _hex(F.col("digest")).alias("digest"))
            for tree, levels in enumerate((self.levels, self.top_levels))
            for level, nodes in enumerate(levels)
        ]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return every


def manifest(leaves: DataFrame, order: list[str], digest: str = "leaf") -> Manifest:
    """Trees over ``leaves``: ``group`` (see `group_key`), the columns of ``order``, ``digest`` (bytes) and any others.

    Leaves of a group ascend by ``order``, then by digest; equal ones are interchangeable. Each level
    is stored, so what a lost executor held is made again from the level below.
    """
    # The number of the row spreads rows that are equal in all else over the ranges.
    rows = stored(leaves.withColumn("__row", F.monotonically_increasing_id()), "leaves")
    rows = ranked(rows, "group", [*order, digest, "__row"]).drop("__row")
    rows = stored(rows.withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1).drop("rank").withColumnRenamed(digest, "digest"), "ranked")
    levels = _levels(rows)
    groups = stored(_remaining(levels).withColumn("all", F.lit(b"\0")), "subroots")
    top = ranked(groups, "all", ["group"]).select(F.col("all").alias("group"), F.col("group").alias("of"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "size", "digest")
    top_levels = _levels(stored(top, "top"))
    found = _remaining(top_levels).first()
    root = bytes(found["digest"]) if found else None
    nowhere = F.array().cast("array<struct<left:binary,right:binary>>")
    tops = groups.sparkSession.range(1).select(F.lit(b"\0").alias("group"), F.lit(root).cast("binary").alias("subroot"), nowhere.alias("path"))
    ways = _with_paths(top_levels, tops).select(F.col("of").alias("group"), F.col("digest").alias("subroot"), "path")
    return Manifest(levels, top_levels, _with_paths(levels, stored(ways, "ways")), root)


def verified_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    Leaves cover id, source, language, length and text, grouped by source. The root is folded anew from each
    row's siblings and the row as it now is, where every fifth row has had its text lower-cased (A-Z).
    Rows with a null id come first in their source and are never tampered with; a null source is a
    group, the first one. Repeated rows are leaves of their own. Other columns play no part. An empty table gives an empty one.
    """
    made = manifest(document_leaves(docs), ["doc_id"])
    root = _hex(F.lit(made.root).cast("binary"))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(_hex(s["left"]), _hex(s["right"])))).cast("binary"), 256)
    folded = _hex(fold(F.coalesce("other", "digest"), F.col("path")))
    rows = made.rows.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
