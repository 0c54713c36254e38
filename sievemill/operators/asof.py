"""As-of joins: each row with the latest earlier row of its key, whatever share of the rows a key has."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a range.
RANGE_ROWS = 250_000


def range_count(rows: DataFrame, least_rows: int = 5_000) -> int:
    """How many ranges stored rows need: so that none holds much more than `RANGE_ROWS`, and no more than the cores while ``least_rows`` aren't there for each."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return max(ceil(n / RANGE_ROWS), min(cores, ceil(n / least_rows)), 1)


def as_of(rows: DataFrame, writes: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """``rows`` with a struct ``latest``: the other columns of the latest row of ``writes`` with their key before their time, null if there is none.

    Before means earlier; of writes at the same time the one that is last by ``order`` (columns of
    writes) counts. Rows whose key or time is null find nothing, such writes aren't found, and no row is
    lost or doubled. Both sides are laid in one order of key and time and dealt by ranges of it, cut
    anywhere; what a range begins with comes from the ranges before, one row for each range of a key.
    """
    carried = [c for c in writes.columns if c != key]
    found = writes.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    left = rows.select(F.col(key).alias("key"), F.col(time).alias("at"), F.lit(0).alias("kind"), F.struct(*rows.columns).alias("row"), F.lit(None).cast(f"struct<{_fields(writes, order)}>").alias("order"), F.lit(None).cast(f"struct<{_fields(writes, carried)}>").alias("write"))
    right = found.select(F.col(key).alias("key"), F.col(time).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.struct(*order).alias("order"), F.struct(*carried).alias("write"))
    aside = left.where("key IS NULL OR at IS NULL").select(*[F.col("row")[c].alias(c) for c in rows.columns], F.col("write").alias("latest"))
    laid = left.where("key IS NOT NULL AND at IS NOT NULL").unionByName(right)
    # The number of a row tells apart rows that are equal in all else, so that ranges can be cut between them.
    laid = stored(laid.withColumn("number", F.monotonically_increasing_id()), "as-of")
    ranged = laid.repartitionByRange(range_count(laid), "key", "at", "kind", "number").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    sort = [F.col("at"), F.col("kind"), F.col("order"), F.col("number")]
    inside = Window.partitionBy("key", "part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    last = ranged.groupBy("key", "part").agg(F.max(F.when(F.col("kind") == 1, F.struct("at", "order", "number", "write"))).alias("last"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("key", "part", F.max("last").over(before)["write"].alias("carried"))
    near = ranged.withColumn("near", F.last(F.when(F.col("kind") == 1, F.col("write")), ignorenulls=True).over(inside))
    met = near.where("kind = 0").select("key", "part", "row", "near").join(carry, ["key", "part"])
    joined = met.select(*[F.col("row")[c].alias(c) for c in rows.columns], F.coalesce("near", "carried").alias("latest"))
    return joined.unionByName(aside)


def _fields(df: DataFrame, names: list[str]) -> str:
    return ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in names)


def text_key(text: Column) -> Column:
    """A digest of a text, as key in place of the whole of it."""
    return F.unhex(F.sha2(text.cast("binary"), 256))
