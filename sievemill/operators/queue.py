"""Translation rounds: deadline, hard timeout, silent fall-back, poisoned cache, archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .asof import as_of, range_count, text_key

#: A round must be over after so many seconds; the engine gives up after so many. Both limits still count as in time.
ROUND_SECONDS, ENGINE_SECONDS = 110, 120


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def round_status(rounds: DataFrame, soft: int = ROUND_SECONDS, hard: int = ENGINE_SECONDS) -> DataFrame:
    """Adds ``latency`` in seconds and ``status``: ok, at_risk or timed_out; a round that was never pushed has timed out."""
    taken = seconds(F.col("push_ts"), F.col("pull_ts"))
    status = F.when(taken <= soft, "ok").when(taken <= hard, "at_risk").otherwise("timed_out")
    return rounds.withColumn("latency", taken).withColumn("status", status)


def pair_rounds(pulls: DataFrame, pushes: DataFrame) -> DataFrame:
    """Pulls with the first push of their task: ``task_id, batch_id, paper_id, pull_ts, push_ts``. Pushes before the pull don't count."""
    joined = pulls.join(pushes.select(F.col("task_id").alias("t"), F.col("push_ts")), F.expr("task_id = t AND push_ts >= pull_ts"), "left")
    return joined.groupBy("task_id", "batch_id", "paper_id", "pull_ts").agg(F.min("push_ts").alias("push_ts"))


def results(rounds: DataFrame) -> DataFrame:
    """What the engine hands back: the translation, or silently the source; ``timed_out`` makes that visible."""
    late = F.col("status") == "timed_out"
    return rounds.withColumn("result", F.when(late, F.col("source_text")).otherwise(F.coalesce("target_text", "source_text"))).withColumn("timed_out", late)


def batch_outcomes(rounds: DataFrame) -> DataFrame:
    """``batch_id, tasks, late, poisoned``: one late task spoils its batch's cache entries."""
    late = (F.col("status") == "timed_out").cast("long")
    return rounds.groupBy("batch_id").agg(F.count(F.lit(1)).alias("tasks"), F.sum(late).alias("late"), (F.max(late) > 0).alias("poisoned"))


def poisoned_entries(cache: DataFrame) -> DataFrame:
    """Cache rows whose target is their source although it has letters to translate."""
    return cache.where((F.col("target_text") == F.col("source_text")) & F.col("source_text").rlike(r"\p{L}{3}"))


def purge(cache: DataFrame) -> DataFrame:
    """The cache without its poisoned entries. Formulas and the like, equal by nature, stay."""
    bad = (F.col("target_text") == F.col("source_text")) & F.col("source_text").rlike(r"\p{L}{3}")
    return cache.where(~F.coalesce(bad, F.lit(False)))


def poisoned_reads(lookups: DataFrame, writes: DataFrame) -> DataFrame:
    """``batch_id, entry_id, spoilt_by, lookups, first_ts``: batches that read a poisoned cache entry, and the entry and batch that had spoilt it.

    lookups: ``batch_id, source_text, ts``; writes: ``entry_id, batch_id, source_text, target_text, ts``.
    A lookup reads the latest entry written before it for its text, of those written at once the one
    with the largest id. Batches may read their own entries; those are left out, as they aren't later
    ones. A lookup that reads a sound entry, or none, gives no row.
    """
    poisoned = F.coalesce((F.col("target_text") == F.col("source_text")) & F.col("source_text").rlike(r"\p{L}{3}"), F.lit(False))
    made = writes.select(text_key(F.col("source_text")).alias("key"), F.col("ts").cast("timestamp").alias("at"), "entry_id", F.col("batch_id").alias("by"), poisoned.alias("poisoned"))
    asked = lookups.select(text_key(F.col("source_text")).alias("key"), F.col("ts").cast("timestamp").alias("at"), "batch_id")
    read = as_of(asked, made, "key", "at", ["entry_id"]).where("latest.poisoned AND NOT (latest.by <=> batch_id)")
    return read.groupBy("batch_id", F.col("latest.entry_id").alias("entry_id"), F.col("latest.by").alias("spoilt_by")).agg(F.count(F.lit(1)).alias("lookups"), F.min("at").alias("first_ts"))


def overlapping(rounds: DataFrame, lane: str) -> DataFrame:
    """``task_id, open_others``: rounds that began while rounds of other papers in their lane were open. Must be empty.

    Of rounds that begin at the same time the one with the smaller task_id began first. An unpushed
    round is open for the engine's limit; one that ends when or before it begins is open to nobody, but
    may begin in others. Rounds without a lane, paper or begin play no part; task ids are unique.

    Starts and ends are laid in one order, ends first, and dealt by ranges of it, so a lane or paper of
    any size is spread over tasks. What is open before a row is what its range's earlier rows and all
    ranges before left open in the lane, less the same for its paper.
    """
    begin = F.col("pull_ts").cast("timestamp")
    end = F.coalesce(F.col("push_ts").cast("timestamp"), begin + F.expr(f"INTERVAL {ENGINE_SECONDS} SECONDS"))
    rows = rounds.select(F.col(lane).alias("lane"), "paper_id", "task_id", begin.alias("begin"), end.alias("end")).where("lane IS NOT NULL AND paper_id IS NOT NULL AND begin IS NOT NULL")
    steps = F.array(
        F.struct(F.col("begin").alias("at"), F.lit(1).alias("kind"), F.when(F.col("end") > F.col("begin"), 1).otherwise(0).alias("step")),
        F.struct(F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step")),
    )
    laid = rows.select("lane", "paper_id", "task_id", "begin", "end", F.inline(steps)).where("kind = 1 OR end > begin").drop("begin", "end")
    laid = stored(laid, "laid")
    laid = stored(laid.repartitionByRange(range_count(laid), "lane", "at", "kind", "task_id").withColumn("part", F.spark_partition_id()), "steps")
    counted = laid
    for by, name in ((["lane"], "of_lane"), (["lane", "paper_id"], "of_paper")):
        # One row for each range and lane or paper in it: as many as ranges at most in one window.
        sums = laid.groupBy(*by, "part").agg(F.sum("step").alias("left_open"))
        before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select(*by, "part", F.coalesce(F.sum("left_open").over(before), F.lit(0)).alias(f"carried_{name}"))
        inside = Window.partitionBy(*by, "part").orderBy("at", "kind", "task_id").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn(name, F.coalesce(F.sum("step").over(inside), F.lit(0))).join(carried, [*by, "part"])
    others = F.col("of_lane") + F.col("carried_of_lane") - F.col("of_paper") - F.col("carried_of_paper")
    return counted.where("kind = 1").select("task_id", others.alias("open_others")).where("open_others > 0")


def active(queue: DataFrame) -> DataFrame:
    """Tasks of batches that aren't archived; nothing is ever deleted."""
    return queue.where(~F.coalesce("archived", F.lit(False)))


def archive(queue: DataFrame, batch_id) -> DataFrame:
    """The queue with one batch archived; all rows stay."""
    return queue.withColumn("archived", F.coalesce("archived", F.lit(False)) | (F.col("batch_id") == batch_id))
