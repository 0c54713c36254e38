"""The best recorded source of each study, down an ordered list of fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The order of the fallbacks, by kind. The order within the first tier is an assumption.
TIERS = ("api", "publisher_tags", "mirror_a", "mirror_b", "web_search")
MANUAL = "manual"


def choose_source(studies: DataFrame, attempts: DataFrame, tiers: tuple = TIERS) -> DataFrame:
    """One row a study: ``study_id, tier_rank, tier, source, attempt_id``.

    attempts: ``study_id, tier_rank, source_rank, source, ok, ts, attempt_id``. The successful attempt
    of the lowest tier wins, within it the lowest source rank, then the earliest. A study without one
    is left to hand work. The best attempt comes from an aggregate, so a study with very many attempts
    is combined before the shuffle.
    """
    best = attempts.where("ok").groupBy("study_id").agg(F.min(F.struct("tier_rank", "source_rank", "ts", "attempt_id", "source")).alias("best"))
    names = F.array(*[F.lit(t) for t in tiers])
    rank = F.coalesce("best.tier_rank", F.lit(len(tiers)))
    return studies.select("study_id").distinct().join(best, "study_id", "left").select(
        "study_id", rank.cast("int").alias("tier_rank"), F.coalesce(F.get(names, F.col("best.tier_rank")), F.lit(MANUAL)).alias("tier"), F.col("best.source").alias("source"), F.col("best.attempt_id").alias("attempt_id")
    )


def success_rates(chosen: DataFrame) -> DataFrame:
    """``case_name, studies, found, rate`` for each case; rate in per cent, to one decimal."""
    found = F.sum((F.col("tier") != MANUAL).cast("long"))
    return chosen.groupBy("case_name").agg(F.count(F.lit(1)).alias("studies"), found.alias("found"), F.round(100.0 * found / F.count(F.lit(1)), 1).alias("rate"))


def cumulative(rates: DataFrame) -> DataFrame:
    """Running totals over the cases, in order of name. One row a case goes through the window."""
    run = Window.orderBy("case_name").rowsBetween(Window.unboundedPreceding, 0)
    return rates.select("case_name", F.sum("studies").over(run).alias("studies_so_far"), F.sum("found").over(run).alias("found_so_far"))
