"""Approximate totals over cases from sketches stored by case: adding a case reads that case only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..versions import Versions

#: Registers of a distinct count (2 to this power) and its relative error, three standard errors.
LOG_REGISTERS, DISTINCT_ERROR = 12, 0.05
#: Size of a quantile sketch and its error in rank, as a share of the rows.
QUANTILE_SIZE, RANK_ERROR = 800, 0.01
#: Items that a group keeps with their exact number of rows.
KEPT_ITEMS = 100


class Summaries:
    """Sketches of rows (``group, member, value, item``) below a folder, by case.

    For each case and group: the number of rows, a sketch of how many different members, one of the quantiles of
    value, and the items that occur most, with what the others occur at most. Cases are merged when a
    report is asked for; a case that is added again takes the place of its former self. A null group is a
    group; null members, values and items aren't counted. A manifest has an entry for each case.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def add(self, case_name: str, rows: DataFrame) -> int:
        """Store the sketches of a case; the version that has them."""
        version = self.versions.latest()
        rows = rows.select(F.col("group").cast("string").alias("group"), F.col("member").cast("string").alias("member"), F.col("value").cast("double").alias("value"), F.col("item").cast("string").alias("item"))
        folder = self.versions.fresh()
        sketched = rows.groupBy("group").agg(
            F.count(F.lit(1)).alias("rows"),
            F.hll_sketch_agg("member", LOG_REGISTERS).alias("members"),
            F.kll_sketch_agg_double("value", QUANTILE_SIZE).alias("values"),
            F.count("value").alias("valued"),
        )
        sketched.withColumn("case_name", F.lit(case_name)).write.parquet(f"{folder}/sketches")
        counted = rows.where("item IS NOT NULL").groupBy("group", "item").agg(F.count(F.lit(1)).alias("n"))
        # One row more than is kept: what it occurs is the most that an item left out can occur.
        ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.col("n").desc(), "item"))).where(F.col("rank") <= KEPT_ITEMS + 1)
        ranked.withColumn("case_name", F.lit(case_name)).write.parquet(f"{folder}/items")
        return self.versions.commit({**self.versions.entries(version), f"case-{case_name}": folder}, version)

    def _read(self, part: str, version: int | None) -> DataFrame:
        folders = list(self.versions.entries(version).values())
        if not folders:
            raise ValueError("no case has been added")
        return self.spark.read.parquet(*[f"{folder}/{part}" for folder in folders])

    def report(self, quantiles: tuple[float, ...] = (0.5, 0.9), version: int | None = None) -> DataFrame:
        """``case_name, group, level, rows, members, q50, q90``: by case and group, by case, by group, and for all.

        level: 0 to 3 in this order. members is off by `DISTINCT_ERROR` at most but for one time in some
        hundred, a quantile by `RANK_ERROR` of the rows in rank. Only sketches are read.
        """
        sketches = self._read("sketches", version)
        merged = sketches.groupingSets([["case_name", "group"], ["case_name"], ["group"], []], "case_name", "group").agg(
            F.grouping_id().cast("int").alias("level"), F.sum("rows").alias("rows"), F.hll_union_agg("members").alias("m"), F.kll_merge_agg_double("values").alias("v"), F.sum("valued").alias("valued")
        )
        named = [F.when(F.col("valued") > 0, F.kll_sketch_get_quantile_double("v", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
        return merged.select("case_name", "group", "level", "rows", F.hll_sketch_estimate("m").alias("members"), *named)

    def frequent(self, top: int = 10, version: int | None = None) -> DataFrame:
        """``item, at_least, at_most, rank``: the items that occur most in all cases and groups together, by what is certain.

        An item occurs ``at_least`` where it was kept, and elsewhere no more than what each group left out: ``at_most``.
        """
        items = self._read("items", version)
        cuts = items.where(F.col("rank") == KEPT_ITEMS + 1).select("case_name", "group", F.col("n").alias("cut"))
        total = cuts.agg(F.sum("cut")).first()[0] or 0
        kept = items.where(F.col("rank") <= KEPT_ITEMS).join(cuts, items["case_name"].eqNullSafe(cuts["case_name"]) & items["group"].eqNullSafe(cuts["group"]), "left").select("item", "n", "cut")
        summed = kept.groupBy("item").agg(F.sum("n").alias("at_least"), F.sum(F.coalesce("cut", F.lit(0))).alias("known"))
        bounded = summed.select("item", "at_least", (F.col("at_least") + total - F.col("known")).alias("at_most"))
        return bounded.orderBy(F.col("at_least").desc(), "item").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.col("at_least").desc(), "item")))
