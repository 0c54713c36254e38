"""Progress records against files on disk, and one-way copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def reconcile(records: DataFrame, disk: DataFrame, key: str = "progress_key") -> DataFrame:
    """``key, status`` for every key: both, disk_only or record_only. Repeated keys count once; null keys are left out."""
    a = records.select(key).where(F.col(key).isNotNull()).distinct().withColumn("recorded", F.lit(True))
    b = disk.select(key).where(F.col(key).isNotNull()).distinct().withColumn("stored", F.lit(True))
    status = F.when(F.col("recorded") & F.col("stored"), "both").when(F.col("stored"), "disk_only").otherwise("record_only")
    return a.join(b, key, "full").select(key, status.alias("status"))


def backfill(records: DataFrame, disk: DataFrame, key: str = "progress_key") -> DataFrame:
    """What has to be filled in: a row of ``disk`` for each key that `reconcile` calls disk_only.

    Null keys are left out. Of rows with the same key the one whose other columns are smallest counts,
    column by column, nulls first; these must have an order (no maps).
    """
    others = [c for c in disk.columns if c != key]
    rows = disk.where(F.col(key).isNotNull())
    least = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("__row")).select(key, *[F.col("__row")[c].alias(c) for c in others]) if others else rows.distinct()
    return least.select(disk.columns).join(records.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def apply_backfill(records: DataFrame, disk: DataFrame, path: str, key: str = "progress_key", apply: bool = False) -> DataFrame:
    """The report; with ``apply`` the missing records are appended at ``path``, and only then is anything written there.

    The report is stored first, so it tells what was missing even where ``records`` are read from
    ``path``. Applied again to the records as they then are, it adds nothing.
    """
    missing = stored(backfill(records, disk, key), "missing")
    if apply:
        missing.write.mode("append").parquet(path)
    return missing


def sync_plan(source: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """``key, action`` of a one-way copy: add, replace (after a backup), same, or keep what only the target has.

    Nothing is ever deleted. Keys are unique on each side; a null value equals a null value.
    """
    s = source.select(F.col(key), F.col(value).alias("new"), F.lit(True).alias("in_source"))
    t = target.select(F.col(key), F.col(value).alias("old"), F.lit(True).alias("in_target"))
    action = F.when(F.col("in_target").isNull(), "add").when(F.col("in_source").isNull(), "keep").when(F.col("new").eqNullSafe(F.col("old")), "same").otherwise("replace")
    return s.join(t, key, "full").select(key, action.alias("action"))


def synced(source: DataFrame, target: DataFrame, key: str, value: str, backup_path: str | None = None) -> DataFrame:
    """The target after a one-way copy. Rows about to be replaced are appended at ``backup_path`` first."""
    plan = sync_plan(source, target, key, value)
    if backup_path:
        target.join(plan.where("action = 'replace'").select(key), key, "left_semi").write.mode("append").parquet(backup_path)
    kept = target.join(plan.where("action = 'keep'").select(key), key, "left_semi")
    return source.select(*target.columns).unionByName(kept)


def repath(rows: DataFrame, column: str, old_root: str, new_root: str) -> DataFrame:
    """Paths below ``old_root`` moved below ``new_root``; other paths stay, also those that only begin alike."""
    path, root = F.col(column), old_root.rstrip("/")
    inside = (path == root) | path.startswith(root + "/")
    return rows.withColumn(column, F.when(inside, F.concat(F.lit(new_root.rstrip("/")), F.substr(path, F.lit(len(root) + 1)))).otherwise(path))
