"""One-way copies kept in versions: nothing is deleted, what is replaced comes back from an older version."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from ..versions import Versions

#: Buckets of a copy, and rows of a file. A manifest has an entry for each bucket; a run writes those that change.
BUCKETS, FILE_ROWS = 64, 2_000_000


class VersionedCopy:
    """The copy of a table below a folder, one row a key, in buckets of the key.

    A copy run writes the buckets that change to a new folder and then commits a manifest, which names
    a folder for each bucket. Until then everybody reads the old version, and so they do if the run
    breaks. A run that finds nothing to add or to replace writes nothing and makes no version.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.key, self.buckets, self.versions = spark, key, buckets, Versions(spark, path)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The copy as it is, or as it was in an older version; None before the first one."""
        folders = sorted(set(self.versions.entries(version).values()))
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _marked(self, source: DataFrame) -> DataFrame:
        """Rows of both sides by key: ``bucket, key, new, old, action``; rows as structs of the source's columns."""
        others = [c for c in source.columns if c != self.key]
        rows = source.where(F.col(self.key).isNotNull()).select(self.key, F.struct(*others).alias("row"))
        new = rows.groupBy(self.key).agg(F.max("row").alias("new"))
        old = self.read()
        if old is None:
            both = new.withColumn("old", F.lit(None).cast(new.schema["new"].dataType))
        else:
            missing = [F.lit(None).cast(source.schema[c].dataType).alias(c) for c in others if c not in old.columns]
            kept = old.select(self.key, F.struct(*[F.col(c) for c in others if c in old.columns], *missing).alias("old"))
            kept = kept.select(self.key, F.struct(*[F.col("old")[c].alias(c) for c in others]).alias("old"))
            both = new.join(kept, self.key, "full")
        action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "keep").when(F.col("new").eqNullSafe(F.col("old")), "same").otherwise("replace")
        return both.withColumn("action", action).withColumn("bucket", self._bucket())

    def run(self, source: DataFrame) -> int:
        """Copy ``source``, and give the version that holds it: the one there was, if nothing had to change.

        Of rows that share a key the largest counts, column by column; rows with a null key can't be
        told apart and aren't copied. The source's columns are the copy's (no maps); of keys only the copy has,
        columns that the source lacks are dropped in buckets that change.
        """
        version = self.versions.latest()
        marked = stored(self._marked(source), "copy")
        changed = [r["bucket"] for r in marked.where("action IN ('add', 'replace')").select("bucket").distinct().collect()]
        if not changed:
            return version
        # Only buckets that change are written; the driver knows their numbers, BUCKETS at most.
        rows = marked.where(F.col("bucket").isin(changed)).select("bucket", self.key, F.coalesce("new", "old").alias("row")).select("bucket", self.key, "row.*")
        rows = stored(rows, "changed")
        files, folder = max(len(changed), ceil(rows.count() / FILE_ROWS)), self.versions.fresh()
        # By bucket and key, so a large bucket is written by several tasks and a task meets few buckets.
        rows.repartitionByRange(files, "bucket", self.key).write.partitionBy("bucket").parquet(folder)
        entries = self.versions.entries(version) | {str(b): f"{folder}/bucket={b}" for b in changed}
        return self.versions.commit(entries, version)

    def replaced(self, version: int) -> DataFrame:
        """The rows that ``version`` replaced, as they were before."""
        now, before = self.versions.entries(version), self.versions.entries(version - 1)
        differ = [b for b in now if now[b] != before.get(b)]
        old, new = ([e[b] for b in differ if b in e] for e in (before, now))
        if not old:
            return self.read(version).limit(0)
        a, b = self.spark.read.option("mergeSchema", True).parquet(*old), self.spark.read.option("mergeSchema", True).parquet(*new)
        return a.exceptAll(b.select(a.columns)) if set(a.columns) <= set(b.columns) else a.join(b, self.key, "left_semi")
