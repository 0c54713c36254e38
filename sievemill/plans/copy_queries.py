"""Queries on progress with null and repeated keys, and on one-way copies in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import progress_key
from ..operators import progress
from ..operators.copies import VersionedCopy
from ..sources.tables import read_table
from ..storage import fresh_path

ODD_TITLES = "CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'On it' WHEN 3 THEN 'QT' WHEN 4 THEN 'It is' ELSE substring(text, 1, 20) END"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study for each document, few with a DOI, many with a title that says little, a tenth without an id; every third twice."""
    rows = read_table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 8 = 0 THEN concat('10.1000/', doc_id % 300) END AS doi", f"{ODD_TITLES} AS title", "concat('Author', doc_id % 97) AS author", "cast(1990 + doc_id % 35 AS int) AS year",
        "CASE WHEN doc_id % 10 <> 0 THEN cast(doc_id AS string) END AS study_id", "source",
    )
    keyed = rows.withColumn("progress_key", progress_key(F.col("doi"), F.col("title"), F.col("author"), F.col("year"), F.col("study_id")))
    return keyed.unionByName(keyed.where("doc_id % 3 = 0"))


def repeated_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key after the missing records have been filled in twice: once each, as `reconcile` says."""
    base = fresh_path(spark, "progress")
    every = _keyed(spark, sf_dir).select("progress_key", "source")
    _keyed(spark, sf_dir).where("doc_id % 2 = 0").select("progress_key", "source").write.parquet(base)
    for _ in range(2):
        progress.apply_backfill(spark.read.parquet(base), every, base, apply=True)
        spark.catalog.refreshByPath(base)
    after = spark.read.parquet(base)
    status = progress.reconcile(after, every)
    counted = after.groupBy("progress_key").agg(F.count(F.lit(1)).alias("records"), F.min("source").alias("source"))
    return counted.join(status, "progress_key", "left").select("progress_key", "records", "source", "status")


KEYED = f"""rows AS (
  SELECT doc_id, source, CASE WHEN doc_id % 8 = 0 THEN '10.1000/' || doc_id % 300 END AS doi, {ODD_TITLES} AS title, 'author' || doc_id % 97 AS author, 1990 + doc_id % 35 AS year,
         CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id AS VARCHAR) END AS study_id FROM documents
), worded AS (
  SELECT *, array_to_string(list_filter(string_split_regex(lower(coalesce(title, '')), '[^\\pL\\pN]+'), lambda w: w <> ''), ' ') AS words FROM rows
), once AS (
  SELECT doc_id, source, sha256(coalesce(doi, CASE WHEN words <> '' THEN words || '|' || author || '|' || year END, 'study|' || study_id)) AS progress_key FROM worded
), keyed AS (
  SELECT * FROM once UNION ALL SELECT * FROM once WHERE doc_id % 3 = 0
)"""
REPEATED = f"""
WITH {KEYED}, held AS (SELECT progress_key, source FROM keyed WHERE doc_id % 2 = 0), added AS (
  SELECT progress_key, min(source) AS source FROM keyed k WHERE progress_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.progress_key = k.progress_key) GROUP BY 1
)
SELECT progress_key, count(*) AS records, min(source) AS source, CASE WHEN progress_key IS NOT NULL THEN 'both' END AS status
FROM (SELECT * FROM held UNION ALL SELECT * FROM added) GROUP BY progress_key
"""


def versioned_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts copied, then a later state of them, then that state again: both versions side by side, and what the second one replaced."""
    parts = read_table(spark, sf_dir, "part")
    copy = VersionedCopy(spark, fresh_path(spark, "parts"), "p_partkey", buckets=16)
    first = copy.run(parts.where("p_partkey % 10 <> 0").select("p_partkey", "p_name"))
    later = parts.where("p_partkey % 7 <> 0").selectExpr("p_partkey", "CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS p_name")
    second = copy.run(later.unionByName(later.where("p_partkey % 5 = 0")))
    third = copy.run(later)
    old, new = copy.read(first).withColumnRenamed("p_name", "first_name"), copy.read().withColumnRenamed("p_name", "last_name")
    gone = copy.replaced(second).selectExpr("p_partkey", "p_name AS replaced_name", "true AS replaced")
    both = old.withColumn("in_first", F.lit(True)).join(new, "p_partkey", "full").join(gone, "p_partkey", "left")
    return both.select("p_partkey", "first_name", "last_name", "replaced_name", F.coalesce("replaced", F.lit(False)).alias("replaced"), F.lit(third).cast("long").alias("version"))


VERSIONED = """
WITH a AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 10 <> 0), b AS (
  SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS p_name FROM part WHERE p_partkey % 7 <> 0
), c AS (
  SELECT * FROM b UNION ALL SELECT * FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM b)
)
SELECT p_partkey, a.p_name AS first_name, c.p_name AS last_name,
       CASE WHEN a.k IS NOT NULL AND a.p_name IS DISTINCT FROM c.p_name THEN a.p_name END AS replaced_name,
       a.k IS NOT NULL AND a.p_name IS DISTINCT FROM c.p_name AS replaced, CAST(2 AS BIGINT) AS version
FROM (SELECT *, p_partkey AS k FROM a) a FULL JOIN c USING (p_partkey)
"""

QUERIES = {"repeated_progress": repeated_progress, "versioned_copy": versioned_copy}
ORACLES = {"repeated_progress": REPEATED, "versioned_copy": VERSIONED}
