"""Exact duplicates of whole texts, safe against a group that holds a large share of all rows.

Texts whose 64-bit hash occurs once are equal to none. The others go through three combines, each
grouping by the digest and by the full text, so equal digests never pass for equal texts. First within a
task (Spark's map-side aggregate), then by digest and salt, where the salt follows the number of the map
task: a group of any size reaches a reducer as one row per map task at most, dealt over as many salts as
the root of the number of tasks. Winners of different salts meet in the last combine. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_keyed, lower_az, stored, unused

#: Hashes, of eight bytes each, up to which their table goes to every task.
BROADCAST_HASHES = 1_000_000


def _norm(text_col: str) -> Column:
    return F.coalesce(lower_az(F.col(f"`{text_col}`")), F.lit(""))


def _digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per different text: ``text_sha256, norm_text, keep_id, group_size``. salts: their number, if it shall not grow with the tasks."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _norm(text_col).alias("norm_text"))
    salt = F.floor(F.sqrt(F.spark_partition_id())) if salts is None else F.spark_partition_id() % salts
    keyed = rows.withColumn("text_sha256", _digest(F.col("norm_text"))).withColumn("salt", salt)
    by_salt = keyed.groupBy("text_sha256", "salt", "norm_text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Dealt by the digest alone, so that one exchange serves this combine and the count of variants.
    return by_salt.repartition("text_sha256").groupBy("text_sha256", "norm_text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _repeated(hashes: DataFrame) -> tuple[DataFrame, int, bool]:
    """Text hashes that occur more than once, with the number of all rows, and whether they are few enough to broadcast. hashes: ``hash``."""
    counted = stored(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hashes")
    total = (counted.agg(F.sum("n")).first()[0] or 0)
    return counted, total, counted.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES


def _tell(rows: DataFrame, by: str, counted: DataFrame, total: int, few: bool, flag: str) -> DataFrame:
    """Adds to rows whether their hash, in column ``by``, occurs more than once."""
    again = counted.select(F.col("hash").alias(by), F.lit(True).alias(flag), "n")
    if few:
        return rows.join(F.broadcast(again.drop("n")), by, "left")
    return join_keyed(rows, again.withColumnRenamed("n", unused(rows, "n")), by, unused(rows, "n"), total, "left")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """Which document stands for each: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per row.

    Texts are equal if they are identical once A-Z are lower-cased; a null text is an empty one.
    The largest id of a group stays. Rows that repeat an id and a text all count, and all carry
    kept = true if theirs is the largest id; `deduplicate` leaves one of them. In a group whose ids
    are all null keep_id is null and its rows are kept; beside other ids a null id is dropped.
    Other columns of ``docs`` play no part, whatever their names. An empty table gives an empty one.

    Should a digest stand for two texts, which the combines would show, its rows are joined by the full
    text instead.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _norm(text_col).alias("norm_text"))
    rows = stored(texts.select("doc_id", _digest(F.col("norm_text")).alias("text_sha256"), F.xxhash64("norm_text").alias("hash")), "digests")
    known = _repeated(rows.select("hash"))
    of_texts = _tell(texts.withColumn("hash", F.xxhash64("norm_text")), "hash", *known, "again").where("again")
    classes = text_classes(of_texts, "doc_id", "norm_text", salts).groupBy("text_sha256").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("variants")
    )
    repeated = stored(classes.where("group_size > 1").withColumn("rows", F.col("group_size")), "copies")
    told = _tell(rows, "hash", *known, "again").drop("hash")
    alone = told.where("again IS NULL").select("doc_id", "text_sha256", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    mine = told.where("again").drop("again")
    found = alone.unionByName(join_keyed(mine, repeated.where("variants = 1").drop("variants"), "text_sha256", "rows", known[1], "left"))
    clashes = repeated.where("variants > 1").select("text_sha256")
    if not clashes.isEmpty():
        found = found.join(clashes, "text_sha256", "left_anti")
        full = texts.withColumn("text_sha256", _digest(F.col("norm_text")))
        apart = full.join(clashes, "text_sha256", "left_semi").join(text_classes(texts, "doc_id", "norm_text", salts), ["text_sha256", "norm_text"])
        found = found.unionByName(apart.select(*found.columns))
    unmatched = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(unmatched, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(unmatched, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        F.when(unmatched, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row of ``docs`` for each different text, with all its columns: that with the largest id.

    Texts are equal as in `exact_duplicates`. A null id counts as the smallest; of rows that repeat id
    and text one stays, also where both are null. No other row goes, whatever ids repeat. Columns may
    have any names. Rows whose hash occurs once are passed on as they are; the others are written with a
    number of their own, by which those that stay are told.
    """
    by, flag, number = (unused(docs, c) for c in ("hash", "again", "number"))
    hashed = docs.withColumn(by, F.xxhash64(_norm(text_col)))
    known = _repeated(hashed.select(F.col(by).alias("hash")))
    told = _tell(hashed, by, *known, flag).drop(by)
    mine = stored(told.where(F.col(flag)).drop(flag).withColumn(number, F.monotonically_increasing_id()), "repeats")
    best = text_classes(mine.select(F.struct(F.col(f"`{id_col}`"), F.col(number)).alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", salts)
    stays = best.select(F.col("keep_id")[number].alias(number))
    kept = mine.join(F.broadcast(stays) if known[2] else stays, number, "left_semi").drop(number)
    return told.where(F.col(flag).isNull()).drop(flag).unionByName(kept.select(*[F.col(f"`{c}`") for c in docs.columns]))
