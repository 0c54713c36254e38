"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. Words are summed by source and hash bucket; running sums over
a source's buckets (at most 1,024) show in which bucket its budget ends. Only that bucket is split
again by the next ten bits, until it holds one hash. Documents below the threshold are taken: a
filter on a column, without sorting documents. Budgets nest: a larger one takes all that a smaller does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, join_keyed, spread, stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2
LEVEL_BITS, LEVELS = 10, 6
#: Tables with a row a source are broadcast up to so many sources, and else joined by shuffle.
BROADCAST_SOURCES = 50_000


def document_hash(doc_id: Column, seed: str = "mix") -> Column:
    """60 bits of an MD5, the same on every run and in any engine."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _hash(seed: str) -> Column:
    """Hash of a document's id, or of its text where it has no id."""
    return document_hash(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))), seed).alias("h")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target, docs``, one row a source; a null source is a source of its own, the last.

    Sources take weights in turn, in the order of their code points. They share ``budget`` times all
    sizes by weight, no more than ``repeats`` times their own size each; what that leaves is shared by
    weight among the others, until none is above. In the order of size to weight, the sources before
    the first one that stays below its limit are just those at their limit. The windows without a key run
    over one row a source, some 50 bytes each, however many documents there are.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = per.withColumn("rank", order).withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("limit", F.col("source_size") * repeats).withColumn("ratio", F.col("limit").cast("double") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    # One level for each source: what the budget leaves for it and those after it, by their weight.
    level = (F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("limit").over(before), F.lit(0)).cast("double")) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ).cast("double")
    levelled = ranked.withColumn("level", level)
    final = F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank"))).over(whole)
    share = F.coalesce(F.least(F.col("limit").cast("double"), F.col("final") * F.col("weight")), F.col("limit").cast("double"))
    return levelled.withColumn("final", final).select("source", "source_size", share.alias("target"), "docs")


def _by_source(rows: DataFrame, small: DataFrame, sources: int, total: int) -> DataFrame:
    """Joins a table with one row a source, which names the source's rows as ``docs``. Few sources are all broadcast, of many the large ones."""
    names = [c for c in small.columns if c not in ("source", "docs")]
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    left, right = rows.withColumn("__source", key), small.withColumn("__source", key).drop("source")
    if sources <= BROADCAST_SOURCES:
        return left.join(F.broadcast(right), "__source").select(*rows.columns, *names)
    return join_keyed(left, right, "__source", "docs", total).select(*rows.columns, *names)


def _limits(sized: DataFrame, weights: tuple, budget: float, repeats: int) -> tuple[DataFrame, int]:
    """One row a source: how often all its documents are taken, and up to which hash once more; and the number of sources."""
    targets = stored(source_targets(sized, weights, budget, repeats).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)), "targets")
    sources, total = targets.count(), sized.count()
    bits = LEVEL_BITS * LEVELS
    bound = targets.select("source", F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), "docs").where("rest > 0")
    run = Window.partitionBy("source").orderBy("prefix")
    for level in range(1, LEVELS + 1):
        shift = bits - LEVEL_BITS * level
        inside = _by_source(sized, bound.withColumnRenamed("prefix", "up"), sources, total).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("up"))
        cells = inside.groupBy("source", F.shiftright("h", shift).alias("prefix"), "rest").agg(
            F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last"), F.count(F.lit(1)).alias("docs")
        )
        summed = cells.withColumn("upto", F.sum("words").over(run)).withColumn("under", F.col("upto") - F.col("words"))
        # Rounding in the last place may put the budget beyond all words: then nothing bounds it, and all are taken.
        ends = summed.where("under < rest AND rest <= upto").select("source", "prefix", (F.col("rest") - F.col("under")).alias("rest"), "words", "first", "last", "docs")
        bound = stored(ends, f"bounds{level}")
        if bound.where("first <> last").isEmpty():
            break
        bound, ended = bound.select("source", "prefix", "rest", "docs"), bound
    else:
        bound = ended
    cut = bound.select("source", F.col("first").alias("at"), (F.col("rest") >= F.col("words") - F.col("rest")).alias("in_too"))
    limits = targets.join(cut.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    return limits.withColumn("beyond", (F.col("target") - F.col("passes") * F.col("source_size")) > 0), sources


def _times() -> Column:
    more = F.when(F.col("at").isNull(), F.col("beyond")).otherwise((F.col("h") < F.col("at")) | ((F.col("h") == F.col("at")) & F.col("in_too")))
    return F.col("passes") + more.cast("int")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """What a mix takes of every document: ``doc_id, size, source_size, target, taken``, one row per row.

    size is the number of words of the whole text; null and empty texts have 0, and are taken 0 times.
    A document is taken whole, up to ``repeats`` times: each source gives every document as often as
    its target allows, and once more those below its threshold. The documents of the boundary hash go
    in if that comes at least as near the target as leaving them out, so a source misses its target by
    half a document at most. Rows that repeat an id share a hash and are taken or left together; a row
    with a null id goes by its text. Other columns play no part. An empty table gives an empty one.
    """
    sized = spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(seed))
    sized = stored(sized, "sizes")
    limits, sources = _limits(sized, weights, budget, repeats)
    taken = _by_source(sized, limits, sources, sized.count())
    return taken.select("doc_id", "size", "source_size", "target", (_times() * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mix takes, a row for each time it takes them; documents without words go.

    The decision is made on the row itself, from its source's limits, so rows that share an id, or have
    none, don't meet each other's. Columns may have any names.
    """
    size = word_count(F.col("text")).alias("size")
    key = [F.col("source"), _hash(seed)]
    sized = stored(docs.select(*key, size), "sizes")
    limits, sources = _limits(sized, weights, budget, repeats)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = _by_source(docs.select(whole, *key, size), limits, sources, sized.count()).where("size > 0")
    return rows.select("__row", F.explode(F.array_repeat(F.lit(1), _times().cast("int")))).select("__row.*")
