"""Stages judge rows one by one: repeated and null ids, empty copies, and columns named like the helpers' own."""

from collections import Counter

from pyspark.sql import functions as F

from sievemill import joins
from sievemill.llm.exact_dedup import deduplicate
from sievemill.llm.language_id import keep_identified
from sievemill.llm.minhash import drop_near_duplicates
from sievemill.llm.mixing import mixed_documents
from sievemill.llm.shared import join_keyed

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"
OTHER = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
CLASHES = ("__gone", "__sha", "__id", "__turn", "__row", "__times", "__copy", "hash", "again", "number", "key", "row", "rows", "component_id", "id", "h", "__near", "__far", "gone", "Doc")


def clashing(docs):
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(k))
    return docs


def test_near_duplicates_by_row(spark):
    rows = [(3, LONG, "a"), (5, LONG + " more", "b"), (5, OTHER, "c"), (None, LONG, "d"), (None, OTHER + " mu", "e"), (None, "", "f"), (7, None, "g"), (7, "short", "h"), (7, "short", "i"), (3, LONG, "j")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, tag string"))
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    tags = {r.tag for r in left.collect()}
    assert {"c", "f", "g"} <= tags and len(tags & {"a", "j"}) == 1 and len(tags & {"h", "i"}) == 1 and not tags & {"b", "d", "e"}
    assert left.where("hash = 7").count() == left.count() == len(tags)
    assert drop_near_duplicates(docs.limit(0)).collect() == []


def test_exact_duplicates_by_row(spark):
    rows = [(1, "A b", "a"), (2, "a B", "b"), (2, "a b", "c"), (2, "else", "d"), (None, "x", "e"), (None, "X", "f"), (None, "a b", "g"), (9, None, "h"), (4, "", "i"), (None, "y", "j")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, tag string"))
    left = deduplicate(docs)
    assert left.columns == docs.columns and left.where("__sha = 1 AND number = 9").count() == left.count()
    tags = {r.tag for r in left.collect()}
    assert {"d", "h", "j"} <= tags and len(tags & {"b", "c"}) == 1 and len(tags & {"e", "f"}) == 1 and len(tags) == 5
    assert deduplicate(docs.limit(0)).collect() == []


def test_mixing_by_row(spark):
    rows = [(7, "g h", "A"), (7, "", "A"), (7, "i j k", "B"), (None, "a b c", "A"), (None, "d e f", None), (None, None, None)] + [(k, "w " * 4, "C") for k in range(100, 140)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    left = mixed_documents(docs)
    assert left.columns == docs.columns
    times = Counter((r.doc_id, r.text, r.source) for r in left.collect())
    assert max(times.values()) <= 2 and not [k for k in times if not k[1]]
    assert mixed_documents(docs.limit(0)).collect() == []


def test_null_ids_are_taken_one_by_one(spark):
    """A source of rows without ids still comes near its target."""
    rows = [(None, f"text number {k}", "A") for k in range(400)] + [(k, "w x y z", "B") for k in range(400)]
    left = mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    words = {r.source: r.n for r in left.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert abs(words["A"] - 2 * 1200) <= 4 and abs(words["B"] - (1.5 * 2800 - 2400)) <= 4


def test_languages_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    none = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50))
    junk = spark.createDataFrame([(None, "", "en", "src0"), (None, "12", None, None), (5, "...", "en", "src1")] + [(None, None, None, None)] * 20, docs.schema)
    both = clashing(none.unionByName(junk))
    left = keep_identified(both)
    assert left.columns == both.columns and left.count() == docs.count()


def test_rejected_rows_beyond_a_broadcast(spark, monkeypatch):
    from sievemill.llm import language_id

    monkeypatch.setattr(language_id, "BROADCAST_ROWS", 0)
    test_languages_by_row(spark)


def test_addresses_are_evidence(spark):
    from sievemill.llm.language_id import identify, of_documents

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.substring("text", 1, 40).alias("text"), "lang")
    nothing = F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", nothing.alias("lang"), nothing.alias("source"), F.concat(F.lit("http://www.a."), F.col("lang"), F.lit("/x")).alias("url"))
    assert {r.site for r in of_documents(rows).collect()} == {f"a.{x}" for x in ("de", "en", "es", "fr")}
    known = docs.select(F.col("doc_id").alias("id"), "lang")
    table = of_documents(rows).join(known, "id").withColumn("declared", F.when(F.col("id") % 2 == 0, F.col("lang"))).drop("lang")
    got = identify(table).join(known.withColumnRenamed("lang", "true"), "id").where("id % 2 = 1").collect()
    alone, fused = sum(r.by_text == r.true for r in got), sum(r.lang == r.true for r in got)
    assert fused >= alone and fused >= 0.95 * len(got)


def test_keyed_joins_with_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    rows = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id % 40) END AS k", "id % 2 AS j")
    keyed = rows.where("k IS NOT NULL AND k <> 'k1'").groupBy("k", "j").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    for how in ("left", "inner"):
        got = sorted(map(tuple, join_keyed(rows, keyed, ["k", "j"], "n", 600, how).collect()), key=str)
        assert got == sorted(map(tuple, rows.join(keyed.drop("n"), ["k", "j"], how).select("id", "k", "j", "top").collect()), key=str)
