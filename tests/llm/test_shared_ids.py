"""Stages decide on each row, also where ids repeat or are null."""

from collections import Counter

from pyspark.sql import functions as F

from sievemill.llm.language_id import keep_identified
from sievemill.llm.mixing import mix, mixed_documents


def test_null_ids_of_two_sources_are_mixed_apart(spark):
    docs = [(None, "a b c", "A"), (None, "d e f", "B"), (None, "", "A")]
    docs += [(7, "g h", "A"), (7, "i j k", "B")] + [(i, "w " * 4, "C") for i in range(100, 140)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    # Rows of mix() hold no text; here the size and the source's size tell them apart.
    want = Counter()
    for r in mix(table).collect():
        if r.taken:
            want[r.doc_id, r["size"], r.source_size] += r.taken // r["size"]
    sizes = {"A": 5, "B": 6, "C": 160}
    got = Counter((r.doc_id, len(r.text.split()), sizes[r.source]) for r in mixed_documents(table).collect())
    assert got == want
    assert all(n <= 2 for n in got.values() if n) and mixed_documents(table).columns == table.columns


def test_a_rejected_row_takes_no_other_with_it(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    none = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    odd = spark.createDataFrame([(None, "", "en", "src0"), (2, "123", "en", "src0"), (None, None, None, None)], docs.schema)
    assert keep_identified(none.unionByName(odd)).count() == docs.count()
