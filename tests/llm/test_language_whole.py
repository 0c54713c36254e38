"""Evidence from every declared value and suffix; texts in no known language are rejected."""

import math

from sievemill.llm.language_id import fuse, identify_documents

OTHERS = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura ché la diritta via era smarrita",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
]


def test_rare_suffixes_are_evidence(spark):
    rows = [(k, f"s{k % 1500:04d}", 30, [-10.0, -10.2, -14.0, -14.0] if k < 3000 else [-10.0, -11.0, -14.0, -14.0]) for k in range(3001)]
    table = spark.createDataFrame(rows, "id long, suffix string, grams long, ll array<double>").selectExpr("*", "CAST(NULL AS string) AS host", "CAST(NULL AS string) AS site", "CAST(NULL AS string) AS declared")
    got = {r.id: r.posterior for r in fuse(table).collect()}
    seen = {0: 3, 1499: 2}
    prior = [(3001 + 1) / 3005] + [1 / 3005] * 3
    for k, n in seen.items():
        score = [ll + math.log(p) + math.log(((n if j == 0 else 0) + 1) / ((3001 if j == 0 else 0) + 1500 + 1)) for j, (ll, p) in enumerate(zip(rows[k][3], prior))]
        assert abs(got[k] - 1 / sum(math.exp(x - score[0]) for x in score)) < 1e-9


def test_other_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-k - 1, x, "it", "src0") for k, x in enumerate(OTHERS)], docs.schema)
    got = identify_documents(docs.unionByName(odd)).collect()
    assert {(r.lang, r.kept) for r in got if r.doc_id < 0} == {("und", False)}
    assert all(r.lang != "und" for r in got if r.doc_id >= 0)
