"""The inverted file against all pairs: recall of the first cells, exact search, appends, odd vectors."""

import numpy as np
import pytest

from sievemill.operators import vectors
from sievemill.operators.vectors import VectorIndex

SCHEMA = "vec_id long, vector array<double>"


def by_hand(rows, queries, top, apart):
    out = {}
    for q, v in queries:
        near = sorted((round(float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), 6), i) for i, x in rows if not (apart and i == q))
        out[q] = [i for _, i in near[:top]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_and_exact_search(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id", "embedding AS vector")
    rows = [(r.vec_id, r.vector) for r in given.collect()]
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.append(given)
    assert index.rows().count() == len(rows)  # every vector is indexed
    queries = given.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    want = by_hand(rows, [(i, v) for i, v in rows if i % 100 == 0], 5, True)
    got = found(index.search(queries, apart=True))
    recall = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    print("recall at 5:", recall)
    assert recall >= 0.9
    assert found(index.search(queries, exact=True, apart=True, probes=1)) == want


@pytest.mark.parametrize("block", [2_000, 3])
def test_clusters_ties_and_odd_vectors(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) + 8 * (k % 5)).tolist()) for k in range(600)] + [(1000 + k, [1.0] * 6) for k in range(300)]
    odd = [(2000, None), (2001, [1.0, 2.0]), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [0.0] * 6)]
    index = VectorIndex(spark, f"{tmp_path}/o")
    index.append(spark.createDataFrame(rows[:400], SCHEMA).repartition(3))
    index.append(spark.createDataFrame(rows[400:] + odd, SCHEMA))
    asked = [(k, v) for k, v in rows if k % 60 == 0] + [(7_000, [4.0] * 6)]
    queries = spark.createDataFrame([(k, v) for k, v in asked] + [(8_000, None), (8_001, [1.0])], "query_id long, vector array<double>")
    assert found(index.search(queries, top=7, exact=True, probes=1)) == by_hand(rows, asked, 7, False)
    assert index.rows().count() == len(rows) and set(found(index.search(queries, top=1_000_000, exact=True))[7_000]) == {k for k, _ in rows}


def test_nothing_to_fit(spark, tmp_path):
    with pytest.raises(ValueError, match="no vector"):
        VectorIndex(spark, f"{tmp_path}/n").append(spark.createDataFrame([(1, None)], SCHEMA))
    one = VectorIndex(spark, f"{tmp_path}/1")
    one.append(spark.createDataFrame([(1, [0.5])], SCHEMA))
    assert found(one.search(spark.createDataFrame([(5, [0.0])], "query_id long, vector array<double>"))) == {5: [1]}
