"""Nearest neighbours of every hundredth vector among all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.vectors import VectorIndex
from ..sources.tables import read_table
from ..storage import fresh_path


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of all vectors indexed first, the others appended; the search looks until nothing can be missed."""
    vectors = read_table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding AS vector")
    index = VectorIndex(spark, fresh_path(spark, "vectors"))
    index.append(vectors.where("vec_id % 3 <> 1"))
    index.append(vectors.where("vec_id % 3 = 1"))
    return index.search(vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), exact=True, apart=True)


NEAREST = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, vec_id, distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= 5
"""

QUERIES = {"nearest_vectors": nearest_vectors}
ORACLES = {"nearest_vectors": NEAREST}
