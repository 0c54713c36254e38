"""Nearest vectors by an inverted file: cells of a distributed k-means, exact distances inside them."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import spread
from ..storage import stored
from ..tasks import arrow_map
from ..versions import Versions

#: Vectors that the cells are fitted on, about; cells at most.
SAMPLE, MOST_CELLS = 50_000, 4_096
#: Share of the nearest vectors that a search shall find, as measured on about so many vectors of the index.
RECALL, MEASURED = 0.95, 200
#: Queries that go to every task at a time; more are asked in blocks, a pass over the index each.
QUERY_BLOCK = 2_000
#: Places to which distances are told and compared; equal ones go to the smaller id.
PLACES = 6


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column that are whole and ``width`` long, and their rows."""
    rows = [k for k, v in enumerate(column.to_pylist()) if v is not None and len(v) == width and None not in v]
    return np.array([column[k].as_py() for k in rows], float).reshape(-1, width), np.array(rows, np.int64)


def _assigned(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = held.value
        for batch in batches:
            vectors, rows = _matrix(batch.column(1), centers.shape[1])
            cell, far = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for a in range(0, len(rows), 1_000):
                d = ((vectors[a : a + 1_000] ** 2).sum(axis=1)[:, None] - 2 * vectors[a : a + 1_000] @ centers.T) + (centers**2).sum(axis=1)
                cell[a : a + 1_000] = d.argmin(axis=1)
            if len(rows):
                far = np.sqrt(((vectors - centers[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(vectors.tolist(), pa.list_(pa.float64())), pa.array(cell), pa.array(far)], ["vec_id", "vector", "cell", "far"])

    return run


def _nearest(held, top: int, apart: bool):
    """The best of each batch, for each query those in the cells it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, looks = held.value
        for batch in batches:
            vec_ids, cells = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            vectors = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, queries.shape[1]))
            best: dict[int, list[tuple[float, int]]] = {}
            for cell in np.unique(cells).tolist():
                inside, asking = np.flatnonzero(cells == cell), np.flatnonzero(looks[:, cell])
                for a in range(0, len(inside), 2_000):
                    some = inside[a : a + 2_000]
                    for q in asking.tolist():
                        d = np.round(np.sqrt(((vectors[some] - queries[q]) ** 2).sum(axis=1)), PLACES)
                        found = [(float(d[k]), int(vec_ids[some[k]])) for k in np.lexsort((vec_ids[some], d))[: top + 1] if not (apart and vec_ids[some[k]] == ids[q])]
                        best[q] = sorted(best.get(q, []) + found)[:top]
            out = [(int(ids[q]), v, d) for q, near in best.items() for d, v in near]
            columns = [*zip(*out)] if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "distance"])

    return run


class VectorIndex:
    """Vectors (``vec_id, vector``) below a folder, by cells.

    The cells are fitted once, on about `SAMPLE` vectors; every vector is indexed, those of later appends too, each
    append a segment that reads only what it adds. Rows without an id, and vectors that are null, hold a null
    or have another length than the first ones, are not. Ids are unique.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)
        self._probes: dict[tuple[int, int], int] = {}

    def append(self, rows: DataFrame, cells: int | None = None) -> int:
        """Index more vectors; the first time the cells are fitted, as many as the root of the number of vectors if not given."""
        version = self.versions.latest()
        entries = self.versions.entries(version)
        rows = rows.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
        if "cells" not in entries:
            entries["cells"] = self._fitted(rows, cells)
        centers = self._centers(entries)
        folder = self.versions.fresh()
        held = self.spark.sparkContext.broadcast(centers)
        arrow_map(spread(rows), _assigned(held), "vec_id long, vector array<double>, cell long, far double").write.parquet(folder)
        return self.versions.commit({**entries, f"segment-{len(entries):06d}": folder}, version)

    def _fitted(self, rows: DataFrame, cells: int | None) -> str:
        whole = rows.where("vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
        first = whole.select(F.size("vector").alias("n")).first()
        if first is None:
            raise ValueError("no vector to fit cells on")
        whole = whole.where(F.size("vector") == first["n"])
        n = whole.count()
        some = whole.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < max(int(SAMPLE / n * (1 << 20)), 1)) if n > SAMPLE else whole
        some = stored(some.select(array_to_vector("vector").alias("features")), "sample")
        wanted = min(cells or ceil(sqrt(n)), MOST_CELLS, max(some.count(), 1))
        model = KMeans(k=wanted, seed=7, maxIter=15).fit(some) if wanted > 1 else None
        centers = [c.tolist() for c in model.clusterCenters()] if model else [some.first()["features"].toArray().tolist()]
        folder = self.versions.fresh()
        # One row a cell, MOST_CELLS at most.
        self.spark.createDataFrame(list(enumerate(centers)), "cell long, center array<double>").coalesce(1).write.parquet(folder)
        return folder

    def _centers(self, entries: dict[str, str]) -> np.ndarray:
        return np.array([r["center"] for r in self.spark.read.parquet(entries["cells"]).orderBy("cell").collect()])

    def rows(self, version: int | None = None) -> DataFrame:
        entries = self.versions.entries(version)
        return self.spark.read.parquet(*[folder for name, folder in entries.items() if name != "cells"])

    def probes(self, top: int = 5) -> int:
        """Cells that a query must look into to find `RECALL` of its nearest vectors, by exact searches for about `MEASURED` vectors of the index."""
        version = self.versions.latest()
        if (version, top) not in self._probes:
            rows, centers = self.rows(), self._centers(self.versions.entries())
            share = max(int(MEASURED / max(rows.count(), 1) * (1 << 20)), 1)
            some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("probes")), F.lit(1 << 20)) < share).select(F.col("vec_id").alias("query_id"), "vector")
            near = self.search(some, top, probes=1, exact=True, apart=True).join(rows.select("vec_id", "cell"), "vec_id").join(some, "query_id").select("vector", "cell").collect()
            places = [int((((np.array(r["vector"]) - centers) ** 2).sum(axis=1).argsort() == r["cell"]).argmax()) + 1 for r in near]
            self._probes[version, top] = int(np.quantile(places, RECALL, method="higher")) if places else len(centers)
        return self._probes[version, top]

    def search(self, queries: DataFrame, top: int = 5, probes: int | None = None, exact: bool = False, apart: bool = False) -> DataFrame:
        """``query_id, vec_id, distance, rank``: the ``top`` nearest vectors of each query (``query_id, vector``).

        A query looks into the ``probes`` cells whose centers are nearest, as many as `probes` says if not given. exact: then into every other
        cell that may hold something nearer than what has been found, by the cell's center and radius, so
        nothing is missed. apart: a vector isn't its own neighbour. Queries that are null, hold a null or have another
        length find nothing. They come to the driver `QUERY_BLOCK` at a time and go to all tasks from there.
        """
        entries = self.versions.entries()
        probes = probes or (1 if exact else self.probes(top))
        asked = stored(queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), "queries")
        rows, centers = self.rows(), self._centers(entries)
        radius = np.zeros(len(centers))
        for r in rows.groupBy("cell").agg(F.max("far").alias("far")).collect():
            radius[r["cell"]] = r["far"]
        blocks, found = max(1, ceil(asked.count() / QUERY_BLOCK)), None
        for k in range(blocks):
            part = self._block(rows, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k), centers, radius, top, probes, exact, apart)
            found = part if found is None else found.unionByName(part)
        return found

    def _block(self, rows: DataFrame, asked: DataFrame, centers: np.ndarray, radius: np.ndarray, top: int, probes: int, exact: bool, apart: bool) -> DataFrame:
        listed = [r for r in asked.collect() if r["vector"] is not None and len(r["vector"]) == centers.shape[1] and None not in r["vector"]]
        ids, vectors = np.array([r["query_id"] for r in listed], np.int64), np.array([r["vector"] for r in listed]).reshape(-1, centers.shape[1])
        away = np.sqrt(((vectors[:, None, :] - centers[None]) ** 2).sum(axis=2)) if len(ids) * centers.size < 1 << 26 else np.stack([np.sqrt(((v - centers) ** 2).sum(axis=1)) for v in vectors])
        looks = np.zeros(away.shape, bool)
        np.put_along_axis(looks, np.argsort(away, axis=1)[:, :probes], True, axis=1)
        order = Window.partitionBy("query_id").orderBy("distance", "vec_id")

        def best(where: np.ndarray, also: DataFrame | None = None) -> DataFrame:
            held = self.spark.sparkContext.broadcast((ids, vectors, where))
            near = arrow_map(rows.select("vec_id", "vector", "cell"), _nearest(held, top, apart), "query_id long, vec_id long, distance double")
            near = near if also is None else near.unionByName(also.select("query_id", "vec_id", "distance"))
            return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

        first = best(looks)
        if not exact:
            return first
        first = stored(first, "nearest")
        bound = {r["query_id"]: r["d"] for r in first.where(F.col("rank") == top).select("query_id", F.col("distance").alias("d")).collect()}
        limit = np.array([bound.get(int(q), np.inf) for q in ids])
        more = (away - radius[None] <= limit[:, None] + 2 * 10.0**-PLACES) & ~looks
        return best(more, first)
