"""Dense search over an inverted file of vectors: k-means cells, of which a query reads the nearest.

The centroids are fitted on a bounded sample; every row is put into the cell of its nearest centroid, and the rows are
written cell by cell. A search compares a query with the rows of its `probe` nearest cells alone. With all cells it finds what
`retrieval.dense_topk` finds, which stays the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftmill.operators import retrieval
from siftmill.operators.retrieval import ranked
from siftmill.sources.index import Index, View

#: Rows that centroids are fitted on at most, and similarities that a task holds at once.
SAMPLE_ROWS, SLICE_NUMBERS = 100_000, 2_000_000
STORED = "cell int, chunk_id string, vector array<float>"


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


class VectorCells:
    """Cells under a folder: `centroids`, a few rows, and `rows`, one folder a cell.

    A null or zero vector has no cosine and is in no cell.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, seed: int = 1, version: int = -1) -> VectorCells:
        """Fit `cells` centroids on a sample of at most `sample_rows` rows and write all rows (chunk_id, vector) into their cells.

        The sample is the rows with the smallest hashes of their ids, so that the same rows give the same cells. `version`
        is that of the index the rows were read from. A large cell is written as several files.
        """
        usable = rows.select("chunk_id", F.col("vector").cast("array<float>").alias("vector")).where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))
        sample = usable.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(sample_rows)
        found = [r[0] for r in sample.select("vector").limit(1).collect()]
        if found:
            units = sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
            model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine", initMode="k-means||").fit(units)
            centroids = _unit(np.array(model.clusterCenters(), np.float64))
        else:
            centroids = np.zeros((0, 1))
        said = [(k, [float(x) for x in c], version) for k, c in enumerate(centroids)]
        self.spark.createDataFrame(said, "cell int, centroid array<double>, version int").coalesce(1).write.parquet(f"{self.path}/centroids")
        shared = self.spark.sparkContext.broadcast(centroids)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    nearest = (vectors @ shared.value.T).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(nearest), batch.column(0), batch.column(1)], names=["cell", "chunk_id", "vector"])

        placed = usable.mapInArrow(place, STORED) if found else self.spark.createDataFrame([], STORED)
        placed.hint("rebalance", "cell").sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{self.path}/rows")
        return self

    def centroids(self) -> tuple[np.ndarray, int]:
        """The centroids, by number, and the version of the index that the cells were made from."""
        rows = sorted(self.spark.read.schema("cell int, centroid array<double>, version int").parquet(f"{self.path}/centroids").collect())  # `cells` rows
        return np.array([r["centroid"] for r in rows], np.float64), rows[0]["version"] if rows else -1

    def topk(self, queries: DataFrame, n: int, probe: int | None = None, digits: int | None = None, keep: DataFrame | None = None, told: dict | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank of the n most similar rows in each query's `probe` nearest cells (None: in all).

        Ties are broken by chunk_id. Files of cells that no query probes are not read. `keep` (chunk_id) restricts the rows.
        Queries are a stated set that is taken in blocks, as in `dense_topk`. `told` gets the numbers of cells, and of cells read.
        """
        centroids, _ = self.centroids()
        kind = queries.schema["query_id"].dataType
        schema, key = f"query_id {kind.simpleString()}, chunk_id string, score double", to_arrow_type(kind)
        rows = self.spark.read.schema(STORED).parquet(f"{self.path}/rows") if len(centroids) else self.spark.createDataFrame([], STORED)
        if keep is not None:
            rows = rows.join(retrieval.small(keep), "chunk_id", "left_semi")
        probe = len(centroids) if probe is None else min(probe, len(centroids))
        read: set[int] = set()

        def scan(block: list[tuple[object, list[float]]]) -> DataFrame:
            matrix = np.array([v for _, v in block], np.float64)
            near = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probe]
            of: dict[int, np.ndarray] = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
            read.update(of)
            shared = self.spark.sparkContext.broadcast(([q for q, _ in block], matrix, np.linalg.norm(matrix, axis=1), of))

            def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, matrix, norms, of = shared.value
                for batch in batches:
                    cells = batch.column(0).to_numpy(zero_copy_only=False)
                    vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    for cell in np.unique(cells).tolist():
                        asking, mine = of[cell], np.flatnonzero(cells == cell)
                        step = max(n, SLICE_NUMBERS // len(asking))
                        for lo in range(0, len(mine), step):
                            at = mine[lo : lo + step]
                            with np.errstate(divide="ignore", invalid="ignore"):
                                scores = (vectors[at] @ matrix[asking].T) / np.linalg.norm(vectors[at], axis=1)[:, None] / norms[asking][None, :]
                            if digits is not None:
                                np.round(scores, digits, out=scores)
                            for k, q in enumerate(asking.tolist()):
                                some = np.flatnonzero(~np.isnan(scores[:, k]))
                                if len(some) > n:
                                    some = some[scores[some, k] >= np.partition(scores[some, k], len(some) - n)[len(some) - n]]
                                if len(some):
                                    yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(some), key), batch.column(1).take(pa.array(at[some])), pa.array(scores[some, k])], names=["query_id", "chunk_id", "score"])

            return rows.where(F.col("cell").isin([int(c) for c in of])).select("cell", "chunk_id", "vector").mapInArrow(best, schema)

        parts = [scan(block) for block in retrieval.query_blocks(queries)] if len(centroids) else []
        if told is not None:
            told |= {"cells": len(centroids), "read": len(read)}
        return ranked(reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema), n)


    def tune(self, queries: DataFrame, n: int, target: float = 0.95, most: int = 1000) -> int:
        """The fewest cells with which the mean recall of the n best over some queries reaches the target.

        At most `most` queries are asked, those with the smallest hashes of their ids; their exact hits, n each, tell how far down each
        query's order of cells they lie. How many cells it takes is a property of the vectors: without clusters, most of them.
        """
        centroids, _ = self.centroids()
        asked = queries.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("query_id")).limit(most)
        hits = self.topk(asked, n)
        rows = self.spark.read.schema(STORED).parquet(f"{self.path}/rows") if len(centroids) else self.spark.createDataFrame([], STORED)
        placed = rows.select("chunk_id", "cell").join(F.broadcast(hits.select("query_id", "chunk_id")), "chunk_id").select("query_id", "cell")  # most * n rows
        found = placed.join(F.broadcast(asked.select("query_id", F.col("vector").cast("array<double>").alias("vector"))), "query_id").toPandas()
        if not len(found):
            return len(centroids)
        order = np.argsort(-(np.array(found["vector"].tolist()) @ centroids.T), axis=1, kind="stable")
        depth = pd.Series((order == found["cell"].to_numpy()[:, None]).argmax(axis=1) + 1).groupby(found["query_id"].to_numpy())
        for probe in range(1, len(centroids) + 1):
            if depth.apply(lambda d, p=probe: (d <= p).mean()).mean() >= target:
                return probe
        return len(centroids)


def build_for(index: Index, path: str, cells: int, sample_rows: int = SAMPLE_ROWS, view: View | None = None) -> VectorCells:
    """Cells of the live vectors of an index."""
    view = view or index.view()
    return VectorCells(index.spark, path).build(index.read(view).select("chunk_id", "vector"), cells, sample_rows, version=view.last)


def dense_topk(index: Index, cells: VectorCells, queries: DataFrame, n: int, probe: int | None = None, where: Column | None = None, digits: int | None = None, view: View | None = None) -> DataFrame:
    """`retrieval.dense_topk` of an index over its cells: rows that came after the cells were made are compared exactly.

    Rows that later versions replaced or took out are not found, whatever the cells hold.
    """
    view = view or index.view()
    _, made = cells.centroids()
    fresh = index.since(made, view)
    if where is not None:
        fresh = fresh.where(where)
    old = index.until(made, view)
    restricted = where is not None or any(v > made for v, _ in view.versions)
    held = cells.topk(queries, n, probe, digits, (old if where is None else old.where(where)).select("chunk_id") if restricted else None)
    late = retrieval.dense_topk(fresh, queries, n, None, digits)
    names = ["query_id", "chunk_id", "score"]
    return ranked(held.select(*names).unionByName(late.select(*names)), n)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of each query's exact hits (query_id, chunk_id) that were found."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("_f")), ["query_id", "chunk_id"], "left")
    return hits.groupBy("query_id").agg((F.count("_f") / F.count("*")).alias("recall"))
