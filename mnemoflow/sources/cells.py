"""Exact nearest neighbours over stored cells: partitions that cannot hold a result are not read.

Rows lie in Parquet partitions by their nearest centroid. A cell knows how near and how far its rows are
from the centroid, so by the triangle inequality a query has a least distance to all of them. A search reads the
cells that seem nearest until they have k rows, and then those alone whose least distance does not
exceed the k-th distance found. Centroids are fitted on a bounded sample; they decide what is read, never what is
found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from mnemoflow.operators import vector

#: Cells at most; rows that the centroids are fitted on, by hash of their ids; passes of fitting; rows of a file at most.
MOST_CELLS, SAMPLE, PASSES, ROWS_OF_A_FILE = 1024, 8192, 8, 262_144


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of the sample's rows around each centre, from its first rows on; a centre without rows stays."""
    centres = sample[:cells].copy()
    for _ in range(PASSES):
        nearest = distances(sample, centres).argmin(1)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows to all centres."""
    return np.sqrt(np.maximum((rows**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * rows @ centres.T, 0))


class VectorCells:
    """A folder with rows (id, embedding, ...) by cell, and the table of the cells, which is written last."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        #: What the last search read: cells of its first and second part, and how many there are.
        self.seen = {"first": 0, "second": 0, "cells": 0}

    def build(self, rows: DataFrame) -> None:
        """Writes all rows that have a vector; any other columns come along. Crowded cells become several files, written by several tasks."""
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>")).where("embedding IS NOT NULL").drop("cell", "gap")
        n = rows.count()
        some = rows.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).collect()
        centres = centroids(np.array([r[0] for r in some], float), max(1, min(MOST_CELLS, math.isqrt(n) // 2, len(some)))) if some else np.zeros((0, 0))
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
        arrow, at = to_arrow_schema(schema), rows.columns.index("embedding")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, vector.TILE):
                    part = batch.slice(i, vector.TILE)
                    v = vector.matrix(part.column(at))
                    cell = distances(v, centres).argmin(1)
                    gap = np.sqrt(((v - centres[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(gap)], names=arrow.names)

        dealt = rows.mapInArrow(assign, schema).hint("rebalance", "cell")
        dealt.write.mode("overwrite").option("maxRecordsPerFile", ROWS_OF_A_FILE).partitionBy("cell").parquet(f"{self.folder}/rows")
        found = self._rows(schema).groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))
        centre = self.spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(centres)], "cell int, centre array<double>")
        found.join(F.broadcast(centre), "cell").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cells")

    def _rows(self, schema=None) -> DataFrame:
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.folder}/rows")

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """(query_id, id, distance, rank from 0) like ``knn``, over the rows for which ``where`` holds.

        Queries without a vector find nothing. Up to 4,096 queries go to the tasks; more of them would need
        nearly all cells anyway and take the way of ``knn`` over all rows.
        """
        cells = self.spark.read.parquet(f"{self.folder}/cells").orderBy("cell").collect()
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        some = asked.limit(vector.BATCH + 1).collect()
        if not some or not cells:
            schema = f"query_id {dict(queries.dtypes)['query_id']}, id {self._id_type() if cells else 'string'}, distance double, rank int"
            return self.spark.createDataFrame([], schema)
        rows = self._rows()
        rows = rows if where is None else rows.where(where)
        if len(some) > vector.BATCH:
            self.seen = {"first": len(cells), "second": 0, "cells": len(cells)}
            return vector.knn(rows, queries, k)
        ids, vectors = pa.array([r[0] for r in some], to_arrow_type(queries.schema["query_id"].dataType)), np.array([r[1] for r in some], float)
        number, n = np.array([c["cell"] for c in cells]), np.array([c["n"] for c in cells])
        far = distances(vectors, np.array([c["centre"] for c in cells], float))
        bound = np.maximum(far - np.array([c["most"] for c in cells]), np.array([c["least"] for c in cells]) - far)
        bound = np.maximum(bound - 1e-6 * (1 + far), 0)  # distances by products are rounded
        first = np.zeros(bound.shape, bool)
        for q, order in enumerate(np.lexsort((far, bound))):
            first[q, order[: 1 + np.searchsorted(n[order].cumsum(), k)]] = True
        found = self._near(rows, ids, vectors, first, number, k, queries).checkpoint()
        worst = {r[0]: r[1] for r in found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance"))).collect()}
        limit = np.array([np.inf if worst.get(r[0]) is None else math.sqrt(worst[r[0]]) for r in some])
        second = (bound <= limit[:, None]) & ~first
        self.seen = {"first": int(first.any(0).sum()), "second": int((second.any(0) & ~first.any(0)).sum()), "cells": len(cells)}
        if second.any():
            found = self._best(found.drop("rank").union(self._near(rows, ids, vectors, second, number, k, queries).drop("rank")), k)
        return found

    def _id_type(self) -> str:
        return dict(self._rows().dtypes)["id"]

    def _near(self, rows: DataFrame, ids: pa.Array, vectors: np.ndarray, visits: np.ndarray, number: np.ndarray, k: int, queries: DataFrame) -> DataFrame:
        """The k nearest of each query in the cells that it visits; other cells' files are pruned."""
        asked = {int(c): np.flatnonzero(visits[:, i]) for i, c in enumerate(number) if visits[:, i].any()}
        compare = vector._nearest(k, to_arrow_type(rows.schema["id"].dataType))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell).tolist():
                    yield from compare(ids.take(pa.array(asked[c])), vectors[asked[c]])(iter([batch.filter(pa.array(cell == c))]))

        read = rows.where(F.col("cell").isin(list(asked))).select("id", "embedding", "cell")
        return self._best(read.mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, distance double"), k)

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
