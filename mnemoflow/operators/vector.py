"""Exact nearest neighbours of any number of queries over any number of chunks.

A task multiplies its chunks with a block of queries as one matrix product, keeps the k nearest of every
query and a margin for rounding, and settles those exactly; so what is shuffled of the results is k rows
a query and task, and never a pair for each chunk. Up to ``BATCH`` queries go to all tasks, and the
chunks are read where they are; more queries meet the chunks in a grid of blocks, and none of it comes to
the driver. Filters on the chunks come before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries that are sent to all tasks at most, and in one matrix product; chunks of a cell of the grid; chunks in one matrix product.
BATCH, BLOCK, TILE = 4096, 65_536, 1024
#: Queries of a cell of the grid; bytes of the queries, and of the chunks, of a cell; cells for each core at least, so that they even out.
WIDE, SIDE_BYTES, CELLS = 32_768, 64 << 20, 3


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches (id, vector) with their vectors as a matrix."""
    for batch in batches:
        for i in range(0, batch.num_rows, TILE):
            part = batch.slice(i, TILE)
            yield part, matrix(part.column(1))


def meet(queries: DataFrame, rows: DataFrame, compare: Callable, schema: str) -> DataFrame | None:
    """compare(ids, vectors)(batches) for all queries (id, vector) against all rows (id, vector, ...); null without queries.

    compare gives a function over Arrow batches of rows, whose results may come in any number of parts.
    """
    q, _ = queries.columns
    some = queries.limit(BATCH + 1).collect()
    if not some:
        return None
    if len(some) <= BATCH:
        return rows.mapInArrow(compare(pa.array([r[0] for r in some]), np.array([r[1] for r in some], float)), schema)
    n, m, most = queries.count(), rows.count(), max(1, SIDE_BYTES // (8 * max(1, len(some[0][1]))))
    cells = CELLS * queries.sparkSession.sparkContext.defaultParallelism
    across = max(1, math.ceil(n / min(WIDE, most)), round(math.sqrt(cells * n / max(1, m))))
    down = max(1, math.ceil(m / min(BLOCK, most)), math.ceil(cells / across))
    dealt = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).alias("own")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("met")
    nothing = lambda df: F.lit(None).cast(df.schema[0].dataType)
    left = queries.select("*", dealt(q, across), every(down)).select((F.col("own") * down + F.col("met")).alias("cell"), F.lit(0).alias("side"), F.col(q).alias("q"), nothing(rows).alias("r"), F.col(queries.columns[1]).alias("v"))
    right = rows.select(*rows.columns[:2], dealt(rows.columns[0], down), every(across)).select(F.col("met") * down + F.col("own"), F.lit(1), nothing(queries), F.col(rows.columns[0]), F.col(rows.columns[1]))
    both = left.union(right).repartition(across * down, "cell").sortWithinPartitions("cell", "side")
    return both.mapInArrow(_by_cell(compare), schema)


def _by_cell(compare: Callable):
    """Rows (cell, side, q, r, v), in order of cell and side: the queries (side 0) of each cell with its chunks (side 1). Only one cell is held, and what it gives is sent in parts."""

    def one(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        first = int(np.searchsorted(table["side"].to_numpy(), 1))
        ids, vectors = table["q"].slice(0, first).combine_chunks(), matrix(table["v"].slice(0, first)) if first else None
        chunks = table.slice(first).select(["r", "v"]).to_batches()
        for i in range(0, first, BATCH) if chunks else ():
            yield from compare(ids.slice(i, BATCH), vectors[i : i + BATCH])(iter(chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and a < b and held[0].column(0)[0].as_py() != cell[a]:
                    yield from one(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from one(held)

    return run


def _nearest(k: int, id_type: pa.DataType):
    names = ["query_id", "id", "distance"]

    def compare(ids: pa.Array, vectors: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, twice = (vectors**2).sum(1), -2 * vectors
            cut = np.full(len(vectors), np.inf)
            kept = None
            for part, rows in tiles(batches):
                if rows.shape[1] != vectors.shape[1]:
                    raise ValueError(f"vectors have {rows.shape[1]} components, queries {vectors.shape[1]}")
                near = twice @ rows.T
                near += (rows**2).sum(1)
                near += own[:, None]
                kth = near.min(1) if k == 1 else np.partition(near, k - 1, axis=1)[:, k - 1] if len(rows) > k else np.inf
                bound = np.minimum(cut, kth)
                q, j = np.nonzero(near <= (bound + 1e-9 * (1 + own + np.where(np.isfinite(bound), bound, 0)))[:, None])
                new = (q, ((rows[j] - vectors[q]) ** 2).sum(1), np.array(part.column(0).to_pylist())[j])
                q, distance, name = new if kept is None else (np.concatenate(x) for x in zip(kept, new, strict=True))
                order = np.lexsort((name, distance, q))
                q, distance, name = q[order], distance[order], name[order]
                first = np.searchsorted(q, np.arange(len(vectors)))
                best = np.arange(len(q)) - first[q] < k
                last = np.arange(len(q)) - first[q] == k - 1
                cut[q[last]] = distance[last]
                kept = q[best], distance[best], name[best]
            if kept:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept[0])), pa.array(kept[2].tolist(), id_type), pa.array(kept[1])], names)

        return run

    return compare


def knn(chunks: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank from 0): squared L2 distance, nearest first, ties by id.

    queries: query_id and vector; those without a vector find nothing, and chunks without one are not
    found. Filters such as a project belong on ``chunks``.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    rows = chunks.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(chunks.dtypes)[id_col]}, distance double"
    id_type = to_arrow_type(rows.schema["id"].dataType)
    out = meet(asked, rows, _nearest(k, id_type), schema)
    if out is None:
        return chunks.sparkSession.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
