"""Exact top-k search by columnar branch-and-bound.

Candidates stream through each task in blocks that are laid out by dimension. Queries come in waves
of bounded size, which every task has whole. For a block and some queries, inner products grow one
group of dimensions at a time; after each group the remaining mass (the product of the norms over
the dimensions not yet seen, by Cauchy and Schwarz) bounds what a candidate can still reach, and
candidates that cannot reach the query's k-th best score any more are compacted away. A task emits k
rows a query at most; the final ranking is one grouped window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import materialize

#: Queries in a wave; candidates in a block; dimensions in a group; candidates that give a first k-th best score.
WAVE, BLOCK, GROUP, PILOT = 32768, 4096, 8, 512
_LEAST = np.iinfo(np.int64).min


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as long; null if the vector or a component is null or not finite."""
    v = F.transform(embedding.cast("array<double>"), lambda x: F.floor(F.lit(scale) * x))
    fine = F.forall(embedding.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, v)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of longs; shorter ones are filled up with zeros, longer ones are cut (a product with zero adds nothing)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row[at < dims], at[at < dims]] = values[at < dims]
    return out


def _tail_norms(by_dim: np.ndarray) -> np.ndarray:
    """tail[g]: norms over the dimensions from group g on, rounded up a little."""
    squares = np.add.reduceat(by_dim.astype(np.float64) ** 2, np.arange(0, len(by_dim), GROUP), axis=0)
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1]) * (1 + 1e-9)


class _Best:
    """The k best (score, smaller vec_id first) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.least = np.full(len(ids), _LEAST, np.int64)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = ids != self.ids[q]
        s, i = np.concatenate([self.found[q][0], scores[own]]), np.concatenate([self.found[q][1], ids[own]])
        best = np.lexsort((i, -s))[: self.k]
        self.found[q] = s[best], i[best]
        if len(best) == self.k:
            self.least[q] = s[best[-1]]


def _search(queries: np.ndarray, best: _Best, vectors: np.ndarray, ids: np.ndarray) -> None:
    """Takes a block of candidates into ``best``."""
    exact = np.float64 if float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1] < 2**53 else np.int64
    by_dim = np.ascontiguousarray(vectors.T, dtype=exact)
    tails = _tail_norms(by_dim)
    groups = range(0, len(by_dim), GROUP)
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256].astype(exact)
        q_tails = _tail_norms(part.T)
        first = part[:, :GROUP] @ by_dim[:GROUP]
        for x in range(len(part)):
            q, score, alive = a + x, first[x], None
            for g, d in enumerate(groups[1:], 1):
                least = best.least[q]
                if least > _LEAST:
                    fine = score + q_tails[g, x] * (tails[g] if alive is None else tails[g][alive]) >= least - 1e-6 * abs(float(least))
                    alive = np.flatnonzero(fine) if alive is None else alive[fine]
                    score = score[fine]
                    if not len(alive):
                        break
                column = by_dim[d : d + GROUP] if alive is None else by_dim[d : d + GROUP, alive]
                score = score + part[x, d : d + GROUP] @ column
            if len(score):
                fine = score >= best.least[q]
                if fine.any():
                    best.add(q, score[fine].astype(np.int64), (ids if alive is None else ids[alive])[fine])


def _task(q_ids: np.ndarray, q_vectors: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(q_ids, k)
        pilot = PILOT
        for batch in batches:
            i = 0
            while i < batch.num_rows:
                part = batch.slice(i, pilot)
                _search(q_vectors, best, _matrix(part.column(1), q_vectors.shape[1]), part.column(0).to_numpy(zero_copy_only=False))
                i, pilot = i + part.num_rows, BLOCK
        sizes = [len(s) for s, _ in best.found]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([i for _, i in best.found])), pa.array(np.concatenate([s for s, _ in best.found]))], ["query_id", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k candidates with the highest inner product of each query, but for the query's own row.

    vectors, queries: vec_id (long) and vector (array of long); other columns are not read. Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Rows whose id or vector is null take no part. Rows that share the query's vec_id are its own. Of
    query rows with the same vec_id the one with the smallest vector counts; repeated candidates are
    candidates each. Where lengths differ, missing components count as 0. Empty tables give no rows;
    with fewer than k candidates all are returned.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where("vec_id IS NOT NULL AND vector IS NOT NULL")
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where("vec_id IS NOT NULL AND vector IS NOT NULL")
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n = queries.count()
    waves = max(1, math.ceil(n / WAVE))
    schema = "query_id long, vec_id long, score long"
    found: list[DataFrame] = []
    for w in range(waves if n else 0):
        wave = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).toArrow().combine_chunks()
        if not wave.num_rows:
            continue
        column = wave["vector"].combine_chunks()
        dims = max(1, max(column.value_lengths().to_pylist()))
        part = vectors.mapInArrow(_task(wave["vec_id"].to_numpy(), _matrix(column, dims), k), schema)
        found.append(materialize(part, "topk") if waves > 1 else part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return topk(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
