"""Write-time near-duplicate decisions: insert, merge or skip.

``decide`` judges a batch against a frozen index. ``decide_in_order`` gives what a strictly sequential
writer would: two rows can only influence each other by rows that are similar to both, so those that wait for
nothing are decided at the same time, round by round (``rounds``). Pairs that a row of the batch is in are
found as blocks of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoflow.functions import scalar
from mnemoflow.operators import rounds
from mnemoflow.operators.vector import knn, meet, tiles
from mnemoflow.sources.workspace import arrow_rows

MERGE_AT, SKIP_AT = 0.92, 0.85
#: Pairs whose distances are computed at once.
PAIRS = 65_536


def search_width(rows: int, wanted: int = 50, most: int = 200, large: int = 1000, large_width: int = 25) -> int:
    """How many neighbours a writer looks at; only shown in reports, as the nearest one alone decides."""
    if rows == 0:
        return 0
    return min(large_width, rows, most) if rows > large else min(wanted, rows, most)


def search_width_of(rows: Column, wanted: int = 50, most: int = 200, large: int = 1000, large_width: int = 25) -> Column:
    """``search_width`` as a column."""
    return F.when(rows > large, F.least(F.lit(large_width), rows, F.lit(most))).otherwise(F.least(F.lit(wanted), rows, F.lit(most))).cast("long")


def decision(sim: Column, new_source: Column, old_source: Column, new_conf: Column, old_conf: Column, merge_at: float = MERGE_AT, skip_at: float = SKIP_AT) -> Column:
    """insert without a similar row; a summary never replaces details; else the higher confidence wins, ties to the new row."""
    new_level, old_level = scalar.level_of(F.coalesce(new_source, F.lit("unknown"))), scalar.level_of(F.coalesce(old_source, F.lit("unknown")))
    alike = F.when((new_level == "summary") & (old_level == "full"), "skip").when(new_conf >= old_conf, "merge").otherwise("skip")
    return F.when(sim.isNull(), "insert").when(sim >= merge_at, alike).when(sim >= skip_at, "skip").otherwise("insert")


def decide(batch: DataFrame, index: DataFrame, merge_at: float = MERGE_AT, skip_at: float = SKIP_AT) -> DataFrame:
    """(id, decision, existing_id, similarity) of each row of the batch against the index as it is.

    Both have id, embedding, source, confidence. Similarity is the cosine with the nearest row by L2.
    """
    near = knn(index, batch.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 1)
    old = index.select(F.col("id").alias("existing_id"), F.col("embedding").alias("old_v"), F.col("source").alias("old_source"), F.col("confidence").alias("old_conf"))
    best = near.select(F.col("query_id").alias("id"), F.col("id").alias("existing_id")).join(old, "existing_id")
    out = batch.join(best, "id", "left").withColumn("similarity", scalar.cosine(F.col("embedding"), F.col("old_v")))
    verdict = decision(F.col("similarity"), F.col("source"), F.col("old_source"), F.coalesce(F.col("confidence"), F.lit(0.5)), F.coalesce(F.col("old_conf"), F.lit(0.5)), merge_at, skip_at)
    return out.select("id", verdict.alias("decision"), "existing_id", "similarity")


def _alike(least: float):
    names = ["a", "b", "far", "sim"]

    def compare(ids: pa.Array, vectors: np.ndarray):
        unit = lambda v: (v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]).astype(np.float32)
        own, rough = unit(vectors), least - 1e-9 - (vectors.shape[1] + 8) * 2.0**-22  # single precision finds no pair less, and double precision decides

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in tiles(batches):
                i, j = np.nonzero(own @ unit(rows).T >= rough)
                for at in range(0, len(i), PAIRS):
                    p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                    a, b, v, w = ids.take(pa.array(p)), part.column(0).take(pa.array(q)), vectors[p], rows[q]
                    sim = (v * w).sum(1) / np.maximum(np.linalg.norm(v, axis=1) * np.linalg.norm(w, axis=1), 1e-300)
                    some = pa.RecordBatch.from_arrays([a, b, pa.array(((v - w) ** 2).sum(1)), pa.array(sim)], names)
                    yield some.filter(pc.and_(pc.or_(pc.starts_with(b, "i"), pc.less(a, b)), pa.array(sim >= least - 1e-9)))

        return run

    return compare


def links(batch: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """(a, b, far, sim): the pairs of ``similar_pairs`` with their squared distance and cosine."""
    schema = "a string, b string, far double, sim double"
    found = meet(batch, index.union(batch), _alike(least), schema)
    return batch.sparkSession.createDataFrame([], schema) if found is None else found


def similar_pairs(batch: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """(a, b) of cosine ``least`` or more, of rows (node, v): each row of the batch with the index, and the batch's own pairs once. Rows of the index are not compared with each other.

    Nodes of the batch begin with another letter than those of the index, whose is an i.
    """
    return links(batch, index, least).select("a", "b")


def decide_in_order(batch: DataFrame, index: DataFrame, merge_at: float = MERGE_AT, skip_at: float = SKIP_AT) -> DataFrame:
    """(id, decision, existing_id, similarity) as a sequential writer decides; existing_id and similarity are null below ``skip_at``.

    batch: id, ordinal (a number or a string that sorts), embedding, source, confidence; index: the same but
    ordinal. Equal vectors of the batch are compared once. Rows of the batch that are similar to nothing,
    also those without a vector or with one of zeros, are inserted without Python; the others are decided in rounds.
    Vectors have unit length, as embedders give them, so that the nearest row is the most similar one. Rows of
    the index without a vector are met by none.
    """
    kinds = dict(batch.dtypes)
    kind = kinds["id"]
    conf = F.coalesce(F.col("confidence"), F.lit(0.5)).alias("confidence")
    one = lambda df, mark, *more: df.select(F.concat(F.lit(mark), F.col("id").cast("string")).alias("node"), "id", F.col("embedding").cast("array<double>").alias("v"), "source", conf, *more)
    points = lambda df: df.where("v IS NOT NULL AND exists(v, x -> x <> 0)")
    new, old = one(batch, "b:", "ordinal").checkpoint(), points(one(index, "i:"))
    classes = points(new).groupBy("v").agg(F.min("node").alias("c"), F.count("*").alias("same")).checkpoint()
    with arrow_rows(batch.sparkSession, rounds.ROWS):
        found = links(classes.select(F.col("c").alias("node"), "v"), old.select("node", "v"), skip_at).checkpoint()
    there = found.select(F.col("a").alias("c"), F.col("b").alias("x"), "far", "sim")
    back = found.where("b NOT LIKE 'i:%'").select(F.col("b").alias("c"), F.col("a").alias("x"), "far", "sim")
    busy = there.union(back).select("c").union(classes.where("same > 1").select("c")).distinct()
    own = busy.select("c", F.col("c").alias("x"), F.lit(0.0).alias("far"), F.lit(1.0).alias("sim"))
    near = there.union(back).union(own).checkpoint()
    some = points(new).join(classes.select("v", "c"), "v").join(busy, "c", "left_semi").drop("v").checkpoint()
    alone = new.join(some.select("node"), "node", "left_anti").select("id", F.lit("insert").alias("decision"), F.lit(None).cast(kind).alias("existing_id"), F.lit(None).cast("double").alias("similarity"))
    if some.isEmpty():
        return alone
    met = near.where("x LIKE 'i:%'").select(F.col("x").alias("node")).distinct()
    slots = old.join(met, "node", "left_semi").select(F.col("node").alias("x"), F.col("id").alias("slot"), "source", "confidence").checkpoint()
    return alone.union(rounds.decide(some, near, slots, merge_at, skip_at))


def changes(batch: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows that a batch leaves behind, under their ids: inserted ones, and merged ones under the id of the row they met.

    Where several rows merge into one, the last by ordinal counts; so does a merge over the insert that it met.
    """
    b = batch.drop("existing_id").join(decisions.select("id", "decision", "existing_id"), "id").where("decision <> 'skip'")
    last = Window.partitionBy("to").orderBy(F.col("decision") == "insert", F.desc("ordinal"))
    b = b.withColumn("to", F.when(F.col("decision") == "merge", F.col("existing_id")).otherwise(F.col("id"))).withColumn("nth", F.row_number().over(last)).where("nth = 1")
    return b.select(F.col("to").alias("id"), *[c for c in batch.columns if c not in ("id", "existing_id", "ordinal")])


def decision_counts(decisions: DataFrame, *by) -> DataFrame:
    """How often each decision was taken, by some columns."""
    return decisions.groupBy(*by, "decision").agg(F.count("*").alias("n"))
