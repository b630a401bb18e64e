"""Retrieval quality over many queries at once: recall, reciprocal rank, discounted gain, latency percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoflow.sources.workspace import ensure_checkpoint_dir


def per_query(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10), ndcg_k: int = 10) -> DataFrame:
    """A row for each query of gold (query_id, relevant_ids) with its metrics over ranked (query_id, id, rank from 0).

    Queries without relevant ids count 0 and stay. Gain is binary; the ideal has min(relevant, k) hits.
    """
    gold = gold.select("query_id", F.array_distinct("relevant_ids").alias("relevant_ids"))
    want = gold.select("query_id", F.explode("relevant_ids").alias("id"))
    hits = ranked.join(want, ["query_id", "id"]).groupBy("query_id").agg(
        *[F.count_if(F.col("rank") < k).alias(f"hits_{k}") for k in ks], F.min("rank").alias("first"), F.sum(F.when(F.col("rank") < ndcg_k, 1 / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias("gain"),
    )
    n = F.size("relevant_ids")
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(ndcg_k)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    ratio = lambda top, bottom: F.when(n > 0, F.coalesce(top, F.lit(0.0)) / bottom).otherwise(0.0)
    return gold.join(hits, "query_id", "left").select(
        "query_id", *[ratio(F.col(f"hits_{k}"), n).alias(f"recall_{k}") for k in ks], F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"), ratio(F.col("gain"), ideal).alias(f"ndcg_{ndcg_k}"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in metrics.columns if c != "query_id"])


def percentiles(values: DataFrame, column: str, by: tuple[str, ...] = (), ps: dict[str, float] | None = None) -> DataFrame:
    """For each group the element at place floor(n * p), from 0, of its sorted values; nulls are left out.

    Values are counted, and dealt by ranges of group and value. The ranges' totals, a row for each range and
    group, tell which range has the wanted place; only that one is looked through. So no task has all values
    of a group, nor of the table where there are no groups.
    """
    ensure_checkpoint_dir(values.sparkSession)
    ps = ps or {"p50": 0.5, "p95": 0.95}
    counted = values.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    ranges = counted.repartitionByRange(*by, column).withColumn("range", F.spark_partition_id()).checkpoint()  # a range keeps its number
    w = Window.partitionBy(*(by or [F.lit(0)]))
    totals = ranges.groupBy(*by, "range").agg(F.sum("n").alias("own"), F.min(column).alias("least"))
    totals = totals.withColumns({"upto": F.sum("own").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("own").over(w)})
    place = lambda p: F.least(F.floor(F.col("total") * F.lit(p)), F.col("total") - 1)
    has = lambda p: (place(p) < F.col("upto")) & (place(p) >= F.col("upto") - F.col("own"))
    wanted = totals.where(reduce(lambda a, b: a | b, [has(p) for p in ps.values()])).select(*[F.col(c).alias(f"{c} of range") for c in by], F.col("range").alias("number"), "upto", "own", "total")
    same = [F.col(c).eqNullSafe(F.col(f"{c} of range")) for c in by]
    near = ranges.join(wanted, reduce(lambda a, b: a & b, [*same, F.col("range") == F.col("number")])).drop(*[f"{c} of range" for c in by])
    run = F.sum("n").over(Window.partitionBy(*by, "range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("until", F.col("upto") - F.col("own") + run)
    pick = lambda p: F.min(F.when(has(p) & (F.col("until") > place(p)), F.col(column)))
    return near.groupBy(*by).agg(*[pick(p).alias(name) for name, p in ps.items()])


def latency(times: DataFrame, column: str) -> DataFrame:
    return percentiles(times, column)


def report(summary_row: dict, title: str = "Retrieval evaluation") -> str:
    """The summary as a small markdown page; with ``date``, ``chunks`` and ``details`` (a row for each query), those too."""
    figures = {k: v for k, v in summary_row.items() if k not in ("date", "chunks", "details")}
    shown = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", ""]
    if "date" in summary_row:
        out += [f"{summary_row['date']}, {summary_row.get('chunks')} chunks", ""]
    out += ["| metric | value |", "|---|---|", *[f"| {k} | {shown(v)} |" for k, v in figures.items()]]
    if details := summary_row.get("details"):
        names = list(details[0])
        out += ["", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(shown(r[c]) for c in names) + " |" for r in details]]
    return "\n".join(out) + "\n"
