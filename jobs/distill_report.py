"""Distillation of a day: which chunks are kept, which may go, and the digest of each project.

``python -m jobs.distill_report CHUNKS LOG OUTPUT [--config FILE] [--as-of DAY]`` reads chunks and the
log of their accesses and writes, for one day,

- ``OUTPUT/verdicts/as_of=DAY``, partitioned by project: score, rank among the first of the project and
  verdict of every chunk;
- ``OUTPUT/digest/as_of=DAY``: the lines of each project's digest.

A day is one folder, which a rerun writes anew as a whole, so it never keeps rows of an earlier run.
Accesses are counted before they meet the chunks; texts are read for the first rows of projects alone.
"""

from __future__ import annotations

import argparse
import logging
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import settings as job_settings
from mnemoflow.operators import maintenance

log = logging.getLogger("jobs.distill_report")
VERDICTS = "id long, score double, rank int, verdict string, access_count long, as_of date, project string"


def scored(chunks: DataFrame, accesses: DataFrame, s: dict) -> DataFrame:
    """id, project, confidence, ts (first access) and access_count of all chunks, without their texts."""
    counts = accesses.where(F.col("chunk").isNotNull()).groupBy("chunk").agg(F.count("*").alias("access_count"), F.min("at").alias("ts"))
    rows = chunks.select(F.col(f"`{s['id']}`").cast("long").alias("id"), F.col(f"`{s['project']}`").cast("string").alias("project"), F.expr(s["confidence"]).cast("double").alias("confidence"))
    return rows.join(counts, F.col("id") == F.col("chunk"), "left").drop("chunk").withColumn("access_count", F.coalesce("access_count", F.lit(0).cast("long")))


def digest(verdicts: DataFrame, chunks: DataFrame, s: dict) -> DataFrame:
    """project, rank, line, fits of the first rows of each project. Their number follows that of projects: up to a bound the texts meet them by broadcast, beyond it by a shuffle."""
    first = verdicts.where(F.col("rank") <= maintenance.PROJECT_ROWS)
    few = first.count() <= s["broadcast_rows"]
    texts = chunks.select(F.col(f"`{s['id']}`").cast("long").alias("id"), F.col(f"`{s['text']}`").cast("string").alias("text"))
    return maintenance.digest_rows(texts.join(F.broadcast(first) if few else first, "id")).select("project", "rank", "line", "fits")


def read_verdicts(spark: SparkSession, output: str) -> DataFrame:
    """The verdicts of all days."""
    return spark.read.schema(VERDICTS).parquet(f"{output.rstrip('/')}/verdicts")


def distill(spark: SparkSession, chunks_path: str, log_path: str, output: str, s: dict | None = None) -> dict:
    """Writes the day's folders; what was read and written. Chunks without a project are one of their own; null ids are scored without accesses."""
    s, output = s or job_settings.load("distill_report"), output.rstrip("/")
    day = date.fromisoformat(s["as_of"]).isoformat()
    read, accessed, wrote, lines = Observation(), Observation(), Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    chunks = spark.read.parquet(chunks_path)
    accesses = spark.read.parquet(log_path).select(F.expr(s["accessed_chunk"]).alias("chunk"), F.col(f"`{s['accessed_at']}`").cast("timestamp").alias("at"))
    rows = scored(chunks.observe(read, count), accesses.observe(accessed, count), s)
    judged = maintenance.distill(rows, F.to_timestamp(F.lit(day)), top=s["top"], purge_below=s["purge_below"], tau_days=s["tau_days"])
    out = judged.select("id", "score", "rank", "verdict", "access_count", "project").observe(wrote, count, F.count_if(F.col("verdict") == "purge").alias("purge"))
    out.write.mode("overwrite").partitionBy("project").parquet(f"{output}/verdicts/as_of={day}")
    log.info("%s: %d chunks and %d accesses read, %d verdicts written, %d of them purge", day, read.get["n"], accessed.get["n"], wrote.get["n"], wrote.get["purge"])
    written = read_verdicts(spark, output).where(F.col("as_of") == F.lit(day).cast("date"))
    digest(written, chunks, s).observe(lines, count).write.mode("overwrite").parquet(f"{output}/digest/as_of={day}")
    log.info("%s: %d lines of digests written to %s/digest", day, lines.get["n"], output)
    return {"chunks_read": read.get["n"], "accesses_read": accessed.get["n"], "verdicts": wrote.get["n"], "purge": wrote.get["purge"], "digest_lines": lines.get["n"]}


def main() -> None:
    p = argparse.ArgumentParser(prog="jobs.distill_report", description="Verdicts and digests of a day.")
    for name, text in (("chunks", "Parquet of the chunks"), ("log", "Parquet of the accesses"), ("output", "folder of verdicts and digests")):
        p.add_argument(name, help=text)
    p.add_argument("--config", help="TOML file over jobs/distill_report.toml")
    p.add_argument("--as-of", help="the day, as 2024-02-01")
    a = p.parse_args()
    job_settings.to_stderr()
    spark = SparkSession.builder.appName("distill_report").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        distill(spark, a.chunks, a.log, a.output, job_settings.load("distill_report", a.config, as_of=a.as_of))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
