"""Access counts by a stream: the log is counted once, by windows of time, and read by what asks for counts.

A window is written once, when the watermark (the latest access seen, less ``late``) has passed its end; then its
state goes. Rows that come after that are left out, as are rows without a time. Counts of now are those of the
written windows and of the log's rows behind the last of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(log: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """(chunk_id, opened, closed, access_count, last_access) of a stream of the log (chunk_id, accessed_at)."""
    found = log.withWatermark("accessed_at", late).groupBy(F.window("accessed_at", every), "chunk_id").agg(F.count("*").alias("access_count"), F.max("accessed_at").alias("last_access"))
    return found.select("chunk_id", F.col("window.start").alias("opened"), F.col("window.end").alias("closed"), "access_count", "last_access")


def roll_up(log: DataFrame, output: str, checkpoint: str, late: str = "1 hour", every: str = "1 day") -> None:
    """Takes what is new in the log, writes the windows that are over, and waits for the end. The checkpoint knows what was taken; a run that dies is finished by the next one."""
    query = windows(log, late, every).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    try:
        query.awaitTermination()
    finally:
        query.stop()


def counts(log: DataFrame, closed: DataFrame, mine: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """(chunk_id, access_count, last_access) of written windows and the log's later rows, for those chunks that ``mine`` leaves.

    The only row that goes to all tasks is the end of the last window, which is that of all chunks.
    """
    last = closed.agg(F.max("closed").alias("until"))
    tail = mine(log, "chunk_id").join(F.broadcast(last), F.col("until").isNull() | (F.col("accessed_at") >= F.col("until")))
    tail = tail.groupBy("chunk_id").agg(F.count("*").alias("access_count"), F.max("accessed_at").alias("last_access"))
    both = mine(closed, "chunk_id").select("chunk_id", "access_count", "last_access").unionByName(tail)
    return both.groupBy("chunk_id").agg(F.sum("access_count").alias("access_count"), F.max("last_access").alias("last_access"))


def read_windows(spark: SparkSession, output: str) -> DataFrame:
    """All windows that runs have written."""
    return spark.read.schema("chunk_id string, opened timestamp, closed timestamp, access_count long, last_access timestamp").parquet(output)
