"""Continuous ingest: new note files reach the memory in micro-batches.

The file source reports a path once; edits in place are picked up by the incremental scan, which
compares times and sizes. Each micro-batch is judged against the store as it is then; the store notes the
last one of each checkpoint, so a batch that comes again after it was taken changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemoflow.functions import vocab
from mnemoflow.sources import files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def notes_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """path, mtime, size, content of files as they appear, with the usual names only."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.where(name.rlike(files._include(vocab.NOTE_PATTERNS)) & ~name.rlike(files._ignore(vocab.IGNORE_PATTERNS))).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def watch(memory, folder: str, checkpoint: str, every: str | None = "5 seconds", project: str | None = None) -> StreamingQuery:
    """Starts ingesting the folder into the memory; ``every`` None takes what is there and stops."""

    store, stream = memory.store, checkpoint.rstrip("/")

    def take(batch: DataFrame, number: int) -> None:
        done = store.streams.read().where(F.col("id") == stream).take(1)
        if done and number <= done[0]["batch"]:
            return
        memory.ingest_files(batch, project)
        store.streams.change(memory.spark.createDataFrame([(stream, number)], "id string, batch long"))

    writer = notes_stream(memory.spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
