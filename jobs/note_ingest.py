"""Incremental ingest of notes: new files are cut into chunks, and each different chunk text is kept once.

``python -m jobs.note_ingest SOURCE OUTPUT CHECKPOINT [--config FILE]`` takes the Parquet files of SOURCE
(a folder or a pattern) that no run has taken yet, and ends. A file stream with its checkpoint knows them; each micro-batch writes

- ``OUTPUT/chunks``, partitioned by batch and project: the chunks whose text is in no earlier batch, the
  first of equal texts in the order of note and place;
- ``OUTPUT/seen``, a table in buckets of the texts' hashes, which the next batches are joined with. It is
  read where it lies: only the hashes of the new chunks are shuffled.

A batch that is run again, after a failure between those two or before the checkpoint, overwrites its own
partitions and compares itself with earlier batches alone, so it gives the same rows. Equal texts are
brought together by an aggregation that starts in the tasks that read, so a line which a third of all
notes share is one row for each of them before it is shuffled.
"""

from __future__ import annotations

import argparse
import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import settings as job_settings
from mnemoflow.functions import scalar
from mnemoflow.operators import chunking

log = logging.getLogger("jobs.note_ingest")
CHUNKS = "note string, ordinal int, id string, text string, text_hash string, length int, confidence double, source string, entities array<string>, batch long, project string"
NO_PROJECT = "none"


def cut(notes: DataFrame, s: dict) -> DataFrame:
    """Chunks of notes (note, text, project) with what is read off them. Null and blank notes give none."""
    # Note and project go together through the chunker as its key.
    keyed = notes.select(F.struct("note", "project").alias("key"), "text")
    found = chunking.metadata(chunking.chunk_notes(keyed, "key", s["min_length"], s["max_length"], s["json_blocks"]))
    return found.select(F.col("key.note").alias("note"), "ordinal", "id", "text", scalar.text_hash(F.col("text")).alias("text_hash"), "length", "confidence", "source", "entities", F.col("key.project").alias("project"))


def first_of_each(chunks: DataFrame) -> DataFrame:
    """The first chunk of each text by the note's id and the place in it; notes without an id come last."""
    order = F.struct(F.col("note").isNull(), F.col("note").cast("long").isNull(), F.col("note").cast("long"), "note", "ordinal", "project")
    return chunks.groupBy("text_hash").agg(F.min_by(F.struct(*[c for c in chunks.columns if c != "text_hash"]), order).alias("row")).select("text_hash", "row.*")


def not_in(first: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """The chunks whose text is not known (text_hash).

    They are dealt like the table of known texts, so that it is not shuffled, whatever the session's number
    of partitions is. An anti-join would be pushed below the aggregation, and shuffle all equal texts.
    """
    return first.repartition(buckets, "text_hash").join(known.withColumn("known", F.lit(True)), "text_hash", "left").where("known IS NULL").drop("known")


class _Seen:
    """The table of known texts under a name of its own, for one batch; the name goes, the files stay."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.name = spark, f"seen_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (text_hash STRING, batch LONG) USING parquet CLUSTERED BY (text_hash) SORTED BY (text_hash) INTO {int(buckets)} BUCKETS LOCATION '{path}'")

    def __enter__(self) -> str:
        return self.name

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def read_chunks(spark: SparkSession, output: str) -> DataFrame:
    """All chunks that runs have written."""
    return spark.read.schema(CHUNKS).parquet(f"{output.rstrip('/')}/chunks")


def ingest(spark: SparkSession, source: str, output: str, checkpoint: str, s: dict | None = None) -> dict:
    """Takes what is new at the source and waits for the end; what was read and written, by this run. Nothing new is fine."""
    s, output = s or job_settings.load("note_ingest"), output.rstrip("/")
    done = {"batches": 0, "notes_read": 0, "chunks_cut": 0, "chunks_written": 0}

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession  # the stream's own; without this rule the counts of a batch that gives nothing stay
        spark.conf.set("spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation")
        read, made, kept = Observation(), Observation(), Observation()
        count = F.count(F.lit(1)).alias("n")
        chunks = cut(batch.observe(read, count), s).observe(made, count)
        with _Seen(spark, f"{output}/seen", s["buckets"]) as seen:
            known = spark.table(seen).where(F.col("batch") < number).select("text_hash")
            new = not_in(first_of_each(chunks), known, s["buckets"]).withColumn("batch", F.lit(number)).observe(kept, count)
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            new.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "project").parquet(f"{output}/chunks")
            read_chunks(spark, output).where(F.col("batch") == number).select("text_hash", "batch").write.insertInto(seen)
        for name, n in (("batches", 1), ("notes_read", read.get["n"]), ("chunks_cut", made.get["n"]), ("chunks_written", kept.get["n"])):
            done[name] += n
        log.info("batch %d: %d notes read, %d chunks cut, %d new ones written to %s/chunks", number, read.get["n"], made.get["n"], kept.get["n"], output)

    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if s["max_files"]:
        reader = reader.option("maxFilesPerTrigger", s["max_files"])
    col = lambda c: F.col(f"`{c}`").cast("string")
    notes = reader.parquet(source).select(col(s["id"]).alias("note"), col(s["text"]).alias("text"), F.coalesce(F.nullif(col(s["project"]), F.lit("")), F.lit(NO_PROJECT)).alias("project"))
    log.info("new files of %s, as the checkpoint %s knows them", source, checkpoint)
    query = notes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("%s", done)
    return done


def main() -> None:
    p = argparse.ArgumentParser(prog="jobs.note_ingest", description="Chunks of the notes that are new since the last run.")
    for name, text in (("source", "folder or pattern of Parquet files with notes"), ("output", "folder of the chunks"), ("checkpoint", "folder of the stream's progress")):
        p.add_argument(name, help=text)
    p.add_argument("--config", help="TOML file over jobs/note_ingest.toml")
    p.add_argument("--max-files", type=int)
    a = p.parse_args()
    job_settings.to_stderr()
    spark = SparkSession.builder.appName("note_ingest").getOrCreate()
    try:
        ingest(spark, a.source, a.output, a.checkpoint, job_settings.load("note_ingest", a.config, max_files=a.max_files))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
