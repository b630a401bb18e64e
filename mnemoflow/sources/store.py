"""The chunk store: versioned Parquet tables, an append-only access log, and an index that follows the chunks.

Every change writes a new folder and never touches those being read; a folder counts once its success
marker is there. Counts of accesses come from the log, so searches never rewrite chunks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.operators import maintenance
from mnemoflow.sources.folders import VersionedTable
from mnemoflow.sources.live_index import LiveIndex
from mnemoflow.streaming import access

CHUNKS = "id string, text string, ts timestamp, project string, source string, confidence double, entities array<string>, length int, embedding array<double>, block_type string, json_key string, memory_type string"
WINDOWS = "access_windows"
ACCESS = "chunk_id string, accessed_at timestamp, query string"


class ChunkStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        table = lambda name, schema: VersionedTable(spark, f"{self.folder}/{name}", schema)
        self.table = table("chunks", CHUNKS)
        self.scan_state = table("scan_state", "path string, mtime timestamp, size long")
        self.distill_state = table("distill_state", "last_distill_ts double, last_total_chunks long")
        self.streams = table("streams", "id string, batch long")
        self.index = LiveIndex(spark, f"{self.folder}/index", self.table)

    def chunks(self) -> DataFrame:
        """All chunks; a missing project is '' and missing entities are an empty list."""
        return self.table.read().withColumns({"project": F.coalesce("project", F.lit("")), "entities": F.coalesce("entities", F.array().cast("array<string>"))})

    def _has(self, name: str) -> bool:
        fs, path = self.table._fs()
        return fs.exists(path(f"{self.folder}/{name}"))

    def access_log(self) -> DataFrame:
        return self.spark.read.schema(ACCESS).parquet(f"{self.folder}/access_log") if self._has("access_log") else self.spark.createDataFrame([], ACCESS)

    def roll_up_access(self, late: str = "1 hour", every: str = "1 day") -> None:
        """Counts what is new in the log by windows of time; from then on counts are read from them, and of the log only what is later. One run at a time."""
        if self._has("access_log"):
            log = self.spark.readStream.schema(ACCESS).parquet(f"{self.folder}/access_log")
            access.roll_up(log, f"{self.folder}/{WINDOWS}", f"{self.folder}/{WINDOWS}_checkpoint", late, every)

    def access_windows(self) -> DataFrame:
        return access.read_windows(self.spark, f"{self.folder}/{WINDOWS}")

    def with_access(self, ids: list[str] | None = None) -> DataFrame:
        """The chunks, or those of a list of ids that is short enough for a filter on the files, with access_count and last_access."""
        mine = lambda df, c: df if ids is None else df.where(F.col(c).isin(ids) if ids else F.lit(False))
        log = self.access_log()
        found = access.counts(log, self.access_windows(), mine) if self._has(f"{WINDOWS}/_spark_metadata") else maintenance.access_counts(mine(log, "chunk_id"))
        counts = found.withColumnRenamed("chunk_id", "id")
        return mine(self.chunks(), "id").join(counts, "id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))

    def record_access(self, hits: DataFrame, now: Column) -> None:
        """Logs one access for each row (id, and query_text if there is one)."""
        text = F.col("query_text") if "query_text" in hits.columns else F.lit(None).cast("string")
        hits.select(F.col("id").alias("chunk_id"), now.alias("accessed_at"), text.alias("query")).write.mode("append").parquet(f"{self.folder}/access_log")

    def _follow(self, number: int) -> int:
        """The index takes a change in, if there is one."""
        if self.index.segments():
            self.index.catch_up()
        return number

    def append(self, rows: DataFrame) -> int:
        """More chunks; a chunk with an id that is there replaces it."""
        return self._follow(self.table.change(rows))

    def replace(self, rows: DataFrame) -> int:
        """A whole version that is exactly these chunks."""
        return self._follow(self.table.write(rows))

    def update(self, rows: DataFrame) -> int:
        """Replaces text, vector and metadata of chunks that are there; ids and accesses stay. Unknown ids are left out."""
        return self._follow(self.table.change(rows.join(self.table.read("id"), "id", "left_semi")))

    def delete(self, ids: Iterable[str] | DataFrame) -> int:
        """Removes chunks; absent ids are fine."""
        return self._follow(self.table.change(ids.select("id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string"), gone=True))

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The chunks of some ids, with their accesses."""
        return self.with_access().join(ids.select("id").distinct(), "id", "left_semi")

    def get(self, key: str) -> dict | None:
        rows = self.with_access([key]).take(1)
        return rows[0].asDict(recursive=True) if rows else None

    def by_project(self, project: str) -> DataFrame:
        return self.chunks().where(F.col("project") == project)

    def relabel_unknown(self, **words) -> int:
        return self._follow(self.table.write(maintenance.relabel_unknown(self.chunks(), **words)))

    def rebuild_postings(self) -> int:
        """Writes the index of the current chunks anew, from where it follows every change; returns how many rows it has."""
        return self.index.rebuild()

    def has_postings(self) -> bool:
        """Whether the index is that of the current chunks."""
        return self.index.covers()

    def stats(self) -> dict:
        return maintenance.stats(self.chunks())

    def files(self) -> DataFrame:
        """path and length of the store's files."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.folder).select("path", "length")
