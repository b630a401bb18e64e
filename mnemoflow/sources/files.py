"""Notes from directories: recursive scan, name patterns, incremental skip, encodings; gold sets."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoflow.functions import vocab


def _include(globs: Iterable[str]) -> str:
    """One regular expression over file names for some globs (* ? and character classes)."""
    one = lambda g: "".join(".*" if c == "*" else "." if c == "?" else c if c in "[]-" or c.isalnum() or c == "_" else re.escape(c) for c in g)
    return "^(?:" + "|".join(map(one, globs)) + ")$"


def _ignore(globs: Iterable[str]) -> str:
    """Names to leave out; only the beginning must match, and a dot stands for any character."""
    return "^(?:" + "|".join(g.replace("*", ".*").replace("?", ".") for g in globs) + ")"


def scan(spark: SparkSession, folders: Iterable[str], patterns: Iterable[str] = vocab.NOTE_PATTERNS, ignore: Iterable[str] = vocab.IGNORE_PATTERNS, with_content: bool = True) -> DataFrame:
    """path, name, mtime, size, ignored (and content) of each file once, in any folder below; folders that do not exist are dropped. Without content no file is opened."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(f)
        if path.getFileSystem(conf).exists(path):
            there.append(f)
    schema = "path string, modificationTime timestamp, length long, content binary"
    patterns = list(patterns)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if patterns and not any(set("{},") & set(p) for p in patterns):
        reader = reader.option("pathGlobFilter", "{" + ",".join(patterns) + "}")
    files = reader.load(there) if there else spark.createDataFrame([], schema)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("name", name).where(F.col("name").rlike(_include(patterns)))
    ignored = F.col("name").rlike(_ignore(ignore)) if list(ignore) else F.lit(False)
    return files.select("path", "name", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), ignored.alias("ignored"), *(["content"] if with_content else [])).dropDuplicates(["path"])


def read(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """path, mtime, size and content of files that a scan has listed."""
    escaped = [re.sub(r"([][{}*?\\])", r"\\\1", p) for p in paths]
    if not escaped:
        return spark.createDataFrame([], "path string, mtime timestamp, size long, content binary")
    return spark.read.format("binaryFile").load(escaped).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose time or size differs from the saved state (path, mtime, size), and new ones."""
    return files.join(state.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def unchanged(files: DataFrame, state: DataFrame) -> DataFrame:
    return files.join(state.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")


def new_state(files: DataFrame) -> DataFrame:
    """The state after a scan: the files that are there; vanished ones are gone."""
    return files.where("NOT ignored").select("path", "mtime", "size")


@F.pandas_udf(T.StringType())
def _gbk(content: pd.Series) -> pd.Series:
    return content.map(lambda b: b.decode("gbk", "ignore"))


def decode(files: DataFrame) -> DataFrame:
    """Adds text: UTF-8, or GBK (bad bytes dropped) for files that are not valid UTF-8."""
    text = F.col("content").cast("string")
    fine = files.withColumn("ok", F.coalesce(F.is_valid_utf8(text), F.lit(True)))
    return fine.where("ok").withColumn("text", F.coalesce(text, F.lit(""))).unionByName(fine.where("NOT ok").withColumn("text", _gbk("content"))).drop("ok", "content")


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, relevant_ids of a JSON-lines file; blank lines are skipped."""
    rows = spark.read.schema("query string, relevant_ids array<string>").json(path).where("query IS NOT NULL")
    return rows.select(F.substring(F.sha2("query", 256), 1, 16).alias("query_id"), "query", F.coalesce("relevant_ids", F.array().cast("array<string>")).alias("relevant_ids"))
