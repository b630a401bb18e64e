"""The driver's tables seen as chunks, notes and queries, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
#: Terms for text of invented words.
ENTITIES = ("able", "heit", "ment", "ring", "tion")
DECISIONS = ("tion ", "keit ", "ment ")
GENERIC = ("That", "This", "With")

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.to_timestamp(F.lit(NOW))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, access_count, ts (first access) from the events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("event_id") % 200).alias("id")).agg(F.count("*").alias("access_count"), F.min("ts").alias("ts"))


ACCESS = "SELECT event_id % 200 AS id, count(*) AS access_count, min(ts)::TIMESTAMP AS ts FROM events GROUP BY 1"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, project (the language), source, confidence, length, access_count, ts of all documents. Accesses are 200 rows of any number of events, so texts are not shuffled for them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("project"), "source", (0.5 + (F.col("doc_id") % 6) * 0.1).alias("confidence"), F.length("text").alias("length"))
    return d.join(F.broadcast(access(spark, sf_dir)), "id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0).cast("long")))


CHUNKS = f"""SELECT doc_id AS id, text, lang AS project, source, 0.5::DOUBLE + (doc_id % 6) * 0.1::DOUBLE AS confidence, length(text) AS length, coalesce(access_count, 0) AS access_count, ts
  FROM documents LEFT JOIN ({ACCESS}) a ON a.id = doc_id"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown: every line but the first becomes a paragraph, every other one a heading."""
    d = table(spark, sf_dir, "documents")
    heading = F.concat(F.lit("\n\n"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("## "))
    return d.select(F.col("doc_id"), F.replace(F.col("text"), F.lit("\n"), heading).alias("text"))


NOTES = r"SELECT doc_id, replace(text, chr(10), chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '## ' END) AS text FROM documents"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some with a date and some with a camel-case name in front."""
    d = table(spark, sf_dir, "documents")
    front = F.concat(F.when(F.col("doc_id") % 2 == 0, "2024-01-15 ").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "SparkEngine ").otherwise(""))
    return d.select("doc_id", "lang", "source", F.concat(front, F.col("text")).alias("text"))


MARKED = "SELECT doc_id, lang, source, CASE WHEN doc_id % 2 = 0 THEN '2024-01-15 ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'SparkEngine ' ELSE '' END || text AS text FROM documents"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: each benchmark passage as a whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


QUESTIONS = "SELECT item_id AS query_id, text FROM benchmark"


def question_list(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """The questions on the driver: they are one request, and bounded like one."""
    return [(r["query_id"], r["text"]) for r in questions(spark, sf_dir).collect()]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and vector: every row whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


PROBES = "SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS vector FROM embeddings WHERE vec_id % 50 = 0"

#: The similarity batch: vectors near to, in the middle of and far from the index, so that every decision occurs.
MIXED = """SELECT vec_id AS id, vec_id AS ordinal, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS embedding,
    CASE WHEN vec_id % 5 < 2 THEN 'user-memory' ELSE 'workspace-log' END AS source, ((vec_id * 7) % 10) / 10.0::DOUBLE AS confidence
  FROM (SELECT a.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda k: CASE a.vec_id % 3 WHEN 0 THEN 0.97 WHEN 1 THEN 0.88 ELSE 0.5 END::DOUBLE * a.embedding[k]::DOUBLE
      + CASE a.vec_id % 3 WHEN 0 THEN sqrt(1 - 0.97::DOUBLE * 0.97) WHEN 1 THEN sqrt(1 - 0.88::DOUBLE * 0.88) ELSE sqrt(0.75::DOUBLE) END * b.embedding[k]::DOUBLE) AS v
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
INDEX = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding, CASE WHEN vec_id % 3 = 0 THEN 'user-memory' ELSE 'workspace-log' END AS source, ((vec_id * 3) % 10) / 10.0::DOUBLE AS confidence FROM embeddings"


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", "embedding", F.when(F.col("id") % 3 == 0, "user-memory").otherwise("workspace-log").alias("source"), ((F.col("id") * 3) % 10 / 10.0).alias("confidence"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "embedding")
    after = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"))
    a = F.when(F.col("id") % 3 == 0, 0.97).when(F.col("id") % 3 == 1, 0.88).otherwise(0.5)
    b = F.when(F.col("id") % 3 == 0, F.sqrt(F.lit(1 - 0.97 * 0.97))).when(F.col("id") % 3 == 1, F.sqrt(F.lit(1 - 0.88 * 0.88))).otherwise(F.sqrt(F.lit(0.75)))
    raw = F.zip_with("embedding", "next", lambda x, y: a * x + b * y)
    norm = lambda y: F.sqrt(F.aggregate(F.transform(y, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    sized = F.transform(F.array(raw), lambda y: F.struct(y.alias("v"), norm(y).alias("norm")))  # bound, so that it is taken once a row and not for each component
    unit = F.element_at(F.transform(sized, lambda s: F.transform(s["v"], lambda x: x / s["norm"])), 1)
    rows = v.join(after, "id")
    return rows.select("id", F.col("id").alias("ordinal"), unit.alias("embedding"), F.when(F.col("id") % 5 < 2, "user-memory").otherwise("workspace-log").alias("source"), ((F.col("id") * 7) % 10 / 10.0).alias("confidence"))
