"""The corpus pipeline: from raw documents to tokens in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's documents. All stages but the last return the columns of documents.

Null and empty texts pass the classifier like others, are one empty line, have no shingles and so are
near duplicates of nothing, have no words and so are never taken into the mix. Rows with null or
repeated doc_id are documents of their own; of equal texts one row stays. Further columns of documents
are left out by the first stage, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm import op4_quality_classifier as op4
from mnemoflow.llm import op5_minhash_forest as op5
from mnemoflow.llm import op6_bpe_tree as op6
from mnemoflow.llm import op8_line_dedup as op8
from mnemoflow.llm import op10_mixing as op10
from mnemoflow.llm.scratch import mark, materialize, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The classifier is fitted on the labelled ones among the stage's documents."""
    model = op4.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op4.classify(docs, model, keep_rows=True).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for one copy; n_chars follows the text."""
    out = op8.line_dedup(docs, keep=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, one with the smallest doc_id (null last), and all rows without words."""
    docs = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = op5.near_dedup(docs.select(F.col("row").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    alone = found.where("n_shingles = 0").select("row")
    first = found.where("n_shingles > 0").join(docs.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    return docs.join(first.select("row").union(alone), "row", "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    out = op10.mix(docs, keep=("text", "lang", "n_chars"), keep_source=True)
    return out.where("times > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text."""
    return op6.bpe(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near_dups), ("mixing", mixing), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written into the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        began, written = mark(), f"stage_{name.replace(' ', '_')}"
        docs = materialize(stage(spark, docs, sf_dir), written)
        release(spark, began, keep=(written,))
    return docs
