"""The jobs as queries over the driver's tables, each run twice into the same new folder, with the SQL of what is there then."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import distill_report, note_ingest
from jobs import settings as job_settings
from mnemoflow.functions import vocab
from mnemoflow.plans import catalog
from mnemoflow.plans import views as v
from mnemoflow.sources.workspace import fresh_folder


def job1_note_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "job1")  # the table is one file or a folder of files; a file stream takes one file by a pattern only
    for _ in range(2):
        note_ingest.ingest(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/out", f"{folder}/checkpoint")
    c = note_ingest.read_chunks(spark, f"{folder}/out")
    return c.select(F.col("note").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), "text_hash", F.col("length").cast("long").alias("length"), F.round("confidence", 6).alias("confidence"), "source", "project")


def job2_distill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "job2")
    for _ in range(2):
        distill_report.distill(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/events.parquet", folder)
    r = distill_report.read_verdicts(spark, folder)
    return r.select("id", "project", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "verdict", "access_count", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"))


_KEYS = "|".join(map(re.escape, vocab.KEY_TERMS))
_DECIDED = " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in vocab.DECISION_WORDS)
_S = job_settings.load("distill_report")
SQL = {
    "job1_note_ingest": rf"""WITH l AS (SELECT doc_id, list_filter(flatten(list(l ORDER BY para)), lambda x: length(x) >= 8 OR regexp_matches(lower(x), '{_KEYS}')) AS l
    FROM ({catalog._PIECES.replace(v.NOTES, "SELECT doc_id, text FROM documents")}) GROUP BY doc_id),
  c AS (SELECT doc_id, unnest(range(len(l))) AS ordinal, unnest(l) AS text FROM l),
  h AS (SELECT *, substr(md5(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) AS text_hash FROM c),
  f AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id, ordinal) AS n FROM h)
SELECT doc_id, ordinal, text_hash, length(text) AS length, CASE WHEN starts_with(text, '#') THEN 'user-memory' ELSE 'unknown' END AS source, coalesce(nullif(lang, ''), '{note_ingest.NO_PROJECT}') AS project,
  round(least(0.5::DOUBLE + CASE WHEN length(text) > 50 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN {_DECIDED} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(text, '[A-Z][a-z]+(?:[A-Z][a-z]+)+') THEN 0.1::DOUBLE ELSE 0 END, 1), 6) AS confidence
FROM f JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE n = 1""",
    "job2_distill_report": f"""SELECT id, project, round(score, 6) AS score, CASE WHEN rank <= {_S["top"]} THEN rank END AS rank, verdict, access_count, '{_S["as_of"]}' AS as_of
  FROM (SELECT *, CASE WHEN rank <= {_S["top"]} THEN 'keep' WHEN score < {_S["purge_below"]} THEN 'purge' ELSE 'stay' END AS verdict FROM ({catalog._DISTILL}))""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_note_ingest": job1_note_ingest, "job2_distill_report": job2_distill_report}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
