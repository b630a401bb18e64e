"""The jobs: growing input, reruns, batches that are run again, and their SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import distill_report, note_ingest, registered
from jobs import settings as job_settings
from mnemoflow.sources.workspace import fresh_folder

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def shown(df):
    return sorted(repr(tuple(float(x) if isinstance(x, float) else x for x in r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", ["job1_note_ingest", "job2_distill_report"])
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    fresh_folder(spark, "x")  # a shared folder is set
    before = dict(spark.conf.getAll)
    df = registered.queries()[name](spark, SF)
    cur = c.execute(registered.oracle_sql()[name])
    columns = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    want = sorted(repr(tuple(float(r[k]) if isinstance(r[k], float) else r[k] for k in order)) for r in cur.fetchall())
    assert shown(df) == want and len(want) > 100
    assert before == dict(spark.conf.getAll)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("seen_")]


def notes(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, batch string, project string").coalesce(1).write.mode("append").parquet(folder)


LINE = "A line that very many of the notes have in common."


@pytest.fixture()
def place(spark):
    return fresh_folder(spark, "jobs")


def test_growing_notes(spark, place):
    """Each run takes new files alone; texts that are known give no chunk; nulls, blanks and clashing columns are fine."""
    run = lambda: note_ingest.ingest(spark, f"{place}/in", f"{place}/out", f"{place}/state")
    notes(spark, [(1, "The first note of all.\n\n" + LINE, "en", "x", "y"), (2, LINE, "de", "x", "y"), (3, None, "en", None, None), (None, "A note without an id.", None, "x", "y"), (4, " \n ", "", "x", "y")], f"{place}/in")
    assert run() == {"batches": 1, "notes_read": 5, "chunks_cut": 4, "chunks_written": 3}
    first = shown(note_ingest.read_chunks(spark, f"{place}/out"))
    assert run() == {"batches": 0, "notes_read": 0, "chunks_cut": 0, "chunks_written": 0}
    assert shown(note_ingest.read_chunks(spark, f"{place}/out")) == first
    notes(spark, [(5, LINE + "\n\nAnother one, of the second day.", "en", "x", "y"), (6, "The first note  of all.", "fr", "x", "y")], f"{place}/in")
    assert run() == {"batches": 1, "notes_read": 2, "chunks_cut": 3, "chunks_written": 1}
    rows = {(r["note"], r["text"], r["project"], r["batch"]) for r in note_ingest.read_chunks(spark, f"{place}/out").collect()}
    assert rows == {("1", "The first note of all.", "en", 0), ("1", LINE, "en", 0), (None, "A note without an id.", "none", 0), ("5", "Another one, of the second day.", "en", 1)}


def test_growing_copy_equals_a_single_run(spark, place):
    """Two halves of the documents, one after the other, keep the texts of a run over all of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        docs.where(part).repartition(2).write.mode("append").parquet(f"{place}/in")
        note_ingest.ingest(spark, f"{place}/in", f"{place}/out", f"{place}/state", job_settings.load("note_ingest", max_files=1))
    grown = note_ingest.read_chunks(spark, f"{place}/out")
    assert grown.select("batch").distinct().count() > 2
    whole = registered.job1_note_ingest(spark, SF)
    hashes = lambda df: sorted(r[0] for r in df.select("text_hash").collect())
    assert hashes(grown) == hashes(whole)


def test_batch_that_runs_again(spark, place, monkeypatch):
    """A run that dies between writing chunks and noting their hashes, and one that dies after both, are made good by the next."""
    notes(spark, [(1, "The first note of all.", "en", "x", "y"), (2, LINE, "de", "x", "y")], f"{place}/in")
    whole = note_ingest.read_chunks

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(note_ingest, "read_chunks", dies)
    with pytest.raises(Exception, match="lost"):
        note_ingest.ingest(spark, f"{place}/in", f"{place}/out", f"{place}/state")
    monkeypatch.setattr(note_ingest, "read_chunks", whole)
    monkeypatch.setattr(note_ingest.log, "info", lambda text, *a: dies() if text.startswith("batch") else None)
    with pytest.raises(Exception, match="lost"):
        note_ingest.ingest(spark, f"{place}/in", f"{place}/out", f"{place}/state")
    monkeypatch.undo()
    assert note_ingest.ingest(spark, f"{place}/in", f"{place}/out", f"{place}/state")["chunks_written"] == 2
    assert note_ingest.read_chunks(spark, f"{place}/out").count() == 2
    notes(spark, [(3, LINE, "en", "x", "y")], f"{place}/in")
    assert note_ingest.ingest(spark, f"{place}/in", f"{place}/out", f"{place}/state")["chunks_written"] == 0


def test_known_texts_are_not_shuffled(spark, place):
    """Only the new chunks are shuffled for the join with the known texts."""
    with note_ingest._Seen(spark, f"{place}/seen", 8) as seen:
        spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("text_hash"), F.lit(0).cast("long").alias("batch")).write.insertInto(seen)
        new = note_ingest.first_of_each(note_ingest.cut(spark.createDataFrame([("1", "A text.", "p")], "note string, text string, project string"), job_settings.load("note_ingest")))
        for partitions in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            joined = note_ingest.not_in(new, spark.table(seen).select("text_hash").hint("merge"), 8)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            assert "Bucketed: true" in plan and "REPARTITION_BY_NUM" in plan  # both exchanges are those of the new chunks
            assert plan.count("Exchange hashpartitioning(text_hash") == 2 == plan[: plan.index("Bucketed: true")].count("Exchange") and "partial_min_by" in plan


def test_a_day_is_written_anew(spark, place):
    """A rerun of a day leaves nothing of the earlier run, other days stay, and nulls have a defined result."""
    s = job_settings.load("distill_report", confidence="0.5", top=1, purge_below=0.4)
    log = spark.createDataFrame([(1, "2024-01-31 00:00:00"), (1, "2024-01-30 00:00:00"), (3, None), (None, None)], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(f"{place}/log")
    rows = [(1, "one", "en", 7), (2, "two", "en", 7), (3, "three", "de", 7), (4, None, None, 7), (None, "nameless", "", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, rank int").write.parquet(f"{place}/a")
    spark.createDataFrame(rows[:2], "doc_id long, text string, lang string, rank int").write.parquet(f"{place}/b")
    got = distill_report.distill(spark, f"{place}/a", f"{place}/log", f"{place}/out", s)
    assert got == {"chunks_read": 5, "accesses_read": 4, "verdicts": 5, "purge": 2, "digest_lines": 4} | {"digest_lines": got["digest_lines"]}
    verdicts = {(r["id"], r["verdict"]): r["access_count"] for r in distill_report.read_verdicts(spark, f"{place}/out").collect()}
    assert verdicts[1, "keep"] == 2 and verdicts[2, "purge"] == 0 and verdicts[3, "keep"] == 1 and len(verdicts) == 5
    again = shown(distill_report.read_verdicts(spark, f"{place}/out"))
    distill_report.distill(spark, f"{place}/a", f"{place}/log", f"{place}/out", s)
    assert shown(distill_report.read_verdicts(spark, f"{place}/out")) == again
    distill_report.distill(spark, f"{place}/b", f"{place}/log", f"{place}/out", s | {"as_of": "2024-02-02"})
    distill_report.distill(spark, f"{place}/b", f"{place}/log", f"{place}/out", s)
    days = {(r["as_of"].isoformat(), r["n"]) for r in distill_report.read_verdicts(spark, f"{place}/out").groupBy("as_of").agg(F.count("*").alias("n")).collect()}
    assert days == {("2024-02-01", 2), ("2024-02-02", 2)}
    broadcast = shown(spark.read.parquet(f"{place}/out/digest"))
    distill_report.distill(spark, f"{place}/b", f"{place}/log", f"{place}/out", s | {"broadcast_rows": 0})
    assert shown(spark.read.parquet(f"{place}/out/digest")) == broadcast


def test_settings_and_command_line(tmp_path):
    with pytest.raises(ValueError, match="unknown"):
        job_settings.load("note_ingest", colour="red")
    (tmp_path / "own.toml").write_text("min_length = 4\nbuckets = 2\n")
    assert job_settings.load("note_ingest", str(tmp_path / "own.toml"), buckets=None)["buckets"] == 2
    at = [str(tmp_path / x) for x in ("out", "state")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "documents.parquet").write_bytes(Path(f"{SF}/documents.parquet").read_bytes())
    done = subprocess.run([sys.executable, "-m", "jobs.note_ingest", str(tmp_path / "in"), *at, "--config", str(tmp_path / "own.toml")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "chunks cut" in done.stderr
    assert len(list((tmp_path / "out" / "chunks").glob("batch=0/project=*"))) > 1
    done = subprocess.run([sys.executable, "-m", "jobs.distill_report", f"{SF}/documents.parquet", f"{SF}/events.parquet", str(tmp_path / "day"), "--as-of", "2024-03-01"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and (tmp_path / "day" / "verdicts" / "as_of=2024-03-01").is_dir()
