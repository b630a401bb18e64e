"""Access counts by a stream: growing logs, late rows, runs again, and the store's counts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemoflow.sources.store import ACCESS, ChunkStore
from mnemoflow.sources.workspace import ensure_checkpoint_dir
from mnemoflow.streaming import access


@pytest.fixture
def store(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    found = ChunkStore(spark, f"file://{tmp_path}/store")
    found.append(spark.createDataFrame([(k, f"text of {k}") for k in "abc"], "id string, text string"))
    return found


def log(spark, store, *rows):
    some = [(i, t and datetime.fromisoformat(f"2024-01-{t}"), None) for i, t in rows]
    spark.createDataFrame(some, ACCESS).coalesce(1).write.mode("append").parquet(f"{store.folder}/access_log")


def windows(store):
    return sorted((r["chunk_id"], r["opened"].day, r["access_count"]) for r in store.access_windows().collect())


def counts(store):
    return {r["id"]: r["access_count"] for r in store.with_access().collect()}


def test_windows_are_written_once(spark, store):
    log(spark, store, ("a", "01 10:00"), ("a", "01 11:00"), ("b", "01 23:59:59"), ("a", "02 08:00"), ("b", None))
    store.roll_up_access()
    assert windows(store) == [("a", 1, 2), ("b", 1, 1)]
    assert counts(store) == {"a": 3, "b": 1, "c": 0}
    store.roll_up_access()
    assert windows(store) == [("a", 1, 2), ("b", 1, 1)]
    log(spark, store, ("a", "02 07:00"), ("c", "03 00:30"), ("b", "01 12:00"))
    assert counts(store) == {"a": 4, "b": 1, "c": 1}  # the row of the first day is late
    store.roll_up_access()
    assert windows(store) == [("a", 1, 2), ("b", 1, 1)]  # the second day can still change for an hour
    log(spark, store, ("b", "02 23:00"), ("c", "03 01:00"))
    store.roll_up_access()
    assert windows(store) == [("a", 1, 2), ("a", 2, 2), ("b", 1, 1), ("b", 2, 1)]
    assert counts(store) == {"a": 4, "b": 2, "c": 2}
    found = store.get("b")
    assert found["access_count"] == 2 and found["last_access"].day == 2


def test_counts_without_a_log_or_a_window(spark, store):
    store.roll_up_access()
    assert counts(store) == {"a": 0, "b": 0, "c": 0}
    log(spark, store, ("a", "01 10:00"))
    store.roll_up_access()
    assert windows(store) == [] and counts(store) == {"a": 1, "b": 0, "c": 0}


def test_a_run_that_dies_is_finished_by_the_next(spark, store, tmp_path):
    log(spark, store, ("a", "01 10:00"), ("b", "05 10:00"))
    rows = spark.readStream.schema(ACCESS).parquet(f"{store.folder}/access_log")
    broken = rows.withColumn("accessed_at", F.when(F.col("chunk_id") == "b", F.raise_error(F.lit("lost")).cast("timestamp")).otherwise(F.col("accessed_at")))
    where, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    with pytest.raises(Exception, match="lost"):
        access.roll_up(broken, where, mark)
    access.roll_up(rows, where, mark)
    access.roll_up(rows, where, mark)
    assert [(r["chunk_id"], r["access_count"]) for r in access.read_windows(spark, where).collect()] == [("a", 1)]
