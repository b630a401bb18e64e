"""Stored scores: one call for a pair, calls of like length, and their age."""

import os

import pytest
from pyspark.sql import functions as F

from mnemoflow.memory import Memory
from mnemoflow.operators import retrieval
from mnemoflow.sources.scores import StoredScores

PAIRS = "query string, document string, score string, id long"


def model(log):
    """A model that notes the lengths of each call in a file of its own."""

    def load():
        def scores(pairs):
            if any("bad" in d for _, d in pairs):
                raise ValueError("bad")
            name = f"{log}/{os.getpid()}-{abs(hash(tuple(pairs)))}"
            with open(name, "a") as f:
                f.write(",".join(str(len(q) + len(d)) for q, d in pairs) + "\n")
            return [len(q) + len(d) / 10 for q, d in pairs]

        return scores

    return load


def calls(log):
    return [[int(n) for n in line.split(",")] for f in os.listdir(log) for line in (log / f).read_text().splitlines()]


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def test_a_second_run_calls_for_new_pairs_alone(spark, tmp_path, log):
    s = StoredScores(spark, f"file://{tmp_path}/scores", "m", model(log))
    rows = [("q", "a" * k, "clash", k) for k in range(60)] + [("q", "aa", "again", 2), (None, None, None, None), ("", "", None, 7)]
    pairs = spark.createDataFrame(rows, PAIRS).repartition(3)
    assert s.missing(pairs).count() == 61
    got = s.score(pairs)
    assert sorted(got.columns) == sorted(pairs.columns) and got.count() == len(rows)
    assert {(r["query"], r["document"]): r["score"] for r in got.collect()} == {(q, d): len(q or "") + len(d or "") / 10 for q, d, *_ in rows}
    first = calls(log)
    assert sum(map(len, first)) == 61 and max(map(len, first)) <= 8
    assert all(max(c) - min(c) <= 8 for c in first)  # pairs of like length share a call
    assert sorted(map(repr, s.score(pairs).collect())) == sorted(map(repr, got.collect())) and calls(log) == first
    assert s.add(pairs.union(spark.createDataFrame([("other", "a", None, 1)], PAIRS))) == 1
    assert StoredScores(spark, f"file://{tmp_path}/scores", "m", model(log)).add(pairs) == 0  # kept beyond the object
    assert StoredScores(spark, f"file://{tmp_path}/scores", "another", model(log)).add(pairs) == 61


def test_scores_age(spark, tmp_path, log):
    s = StoredScores(spark, f"file://{tmp_path}/scores", "m", model(log), ttl=60)
    at = lambda t: F.to_timestamp(F.lit(f"2024-01-01 {t}"))
    pairs = spark.createDataFrame([("q", "a", None, 1)], PAIRS)
    assert [s.add(pairs, at(t)) for t in ("00:00:00", "00:00:59", "00:01:00", "00:01:30")] == [1, 0, 1, 0]
    assert s.table.read().count() == 1


def test_failed_calls_leave_no_score(spark, tmp_path, log):
    s = StoredScores(spark, f"file://{tmp_path}/scores", "m", model(log), batch=1)
    pairs = spark.createDataFrame([("q", "good", None, 1), ("q", "bad", None, 2)], PAIRS)
    assert {r["document"]: r["score"] for r in s.score(pairs, on_error="keep").collect()} == {"good": 1.4, "bad": None}
    with pytest.raises(Exception, match="bad"):
        s.score(pairs)
    assert s.score(pairs.where("false")).count() == 0


def test_rerank_takes_stored_scores(spark, tmp_path, log):
    s = StoredScores(spark, f"file://{tmp_path}/scores", "m", model(log))
    hits = spark.createDataFrame([(1, f"c{k}", "x" * (k + 1), 1.0 - k / 100) for k in range(25)] + [(2, "c0", "x", 0.5), (2, "c1", "bad", 0.4)], "query_id long, id string, text string, score double")
    asked = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, text string")
    got = {(r["query_id"], r["id"]): r["rerank_score"] for r in retrieval.rerank(hits, asked, s, top=20).collect()}
    assert got[1, "c4"] == 3.5 and got[1, "c24"] == 0 and len(got) == 27 and got[2, "c1"] is None
    assert sum(map(len, calls(log))) == 21
    retrieval.rerank(hits, asked, s, top=10).collect()
    assert sum(map(len, calls(log))) == 21


def test_searches_keep_scores(spark, tmp_path, log):
    m = Memory(spark, f"file://{tmp_path}/memory", scorer=StoredScores(spark, f"file://{tmp_path}/scores", "m", model(log)))
    m.add("A long enough note on parquet files and their footers.")
    found = m.search("parquet files", rerank=True, record=False)
    assert found and found == m.search("parquet files", rerank=True, record=False) and sum(map(len, calls(log))) == 1
