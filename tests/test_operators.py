"""Segmentation, full text, vectors, fusion, dedup and maintenance."""

import math
import os
import random
import re
import sys
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from mnemoflow.embedding import HashEmbedder
from mnemoflow.functions import scalar
from mnemoflow.operators import chunking, dedup, evaluation, fulltext, maintenance, retrieval, vector
from mnemoflow.operators.vector import knn
from mnemoflow.sources.workspace import ensure_checkpoint_dir

BLOCK = '<!-- RAW_JSON_START -->\n{0}\n<!-- RAW_JSON_END -->'


def chunks(spark, text, **options):
    df = spark.createDataFrame([("p", text)], "path string, text string")
    return [r.asDict() for r in chunking.chunk_notes(df, **options).orderBy("ordinal").collect()]


def texts(spark, text, **options):
    return [c["text"] for c in chunks(spark, text, **options)]


def test_headings_and_paragraphs(spark):
    assert texts(spark, "# Title one\n\nfirst paragraph\n\n\nsecond paragraph\n## Part two\nbody of part two\n#### not a cut") == ["# Title one", "first paragraph", "second paragraph", "## Part two\nbody of part two\n#### not a cut"]
    assert texts(spark, "x") == [] and texts(spark, "   ") == [] and texts(spark, None) == []
    assert texts(spark, "rag") == ["rag"] and texts(spark, "tiny\n\nlong enough one", min_length=10) == ["long enough one"]


def test_sentences_are_packed_like_a_loop(spark):
    def plain(p, most):
        out, buf = [], ""
        for s in re.split(r"([。！？；.!?;])", p):
            buf += s
            if len(buf) > most // 2 and re.search(r"[。！？；.!?;]$", s):
                out.append(buf.strip())
                buf = ""
        return [x for x in [*out, buf.strip()] if x]

    rng = random.Random(0)
    cases = ["".join(rng.choice("ab .!。;\n") for _ in range(rng.randint(0, 120))) for _ in range(200)] + ["One sentence here. " * 100, "no stop " * 100]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, t string")
    got = {r["k"]: r["s"] for r in df.select("k", chunking.sentences(F.col("t"), 20).alias("s")).collect()}
    assert all(got[k] == plain(c, 20) for k, c in enumerate(cases))
    assert all(len(t) <= 600 for t in texts(spark, "One sentence of some words here. " * 100, max_length=200))


def test_long_paragraphs_are_packed_without_a_loop(spark):
    """Packs are found by one expression and sections with paragraphs cut at once; a text is put into lower case once for all terms."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a\n\n\n# b\n\nc\n", "\u3000 x\u2003\n\n\x85", "\x1c kept \x1c", "aa. bb! cc", None])], "k int, t string")
    got = {r["k"]: r["s"] for r in df.select("k", chunking.text_pieces(F.col("t"), 4).alias("s")).collect()}
    assert got == {0: ["a", "# b", "c"], 1: ["x"], 2: ["\x1c kept \x1c"], 3: ["aa.", "bb!", "cc"], 4: None}
    shown = lambda c: df.select(c.alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in shown(chunking.sentences(F.col("t"))) and shown(scalar.extract_entities(F.col("t"), ("aa", "bb", "cc"))).count("lower(") == 1
    assert df.select(scalar.extract_entities(F.col("t"), ("cc", "bb", "zz"))).collect()[3][0] == ["bb", "cc"]


def test_vectors_of_many_texts_are_those_of_one(spark):
    """To the last digit; a text is hashed once."""
    df = spark.createDataFrame([("a",), ("向量 x",), ("",), ("long " * 100,)], "t string")
    both = df.select(HashEmbedder(64).embed(F.col("t")).alias("a"), HashEmbedder(64).embed_many(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] and len(r["a"]) == 64 for r in both)
    assert df.select(HashEmbedder(4).embed_many(F.nullif("t", F.lit("a"))).alias("b")).first()["b"] is None


def test_json_block_by_keys(spark):
    body = '{"tags": ["a", 1, true], "zeta": 1.0, "memory_type": "user_preference", "summary": "likes tests", "key_facts": ["f one", "f two"], "gone": null, "nest": {"a": 1}, "decisions": {"x": "y", "k": 2}}'
    got = chunks(spark, "Some words around the block, enough.\n" + BLOCK.format(body) + "\nand after it")
    assert [c["text"] for c in got] == ["memory_type: user_preference", "summary: likes tests", "key_facts: f one; f two", "decisions: x=y; k=2", "tags: a; 1; True", "zeta: 1.0", "Some words around the block, enough.\n \nand after it"]
    assert [c["block_type"] for c in got] == ["raw_json"] * 6 + [None] and got[0]["memory_type"] == "user_preference" and got[1]["json_key"] == "summary"
    assert texts(spark, "Some words around the block, enough.\n" + BLOCK.format("not json at all")) == ["not json at all", "Some words around the block, enough."]
    assert texts(spark, "Some words around the block, enough.\n" + BLOCK.format('["a", "b c d"]'))[0] == '["a", "b c d"]'


@pytest.mark.parametrize("body,n", [('{"uid": 1}', 0), ('{"memoryBlock": "x"}', 0), ('{"memory_type": "x", "summary": "a summary"}', 0), ('{"summary": "a summary here"}', 1), ("broken {", 1)])
def test_profile_guard(spark, body, n):
    assert len(texts(spark, BLOCK.format(body))) == n
    assert len(texts(spark, "A note that has enough text of its own.\n\n" + BLOCK.format(body))) >= 1


def test_ids_are_stable(spark):
    a, b = (chunks(spark, "first paragraph\n\nsecond paragraph") for _ in range(2))
    assert [c["id"] for c in a] == [c["id"] for c in b] and len({c["id"] for c in a}) == 2


@pytest.mark.parametrize("query,want", [
    ("time decay!", ["time", "decay"]), ("向量检索", ["向量检", "量检索"]), ("检索", []), ("a b1", ["b1"]), ("x向量y检索", ["向量检", "量检索"]), ("bge-m3 (v2)", ["bge-m3", "v2"]), ("", []), (None, []),
])
def test_query_terms(query, want):
    assert fulltext.query_terms(query) == want


def test_bm25_is_the_formula(spark):
    docs = [("a", "time decay and decay again ababab", "Alpha", []), ("b", "nothing here", "decay", ["rag"]), ("c", "TIME flies", None, None), ("d", "other words entirely", "x", [])]
    df = spark.createDataFrame(docs, "id string, text string, project string, entities array<string>")
    import json

    low = {i: [t.lower(), (p or "").lower(), json.dumps(e, separators=(",", ":")) if e is not None else ""] for i, t, p, e in docs}
    size = {i: sum(max(0, len(c) - 2) for c in cols) for i, cols in low.items()}
    average = sum(size.values()) / len(size)

    def score(q, i):
        total = 0.0
        for t in (x.lower() for x in fulltext.query_terms(q) if len(x) >= 3):
            count = {k: sum(len(re.findall(f"(?={re.escape(t)})", c)) for c in cols) for k, cols in low.items()}
            n = sum(c > 0 for c in count.values())
            idf = math.log((len(low) - n + 0.5) / (n + 0.5)) if n else 0
            f = count[i]
            total -= (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / average)) if f else 0
        return total

    queries = [("q1", "time decay"), ("q2", "decay decay aba"), ("q3", "zz"), ("q4", "xyz"), ("q5", "rag")]
    got = {(r["query_id"], r["id"]): r["score"] for r in fulltext.bm25(df, queries).collect()}
    want = {(k, i): score(q, i) for k, q in queries for i in low if score(q, i)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    places, lengths = fulltext.places_of(df)
    found = fulltext.bm25_by_places(places, len(size), average, queries)
    assert "text#" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0] and {r["id"]: r["dl"] for r in lengths.collect()} == size
    by_index = {(r["query_id"], r["id"]): r["score"] for r in found.collect()}
    assert by_index.keys() == want.keys() and all(by_index[k] == pytest.approx(want[k]) for k in got)
    assert fulltext.bm25(df.where("false"), queries).count() == 0


def test_best_of_bm25_shuffles_no_row_for_each_match(spark, monkeypatch):
    """The best k with copies beyond k, ties and a condition; tasks give the best of theirs alone."""
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gammabeta", "deltadelta", "eps", "zeta", "向量检索"]
    texts = ["alpha beta eps"] * 700 + [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(800)] + [None, ""]
    df = spark.createDataFrame([(i, t, "pq"[i % 2]) for i, t in enumerate(texts)], "id long, text string, project string").repartition(3)
    asked = [(k, " ".join(rng.choice(words, 3))) for k in range(12)] + [(99, "nothing-there")]
    shown = lambda x: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in x.collect())
    every = fulltext.bm25(df, asked, id_type="long")
    for size in (fulltext.CELLS, 200):
        monkeypatch.setattr(fulltext, "CELLS", size)
        assert shown(fulltext.bm25_top(df, asked, 7, id_type="long")) == shown(fulltext.topn(every, 7))
        assert shown(fulltext.bm25_top(df, asked, 7, id_type="long", where=F.col("project") == "p")) == shown(fulltext.topn(every.where("id % 2 = 0"), 7))
    monkeypatch.setattr(fulltext, "topn", lambda scored, k: scored)
    sent = fulltext.bm25_top(df, asked, 7, id_type="long")
    assert sent.count() <= sent.rdd.getNumPartitions() * 7 * 13 < every.count()


def test_trigram_figures(spark):
    """Across words, not across columns; characters beyond 16 bits are one."""
    df = spark.createDataFrame([("a", "xx yxx", "xxy"), ("b", "xxxx", None), ("c", "a😀b", "ab"), ("d", None, None)], "id string, text string, project string")
    got = {r["trigram"]: (r["df"], r["tf"]) for r in fulltext.trigram_figures(df).collect()}
    assert got == {"xx ": (1, 1), "x y": (1, 1), " yx": (1, 1), "yxx": (1, 1), "xxy": (1, 1), "xxx": (1, 2), "a😀b": (1, 1)}
    plan = fulltext.trigram_figures(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # no row for each trigram of a chunk


def test_knn(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(500, 8)), rng.normal(size=(3, 8))
    v[77] = v[33]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None)], "id long, embedding array<double>").repartition(4)
    got = knn(df, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>"), 7).orderBy("query_id", "rank").collect()
    want = [(k, i) for k, x in enumerate(q) for i in sorted(range(500), key=lambda i: (((v[i] - x) ** 2).sum(), i))[:7]]
    assert [(r["query_id"], r["id"]) for r in got] == want
    monkeypatch.setattr(vector, "BATCH", 2)  # more queries than are sent to all tasks: a grid of blocks
    monkeypatch.setattr(vector, "BLOCK", 90)
    grid = knn(df, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>"), 7).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in grid] == want
    assert knn(df.where("id < 2"), spark.createDataFrame([(0, q[0].tolist())], "query_id long, vector array<double>"), 5).count() == 2


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id string, rank int")


def test_fusion_and_weights(spark):
    chunk = spark.createDataFrame([(i, "text " + i, s, "p", None, c, 0) for i, s, c in (("a", "s1", 1.0), ("b", "s2", 0.5), ("c", "s1", 0.0))], "id string, text string, source string, project string, ts timestamp, confidence double, access_count long")
    v, b = hits(spark, [(1, "a", 0), (1, "b", 1)]), hits(spark, [(1, "b", 0), (1, "c", 1)])
    now = F.current_timestamp()
    got = {r["id"]: r for r in retrieval.hybrid(chunk, v, b, now, 5).collect()}
    assert got["a"]["rrf_score"] == pytest.approx(1 / 31) and got["b"]["rrf_score"] == pytest.approx(1 / 32 + 1 / 31) and got["c"]["vector_rank"] is None
    assert got["b"]["score"] == pytest.approx((1 / 32 + 1 / 31) * 0.85) and got["b"]["rank"] == 0
    assert [r["id"] for r in retrieval.hybrid(chunk, v, b, now, 1, source="s1").collect()] == ["a"]

    class Broken:
        def score(self, query, documents):
            raise RuntimeError

    class Last:
        def score(self, query, documents):
            return [1.0 if d.endswith("c") else 0.1 for d in documents]

    asked = spark.createDataFrame([(1, "q")], "query_id long, text string")
    first = lambda s: retrieval.hybrid(chunk, v, b, now, 5, reranker=lambda h: retrieval.rerank(h, asked, s)).where("rank = 0").first()
    assert first(Last())["id"] == "c" and first(Last())["score"] == 1.0
    assert first(Broken())["id"] == "b"


def test_newer_beats_older(spark):
    rows = [("old", "2023-01-01"), ("new", "2024-01-31")]
    chunk = spark.createDataFrame([(i, i, "s", "p", 0.9, 0, t) for i, t in rows], "id string, text string, source string, project string, confidence double, access_count long, t string").withColumn("ts", F.to_timestamp("t"))
    same = hits(spark, [(1, "old", 0), (1, "new", 0)])
    got = [r["id"] for r in retrieval.hybrid(chunk, same, same, F.to_timestamp(F.lit("2024-02-01")), 2).orderBy("rank").collect()]
    assert got == ["new", "old"]


@pytest.mark.parametrize("new,old,nc,oc,want", [
    ("user-memory", "workspace-log", 0.9, 0.1, "skip"), ("workspace-log", "user-memory", 0.5, 0.5, "merge"), ("workspace-log", "user-memory", 0.4, 0.5, "skip"),
    ("user-memory", "user-memory", 0.5, 0.5, "merge"), ("x", None, 0.6, 0.5, "merge"), ("x", "y", 0.4, 0.5, "skip"),
])
def test_decision_table(spark, new, old, nc, oc, want):
    index = spark.createDataFrame([("i", [1.0, 0.0], old, oc)], "id string, embedding array<double>, source string, confidence double")
    batch = spark.createDataFrame([("b", [1.0, 0.0], new, nc), ("m", [0.9, (1 - 0.81) ** 0.5], new, nc), ("f", [0.0, 1.0], new, nc)], "id string, embedding array<double>, source string, confidence double")
    got = {r["id"]: r["decision"] for r in dedup.decide(batch, index).collect()}
    assert got == {"b": want, "m": "skip", "f": "insert"}
    assert {r["decision"] for r in dedup.decide(batch, index.where("false")).collect()} == {"insert"}


LEVEL = {"user-memory": "summary"}


def one_writer(index, batch):
    """A plain sequential writer over lists: {id: (decision, existing_id)}."""
    rows = [dict(id=i, v=v, source=s, conf=c) for i, v, s, c in index]
    out = {}
    for i, _, v, source, conf in sorted(batch, key=lambda r: r[1]):
        best = min(rows, key=lambda r: (math.dist(r["v"], v), r["id"]), default=None)
        cos = sum(x * y for x, y in zip(best["v"], v, strict=True)) / math.hypot(*best["v"]) / math.hypot(*v) if best else -1
        new = dict(id=i, v=v, source=source, conf=conf)
        if cos < 0.85:
            rows.append(new)
            out[i] = ("insert", None)
        elif cos < 0.92 or conf < best["conf"] or LEVEL.get(source) == "summary" and LEVEL.get(best["source"]) != "summary":
            out[i] = ("skip", best["id"])
        else:
            best.update(new | {"id": best["id"]})
            out[i] = ("merge", best["id"])
    return out


@pytest.mark.parametrize("seed,grid,most", [(0, False, None), (1, False, 40), (2, True, 15), (3, True, 1)])
def test_decisions_in_order_are_those_of_one_writer(spark, monkeypatch, seed, grid, most):
    ensure_checkpoint_dir(spark)
    monkeypatch.setattr(dedup.rounds, "LINKS", most or dedup.rounds.LINKS)
    if grid:
        monkeypatch.setattr(vector, "BATCH", 9)
        monkeypatch.setattr(vector, "BLOCK", 7)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    unit = lambda x: (x / np.linalg.norm(x)).tolist()
    row = lambda: unit(centres[rng.integers(6)] + rng.normal(size=5) * rng.choice([0.05, 0.3]))
    src = lambda: str(rng.choice(["user-memory", "workspace-log", "other"]))
    index = [(f"i{k}", row(), src(), float(rng.integers(10)) / 10) for k in range(8)]
    batch = [(f"b{k:02d}", k, row(), src(), float(rng.integers(10)) / 10) for k in range(25)]
    df = spark.createDataFrame(batch, "id string, ordinal long, embedding array<double>, source string, confidence double").repartition(3)
    got = dedup.decide_in_order(df, spark.createDataFrame(index, "id string, embedding array<double>, source string, confidence double"))
    have = {r["id"]: (r["decision"], r["existing_id"]) for r in got.collect()}
    assert have == one_writer(index, batch)
    assert {d for d, _ in have.values()} >= {"insert", "skip"}


BATCH_ROW = "id string, ordinal long, embedding array<double>, source string, confidence double"


def test_equal_vectors_and_rows_without_one_are_decided_in_order(spark):
    ensure_checkpoint_dir(spark)
    a, b = [1.0, 0.0], [0.96, 0.28]
    batch = [(f"b{k:02d}", k, b if k % 3 == 0 else a, ("user-memory", "workspace-log")[k % 2], (k * 7 % 10) / 10) for k in range(24)]
    index = [("i2", a, "workspace-log", 0.1), ("i1", a, "workspace-log", 0.1)]
    odd = [("null", 30, None, None, None), ("zero", 31, [0.0, 0.0], "user-memory", 0.5), ("far", 32, [0.0, -1.0], None, None)]
    stored = spark.createDataFrame([*index, ("i0", None, None, None)], "id string, embedding array<double>, source string, confidence double")
    got = dedup.decide_in_order(spark.createDataFrame(batch + odd, BATCH_ROW), stored)
    have = {r["id"]: (r["decision"], r["existing_id"]) for r in got.collect()}
    assert have == one_writer(index, batch) | {k: ("insert", None) for k in ("null", "zero", "far")}
    assert dedup.decide_in_order(spark.createDataFrame([], BATCH_ROW), stored).count() == 0


@pytest.mark.parametrize("shuffled", [True, False])
def test_a_chain_is_decided_in_blocks(spark, monkeypatch, shuffled):
    """Each row is similar to a few before and after it along a curve; in an order of chance few rounds settle the chain, else as many as blocks at most."""
    ensure_checkpoint_dir(spark)
    rng, n = np.random.default_rng(5), 600
    place = np.cumsum(rng.uniform(0.13, 0.3, n))
    vectors = np.zeros((n, int(place[-1]) + 2))
    for v, s in zip(vectors, place, strict=True):
        v[int(s)], v[int(s) + 1] = math.cos(s % 1 * math.pi / 2), math.sin(s % 1 * math.pi / 2)
    order = rng.permutation(n) if shuffled else range(n)
    batch = [(f"b{k:04d}", int(o), v.tolist(), "other", 0.5) for k, (o, v) in enumerate(zip(order, vectors, strict=True))]
    folders, blocks, cut, named = [], [], dedup.rounds.in_turns, dedup.rounds.fresh_folder
    monkeypatch.setattr(dedup.rounds, "in_turns", lambda *a: blocks.append(cut(*a)) or blocks[-1])
    monkeypatch.setattr(dedup.rounds, "fresh_folder", lambda *a: folders.append(named(*a)) or folders[-1])
    monkeypatch.setattr(dedup.rounds, "LINKS", 400)
    got = dedup.decide_in_order(spark.createDataFrame(batch, BATCH_ROW), spark.createDataFrame([], "id string, embedding array<double>, source string, confidence double"))
    have = {r["id"]: (r["decision"], r["existing_id"]) for r in got.collect()}
    assert have == one_writer([], batch)
    sizes = [r["count"] for r in blocks[0][0].groupBy("block").count().collect()]
    took = len(os.listdir(folders[0].removeprefix("file://")))
    assert blocks[0][1] >= len(sizes) > 5 and max(sizes) <= 150
    assert took < len(sizes) if shuffled else took <= blocks[0][1]


def test_pairs_of_the_index_are_not_compared(spark):
    rows = lambda *names: spark.createDataFrame([(n, [1.0, 0.0]) for n in names], "node string, v array<double>")
    got = sorted(tuple(r) for r in dedup.similar_pairs(rows("b:1", "b:2"), rows("i:1", "i:2"), 0.9).collect())
    assert got == [("b:1", "b:2"), ("b:1", "i:1"), ("b:1", "i:2"), ("b:2", "i:1"), ("b:2", "i:2")]
    assert dedup.similar_pairs(rows("b:1").where("false"), rows("i:1"), 0.9).count() == 0


def test_search_width():
    assert [dedup.search_width(n) for n in (0, 10, 60, 1000, 1001)] == [0, 10, 50, 50, 25]


def maintenance_chunks(spark, n=30):
    rows = [(f"c{k:02d}", f"text   {k % 20}", f"p{k % 2}" if k % 5 else None, "s", k / 30, k % 3, "2024-01-01" if k % 4 else None, 10) for k in range(n)]
    return spark.createDataFrame(rows, "id string, text string, project string, source string, confidence double, access_count long, t string, length int").withColumn("ts", F.to_timestamp("t")).drop("t")


def test_distill_partitions_the_chunks(spark):
    c = maintenance_chunks(spark)
    d = maintenance.distill(c, F.to_timestamp(F.lit("2024-02-01")), top=3, purge_below=0.2).cache()
    assert d.count() == 30 and d.groupBy("project").agg(F.count_if(F.col("verdict") == "keep").alias("n")).where("n > 3").isEmpty()
    assert d.where("verdict = 'purge' AND (score >= 0.2 OR rank <= 3)").isEmpty() and not d.where("verdict = 'purge'").isEmpty()
    assert maintenance.purge(c, d).count() == 30 - d.where("verdict = 'purge'").count()
    assert maintenance.distill(c, F.current_timestamp(), project="nothing").isEmpty()
    assert {r["project"] for r in maintenance.distill_report(d).collect()} == {"p0", "p1", "(未分类)"}
    assert maintenance.kept_rows(d).count() == 9 and maintenance.purge_rows(d, 1).groupBy("project").count().where("count > 1").isEmpty()


def test_keep_first_and_noise(spark):
    c = maintenance_chunks(spark)
    kept = maintenance.keep_first(c)
    assert kept.count() == 20 and maintenance.keep_first(kept.drop("text_hash")).count() == 20
    assert {r["project"] for r in maintenance.noise_dedup(c, ["p1"]).collect()} == {"p1"}


@pytest.mark.parametrize("n,overall,note", [(0, "yellow", "empty"), (5, "green", None), (20, "green", "never")])
def test_health(spark, n, overall, note):
    c = maintenance_chunks(spark, n).withColumn("access_count", F.lit(0))
    report = maintenance.health(c)
    assert report["overall"] == overall and maintenance.exit_code(report) == {"yellow": 1, "green": 0}[overall]
    assert (note is None) == (not report["checks"]["index"]["notes"]) and all(note in x for x in report["checks"]["index"]["notes"])


def test_due():
    assert maintenance.should_distill(None, 1e9) and maintenance.should_distill(0, 1e9) and not maintenance.should_distill(1e9 - 3600, 1e9) and maintenance.should_distill(1e9 - 48 * 3600, 1e9)


def test_digest_block(spark):
    c = maintenance_chunks(spark).withColumn("text", F.concat(F.lit("line one\\nline two "), F.repeat(F.col("id"), 40)))
    d = maintenance.distill(c, F.to_timestamp(F.lit("2024-02-01")))
    rows = [r.asDict() for r in maintenance.digest_rows(d).collect()]
    body = maintenance.render_digest(rows, 3, 30, "2024-02-01 00:00")
    assert len(body) <= maintenance.BLOCK_CHARS + 60 and body.count("### ") == 3 and "…" in body and "\\n" not in body
    for part in body.split("### ")[1:]:
        assert len("### " + part.rstrip()) <= maintenance.PROJECT_CHARS + 1 and 1 <= part.count("- `") <= 5
    heat = [max(r["heat"] for r in rows if r["header"] in line) for line in body.split("\n") if line.startswith("### ")]
    assert heat == sorted(heat, reverse=True)
    many = [dict(project=f"p{k:03d}", heat=float(-k), header=f"### p{k:03d} (1 chunks)", rank=1, line="- `0.1` acc=0  " + "x" * 80, fits=True) for k in range(100)]
    assert len(maintenance.render_digest(many, 100, 100, "s")) <= maintenance.BLOCK_CHARS + 60
    assert "no projects" in maintenance.render_digest([], 0, 7, "s")


def test_digest_markers():
    put = maintenance.put_digest
    new = put(None, "B1")
    assert new.startswith("# Memory") and put(new, "B1") == new and "B2" in put(new, "B2") and "B1" not in put(new, "B2")
    old = put("mine\n\n", "B1")
    assert old.startswith("mine\n") and put(old + "after", "B3").endswith("after")
    wrong = f"{maintenance.DIGEST_END} x {maintenance.DIGEST_START}"
    assert put(wrong, "B").startswith(wrong)


def test_metrics(spark):
    gold = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["z"]), ("q3", [])], "query_id string, relevant_ids array<string>")
    ranked = spark.createDataFrame([("q1", "x", 0), ("q1", "a", 1), ("q1", "b", 5), ("q2", "y", 0)], "query_id string, id string, rank int")
    got = {r["query_id"]: r for r in evaluation.per_query(ranked, gold).collect()}
    assert got["q1"]["recall_1"] == 0 and got["q1"]["recall_5"] == 0.5 and got["q1"]["recall_10"] == 1 and got["q1"]["mrr"] == 0.5
    assert got["q1"]["ndcg_10"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(7)) / (1 + 1 / math.log2(3)))
    assert got["q2"]["mrr"] == 0 == got["q3"]["recall_10"] == got["q3"]["ndcg_10"]
    s = evaluation.summary(evaluation.per_query(ranked, gold)).first().asDict()
    assert s["queries"] == 3 and s["recall_10"] == pytest.approx(1 / 3) and "| recall_10 | 0.3333 |" in evaluation.report(s)
    t = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "ms double")
    assert tuple(evaluation.latency(t, "ms").first()) == (3.0, 4.0)
    many = [(g, float(x)) for g, xs in (("a", [1] * 50 + [2] * 3 + [9]), ("b", [7]), ("c", range(40, 0, -1))) for x in xs] + [("d", None)]
    got = {r["g"]: (r["p50"], r["p95"]) for r in evaluation.percentiles(spark.createDataFrame(many, "g string, x double"), "x", ("g",)).collect()}
    assert got == {g: tuple(sorted(xs)[min(len(xs) - 1, int(len(xs) * p))] for p in (0.5, 0.95)) for g, xs in (("a", [1.0] * 50 + [2.0] * 3 + [9.0]), ("b", [7.0]), ("c", [float(x) for x in range(1, 41)]))}


def test_percentiles_of_many_values(spark):
    """Without groups no task has all values; null groups are groups."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", None, "c"]), round(rng.gauss(0, 9), rng.choice([0, 5]))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    at = lambda xs, p: sorted(xs)[min(len(xs) - 1, int(len(xs) * p))]
    ps = {"low": 0.0, "mid": 0.5, "high": 0.999, "top": 1.0}
    whole = evaluation.percentiles(df, "x", (), ps)
    assert whole.first().asDict() == {k: at([x for _, x in rows], p) for k, p in ps.items()}
    got = {r["g"]: (r["low"], r["mid"], r["high"], r["top"]) for r in evaluation.percentiles(df, "x", ("g",), ps).collect()}
    assert got == {g: tuple(at([x for h, x in rows if h == g], p) for p in ps.values()) for g in ("a", None, "c")}
    assert evaluation.percentiles(df.where("false"), "x").first().asDict() == {"p50": None, "p95": None}
    page = evaluation.report({"recall_1": 0.5, "date": "2024-01-01", "chunks": 7, "details": [{"query": "a|b", "mrr": 1.0}]})
    assert "2024-01-01, 7 chunks" in page and "| a\\|b | 1.0000 |" in page and "details" not in page


def test_scores_of_a_model_are_kept_and_batched():
    calls = []

    def load():
        return lambda pairs: calls.append(pairs) or [len(d) for _, d in pairs]

    s = retrieval.ModelScorer(load, batch=2)
    assert s.score("q", ["a", "bb", "ccc", "a"]) == [1, 2, 3, 1] and [len(c) for c in calls] == [2, 1]
    assert s.score("q", ["bb", "dddd"]) == [2, 4] and calls[2:] == [[("q", "dddd")]]
    assert retrieval.ModelScorer(load, ttl=-1).score("q", ["a"]) == [1]
    assert isinstance(retrieval.scorer_of({"reranker_model": "overlap", "device": "cpu"}), retrieval.OverlapScorer)


def test_the_grid_copies_neither_side_more_than_it_must(spark, monkeypatch):
    """Each query meets each row once, and rows and queries are copied about as often as the root of the number of cells."""
    monkeypatch.setattr(vector, "BATCH", 9)
    n, m = 90, 180
    rows = lambda name, k: spark.createDataFrame([(i, [float(i), 1.0]) for i in range(k)], f"{name} long, v array<double>")

    def compare(ids, vectors):
        import pyarrow as pa

        assert len(ids) == len(vectors)
        return lambda batches: iter([pa.RecordBatch.from_pydict({"q": [len(ids)], "r": [sum(b.num_rows for b in batches)]})])

    counted = lambda: vector.meet(rows("q", n), rows("r", m), compare, "q long, r long").collect()
    assert sum(r["q"] * r["r"] for r in counted()) == n * m
    monkeypatch.setattr(vector, "_by_cell", lambda _: lambda batches: compare([], [])(batches))
    assert sum(r["r"] for r in counted()) < 3 * math.sqrt(12 * n * m)


def test_a_block_of_links_is_held_in_arrays():
    n, each = 2000, 50
    own = [f"b:{i}" for i in range(n)]
    links = [(c, own[(i + k) % n], float(k), 0.95 if k else 1.0) for i, c in enumerate(own) for k in range(each)]
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("source", pa.string()), ("confidence", pa.float64())]))
    near = pa.table({"own": [x[0] for x in links], "x": [x[1] for x in links], "far": [x[2] for x in links], "sim": [x[3] for x in links], "shut": [False] * len(links), "slots": pa.nulls(len(links), kind)})
    rows = pa.table({"turn": list(range(n)), "id": list(range(n)), "c": own, "source": ["other"] * n, "confidence": [0.5] * n})
    schema = pa.schema([("turn", pa.int64()), ("id", pa.int64()), ("decision", pa.string()), ("existing_id", pa.int64()), ("similarity", pa.float64()), ("x", pa.string()), ("slot", pa.int64()), ("source", pa.string()), ("confidence", pa.float64())])
    tracemalloc.start()
    got = dedup.rounds.settle(rows, near, 0.92, 0.85, schema)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.filter(pc.is_valid(got["decision"])).num_rows == n and got["decision"][0].as_py() == "insert"
    assert peak < 100 * len(links), peak / len(links)


@pytest.mark.parametrize("steps", [1 << 22, 0])
def test_counting_phrases_costs_no_call_for_a_word(monkeypatch, steps):
    """Phrases are counted at all places of a text at once, in slabs, within a text and not across texts; a tree that is no table finds the same."""
    monkeypatch.setattr(fulltext, "STEPS", steps, raising=False)
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abcé-向") for _ in range(rng.randint(3, 6))) for _ in range(150)} | {"abc", "abcabc", "aaa", "量检索"})
    texts = [" ".join("".join(rng.choice("abcé-向😀") for _ in range(rng.randint(1, 12))) for _ in range(200)) for _ in range(100)] + ["", "aaaa", "ab", "cabcabc", "向量检索", "ab" + "c" * 3000 + "abc"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "dl": [1] * len(texts), "wanted": [True] * len(texts), "text": texts, "project": ["c"] * len(texts), "entities": ["abc"] * len(texts)})
    calls, work = [], fulltext._counted(terms, pa.int64())
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)
    try:
        (out,) = work(iter([batch]))
    finally:
        sys.setprofile(None)
    monkeypatch.setattr(fulltext, "SLAB", 1000, raising=False)
    assert next(work(iter([batch]))).equals(out)
    want = [{n: c for n, t in enumerate(terms) if (c := len(re.findall(f"(?={re.escape(t)})", text)) + (t == "abc"))} for text in texts]
    assert [dict(zip(r["nths"], r["f"], strict=True)) for r in out.to_pylist()] == want and out.column("id").to_pylist() == list(range(len(texts)))
    assert len(calls) < 5000 < len({w for t in texts for w in t.split()})
