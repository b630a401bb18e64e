"""Scalar functions, case by case."""

import pytest
from pyspark.sql import functions as F

from mnemoflow.embedding import Rewriter, mock_rewrite
from mnemoflow.functions import scalar, vocab


def apply(spark, f, values):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x string")
    return [r["y"] for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


CASES = [
    (scalar.is_key_term, {"about RAG": True, "BM25!": True, "plain": False, "向量 检索": True, "": False}),
    (lambda x: scalar.keeps_length(x, 8), {"short": False, "long enough": True, "rag": True, "": False}),
    (scalar.extract_project, {"项目: 天狼星 计划": "天狼星", "项目背景 is here": None, "see SparkEngine now": "SparkEngine", "RAG API": None, "in Notes.md we": "Notes.md", "项目：技术决策 then AlphaBeta": "AlphaBeta", "ÉtéAbcd": None, "": None}),
    (scalar.extract_entities, {"Python and Docker on LINUX": ["linux", "python"], "storage": ["rag"], "none": [], "code": ["co"]}),
    (scalar.detect_source, {"# head": "user-memory", "text": "unknown"}),
    (scalar.confidence, {"x": 0.5, "y" * 51: 0.6, "我们决定 2024-01-02": 0.8, "决定 MyProject 2024-01-02 " + "z" * 50: 1.0, "采用": 0.7}),
    (lambda x: F.date_format(scalar.parse_ts(x), "yyyy-MM-dd HH:mm"), {"2024-01-02T03:04:05": "2024-01-02 03:04", "2024-01-02": "2024-01-02 00:00", "2024-01-02 03:04:05": None, "x": None, "": None, "2024-13-02": None}),
    (lambda x: scalar.relabel(x)[0], {"<!-- RAW_JSON_START --> 决定": "cloud-profile-legacy", "RAW_JSON_END x": "cloud-profile-legacy", "**b** 决定": "user-memory", "2024-01-02 决定": "workspace-log", "选用 x": "user-memory", "pytest ok": "test-result", "else": "user-memory"}),
    (scalar.normalise, {" a\n b　c ": "a b c", "": ""}),
    (lambda x: scalar.truncate(x, 10), {"short": "short", "a\\nb\tc\n d": "a b c d", "0123456789x": "0123456789…", "012345678 9x": "012345678…"}),
    (scalar.needs_history, {"之前说的方案是什么, please tell me": True, "我的方案": True, "what is bm25 in general": False, "你" + "x" * 12: False}),
    (lambda x: F.length(scalar.rerank_cut(x)), {"a" * 273: 273, "a" * 274: 238, "a": 1}),
    (scalar.rewrite, {q: mock_rewrite(q) for q in ("bm25", "时间衰减", "x y", "  ", "")}),
    (scalar.level_of, {"user-memory": "summary", "workspace-log": "full", "other": "full"}),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_cases(spark, n):
    f, cases = CASES[n]
    got = apply(spark, f, cases)
    for x, have, want in zip(cases, got, cases.values(), strict=True):
        assert (have == pytest.approx(want) if isinstance(want, float) else have == want), x


def test_source_by_path(spark):
    df = spark.createDataFrame([("a/MEMORY.md",), ("w/memory/x.md",), ("my-Conversation.txt",), (None,)], "p string")
    assert [r[0] for r in df.select(scalar.detect_source(F.lit("t"), F.col("p"))).collect()] == ["user-memory", "workspace-log", "conversation", "unknown"]


def test_hash_embed_is_the_definition(spark):
    import hashlib

    import numpy as np

    for text in ("", "hello", "向量"):
        raw = np.array([hashlib.md5(f"{text}:{i}".encode()).digest()[0] / 255 - 0.5 for i in range(32)])
        got = apply(spark, lambda x: scalar.hash_embed(x, 32), [text])[0]
        assert np.allclose(got, raw / np.linalg.norm(raw))


def test_cosine_and_decay(spark):
    row = spark.range(1).select(
        scalar.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("zero"), scalar.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(2.0))).alias("one"),
        scalar.decay(F.to_timestamp(F.lit("2024-01-01")), F.lit(3), F.to_timestamp(F.lit("2024-03-31"))).alias("old"), scalar.decay(F.lit(None).cast("timestamp"), F.lit(3), F.current_timestamp()).alias("none"),
        scalar.distill_score(F.lit(0.8), F.lit(None).cast("timestamp"), F.lit(0), F.current_timestamp()).alias("distill"), scalar.sigmoid(F.lit(0.0)).alias("half"),
    ).first()
    import math

    assert row["zero"] == 0 and row["one"] == pytest.approx(1) and row["old"] == pytest.approx(math.exp(-1) * math.log(5)) and row["none"] == 1
    assert row["distill"] == pytest.approx(0.8 * 0.5 * math.log(2)) and row["half"] == 0.5


def test_sizes():
    assert [scalar.format_size(x) for x in (0, 1023, 1024, 5 * 1024**3, 3 * 1024**4)] == ["0.0B", "1023.0B", "1.0KB", "5.0GB", "3.0TB"]


def test_rewriter():
    calls = []

    def llm(q):
        calls.append(q)
        return "an answer about " + q

    r = Rewriter(llm)
    assert r.generate("x") == "an answer about x" == r.generate("x") and calls == ["x"]
    assert r.generate("  ") == "  "

    def broken(q):
        raise RuntimeError

    assert Rewriter(broken).generate("bm25") == mock_rewrite("bm25") and "bm25" in mock_rewrite("bm25") and len(mock_rewrite("bm25")) > 4
    assert Rewriter(lambda q: "").generate("q") == mock_rewrite("q")


def test_vocabularies():
    assert len(set(vocab.KEY_TERMS)) == 31 and len(set(vocab.GENERIC_HEADINGS)) == 37 and len(vocab.PRIORITY_KEYS) == 8
