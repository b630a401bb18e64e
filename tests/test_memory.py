"""The store, scans, settings, the facade, the server's answers and the stream, end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mnemoflow import cli, server
from mnemoflow.embedding import ModelEmbedder
from mnemoflow.memory import Memory, check_request, clamp_results
from mnemoflow.sources import config, files
from mnemoflow.sources.store import ChunkStore
from mnemoflow.streaming.ingest import watch


def bag():
    import numpy as np

    def embed(texts):
        out = np.zeros((len(texts), 64))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                out[k, sum(map(ord, w)) % 64] += 1
        return out

    return embed


@pytest.fixture
def notes(tmp_path):
    top = tmp_path / "notes"
    (top / "sub").mkdir(parents=True)
    (top / "MEMORY.md").write_text("# Alpha\n\nWe chose SparkEngine for RAG on 2024-01-02, 采用 sqlite.\n\n## Beta\n\nAnother paragraph about python and the retriever design.\n")
    (top / "sub" / "2024-01-05.md").write_text("log: deploy failed, 失败 in production; rerank was slow on ProjectOrion.\n")
    (top / "README.md").write_text("left out because of its name")
    (top / "README_memory.md~").write_text("left out")
    (top / "gbk_memory.md").write_bytes("向量检索 项目：天狼星 采用 混合检索 方案".encode("gbk"))
    return top


def test_scan_is_incremental(spark, notes, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/idx")
    dry = m.scan([f"file://{notes}"], dry_run=True)
    assert dry["scanned"] == 3 and len(dry["files"]) == 3 and m.stats()["total"] == 0
    first = m.scan([f"file://{notes}", f"file://{tmp_path}/none"])
    assert first["inserted"] == first["chunks_total"] == 4 and first["unchanged"] == 0
    assert first["search_width"] == 0 and m.scan([f"file://{notes}"])["unchanged"] == 3
    (notes / "sub" / "2024-01-05.md").write_text("a new and longer line of the log about something else\n")
    (notes / "gbk_memory.md").unlink()
    again = m.scan([f"file://{notes}"], project="forced")
    assert (again["unchanged"], again["inserted"], again["scanned"]) == (1, 1, 2)
    assert m.store.scan_state.read().count() == 2 and m.stats()["by_project"]["forced"] == 1
    assert "天狼星" in m.stats()["by_project"]


def test_files_of_any_name_are_read(spark, tmp_path):
    for n in ("a b_memory.md", "c [1]_memory.md", "d+e%20{x},y_memory.md"):
        (tmp_path / n).write_text("note " + n)
    found = files.scan(spark, [f"file://{tmp_path}"], with_content=False)
    got = {r["text"] for r in files.decode(files.read(spark, [r["path"] for r in found.collect()])).collect()}
    assert got == {"note a b_memory.md", "note c [1]_memory.md", "note d+e%20{x},y_memory.md"}


def test_name_patterns(spark, tmp_path):
    for n in ("a_memory.md", "MEMORY.md", "2024-01-02 x.md", "24-01-02.md", "memory.md", "x~y_memory.md", "b.tmp.1_memory.md"):
        (tmp_path / n).write_text("x")
    got = {r["name"]: r["ignored"] for r in files.scan(spark, [f"file://{tmp_path}"]).collect()}
    assert got == {"a_memory.md": False, "MEMORY.md": False, "2024-01-02 x.md": False, "x~y_memory.md": True, "b.tmp.1_memory.md": True}


def test_search_counts_accesses(spark, notes, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/idx")
    m.scan([f"file://{notes}"])
    first = m.search("sqlite RAG", 3)
    assert "sqlite" in first[0]["text"] and first[0]["bm25_rank"] == 0 and first[0]["access_count"] == 1
    assert m.search("sqlite RAG", 3)[0]["access_count"] == 2
    assert all(h["source"] == "user-memory" for h in m.search("sqlite RAG", 3, source="user-memory"))
    assert {h["project"] for h in m.search("deploy", 3, project="ProjectOrion")} == {"ProjectOrion"}
    assert m.search("sqlite RAG", 1, rerank=True, use_hyde=True)[0]["rerank_score"] is not None
    assert len(m.batch_search(["rag", "deploy", "zzz"], 2)) == 3
    plain = [[(h["id"], h["bm25_rank"]) for h in hits] for hits in m.batch_search(["rag", "sqlite deploy"], 5, record=False)]
    assert m.health()["overall"] == "green" and m.store.rebuild_postings() > 50 and m.store.has_postings()
    assert [[(h["id"], h["bm25_rank"]) for h in hits] for hits in m.batch_search(["rag", "sqlite deploy"], 5, record=False)] == plain
    assert len(m.ask("sqlite RAG", 99)) <= 20
    gold = spark.createDataFrame([("q", "sqlite RAG", [first[0]["id"]])], "query_id string, query string, relevant_ids array<string>")
    figures = m.evaluate(gold)
    assert figures["chunks"] == m.store.chunks().count() and [d["query"] for d in figures["details"]] == ["sqlite RAG"] and figures["details"][0]["mrr"] == 1.0 and figures["details"][0]["latency_ms"] > 0
    assert figures["recall_1"] == 1.0 and 0 < figures["latency_p50_ms"] <= figures["latency_p95_ms"]
    done = m.run_once([f"file://{notes}"], str(tmp_path / "digest.md"))
    assert "distill" in done and "distill" not in m.run_once([f"file://{notes}"])
    text = (tmp_path / "digest.md").read_text()
    assert m.inject(str(tmp_path / "digest.md"))["projects_injected"] == 4 and text.count("AUTO_DIGEST_START") == 1


def test_writing_merges_and_skips(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/idx", embedder=ModelEmbedder(bag))
    assert [r["decision"] for r in m.add("the quick brown fox jumps over the lazy dog")] == ["insert"]
    one = m.store.chunks().first()["id"]
    got = m.add("the quick brown fox jumps over the lazy dog dog\n\ncompletely different words stand here")
    assert [r["decision"] for r in got] == ["merge", "insert"] and got[0]["existing_id"] == one
    kept = m.store.get(one)
    assert kept["text"].endswith("dog dog") and m.stats()["total"] == 2
    assert m.add("") == [] and m.store.get("absent") is None


def test_store(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a", "x", "p"), ("b", "y", None)], "id string, text string, project string")
    s.append(rows)
    s.append(spark.createDataFrame([("a", "x2", "p")], rows.schema))
    assert {r["id"]: r["text"] for r in s.chunks().collect()} == {"a": "x2", "b": "y"} and s.get("b")["project"] == ""
    s.record_access(spark.createDataFrame([("a",), ("a",)], "id string"), F.current_timestamp())
    s.update(spark.createDataFrame([("a", "x3", "q"), ("zz", "no", "q")], rows.schema))
    assert s.get("a")["text"] == "x3" and s.get("a")["access_count"] == 2 and s.get("zz") is None
    s.delete(["b", "absent"])
    assert s.chunks().count() == 1 and s.by_project("q").count() == 1 and (s.table.versions(), s.table.spans()) == ([3], [])
    for k in range(6):  # small writes cost their own rows, and are gathered into a whole version now and then
        s.append(spark.createDataFrame([("a", f"x{k}", "q")], rows.schema))
    assert s.table.versions() == [3, 7] and s.table.spans() == [(8, 8), (9, 9)] and s.get("a")["text"] == "x5" and s.chunks().count() == 1
    s.append(spark.createDataFrame([("a", "x6", "q"), ("a", "x8", "q"), ("a", "x7", "q")], rows.schema))
    assert s.get("a")["text"] == "x8"  # of rows that share an id in one change, the greatest
    s.replace(s.chunks())
    s.table.retire(1)
    assert s.table.versions() == [11] and not s.table.spans() and s.chunks().count() == 1
    assert not s.has_postings() and s.rebuild_postings() == 0 and s.has_postings()  # no text of three characters
    s.append(spark.createDataFrame([("u", "2024-01-02 决定 x", "unknown")], "id string, text string, source string"))
    s.relabel_unknown()
    assert s.get("u")["source"] == "workspace-log"


def test_gold_set(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"query": "a", "relevant_ids": ["x"]}\n\n{"query": "b", "relevant_ids": []}\n{"query": "c"}\n')
    assert sorted((r["query"], list(r["relevant_ids"])) for r in files.gold_set(spark, f"file://{tmp_path}/g.jsonl").collect()) == [("a", ["x"]), ("b", []), ("c", [])]


def test_settings(tmp_path):
    toml = tmp_path / "s.toml"
    toml.write_text('[tool.mnemoflow]\nrrf_k = 60\nmemory_dirs = ["a", "b"]\ntau_days = "x"\n')
    with pytest.warns(UserWarning):
        got = config.load(toml, {"MNEMOFLOW_MEMORY_DIRS": "c, d", "MNEMOFLOW_EMBEDDING_DIM": "128"})
    assert got["rrf_k"] == 60 and got["memory_dirs"] == ["c", "d"] and got["embedding_dim"] == 128 and got["tau_days"] == 90.0
    with pytest.warns(DeprecationWarning):
        assert config.load(env={"MAX_SEARCH_K": "7"})["max_search_k"] == 7
    assert config.load(tmp_path / "none.toml", {}) == config.DEFAULTS


def test_requests(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/idx")
    assert server.answer(m, "POST", "/add", {"text": "a fact about the search engine"})[0] == 200
    assert server.answer(m, "GET", "/health", {}) == (200, {"status": "ok", "backend": "hash", "total": 1})
    assert server.answer(m, "GET", "/stats", {})[1]["total"] == 1
    assert len(server.answer(m, "POST", "/search", {"query": "search", "top_k": 3})[1]["results"]) == 1
    assert len(server.answer(m, "POST", "/batch_search", {"queries": ["search", "fact"]})[1]["results"]) == 2
    for path, body in (("/search", {"query": "x", "top_k": 999}), ("/search", {"query": ""}), ("/search", {"query": "x", "candidates": 1}), ("/batch_search", {"queries": []}), ("/batch_search", {"queries": ["x"] * 51}), ("/batch_search", {"queries": ["x"], "top_k": 21}), ("/add", {"text": " "})):
        assert server.answer(m, "POST", path, body)[0] == 422
    assert server.answer(m, "GET", "/nothing", {})[0] == 404
    assert [clamp_results(x) for x in (0, 7, 99)] == [1, 7, 20]
    with pytest.raises(ValueError):
        check_request("x", 51, 20)


def test_command_line(spark, notes, tmp_path, capsys):
    idx = f"file://{tmp_path}/idx"
    assert cli.main(["--index-dir", idx, "scan", f"file://{notes}"]) == 0
    capsys.readouterr()
    assert cli.main(["--index-dir", idx, "query", "sqlite RAG", "--top-k", "1"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 1
    assert cli.main(["--index-dir", idx, "health"]) == 0


def test_every_command(spark, notes, tmp_path, capsys):
    def run(*args):
        capsys.readouterr()
        assert cli.main(["--index-dir", f"file://{tmp_path}/idx", *args]) == 0
        out = capsys.readouterr().out
        return json.loads(out) if out.startswith(("{", "[")) else out

    assert run("ingest", f"file://{notes}/MEMORY.md")["written"] == 2
    assert run("scan", f"file://{notes}", "--dry-run")["scanned"] == 3
    assert run("stats")["total"] == 2
    assert run("rebuild")["postings"] > 0
    assert run("distill", "--dry-run")["summary"]["total_chunks"] == 2
    assert run("inject", str(tmp_path / "d.md"))["ok"] and (tmp_path / "d.md").exists()
    assert run("reclassify")["total"] == 2
    assert run("dedup-noise", "no-such-project")["kept"] == 0 and run("stats")["total"] == 2
    (tmp_path / "gold.jsonl").write_text('{"query": "sqlite RAG", "relevant_ids": []}\n')
    assert "latency_p95_ms" in run("eval", f"file://{tmp_path}/gold.jsonl")
    assert run("oneshot", f"file://{notes}", "--digest", str(tmp_path / "e.md"))["scan"]["scanned"] == 3


def test_stream(spark, notes, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/idx")
    watch(m, f"file://{notes}", f"file://{tmp_path}/ck", every=None).awaitTermination()
    assert m.stats()["total"] == 4
    (notes / "late_memory.md").write_text("a note that came later than the others")
    watch(m, f"file://{notes}", f"file://{tmp_path}/ck", every=None).awaitTermination()
    assert m.stats()["total"] == 5 and os.path.isdir(tmp_path / "ck")


def test_a_batch_that_comes_again_changes_nothing(spark, notes, tmp_path, monkeypatch):
    """The stream dies after a batch was taken and before its checkpoint says so."""
    m = Memory(spark, f"file://{tmp_path}/idx", embedder=ModelEmbedder(bag))
    change = m.store.streams.change

    def dies(rows):
        change(rows)
        raise OSError("lost")

    monkeypatch.setattr(m.store.streams, "change", dies)
    with pytest.raises(Exception, match="lost"):
        watch(m, f"file://{notes}", f"file://{tmp_path}/ck", every=None).awaitTermination()
    before, number = sorted(map(repr, m.store.chunks().drop("ts").collect())), m.store.table.current()
    monkeypatch.setattr(m.store.streams, "change", change)
    watch(m, f"file://{notes}", f"file://{tmp_path}/ck", every=None).awaitTermination()
    assert sorted(map(repr, m.store.chunks().drop("ts").collect())) == before and m.store.table.current() == number
    (notes / "late_memory.md").write_text("a note that came later than the others")
    watch(m, f"file://{notes}", f"file://{tmp_path}/ck", every=None).awaitTermination()
    assert m.store.chunks().count() == len(before) + 1


def test_devices(monkeypatch):
    from mnemoflow import embedding

    assert embedding.chosen_device("cuda:1") == "cuda:1" and embedding.chosen_device("auto") in ("cpu", "cuda")

    def make(device):
        if device != "cpu":
            raise RuntimeError(f"no {device}")
        return "model"

    monkeypatch.setattr(embedding, "made_by_test", make, raising=False)
    assert embedding.loaded("mnemoflow.embedding:made_by_test", "cuda")() == "model"
    monkeypatch.setattr(embedding, "made_by_test", lambda device: (_ for _ in ()).throw(RuntimeError("broken")))
    with pytest.raises(RuntimeError, match="broken"):
        embedding.loaded("mnemoflow.embedding:made_by_test", "cpu")()
