"""The facade: add notes, scan folders, search, and maintain, over one store."""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.embedding import Embedder, Rewriter, embedder_of
from mnemoflow.operators import chunking, dedup, evaluation, fulltext, maintenance, retrieval
from mnemoflow.operators.vector import knn
from mnemoflow.sources import config, files
from mnemoflow.sources.scores import StoredScores
from mnemoflow.sources.store import ChunkStore
from mnemoflow.sources.workspace import ensure_checkpoint_dir, local_rows

#: Bounds of a request.
MOST_RESULTS, MOST_BATCH_RESULTS, CANDIDATE_RANGE, MOST_QUERIES = 50, 20, (5, 100), 50


LEG = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("rank", pa.int32())])
ASKED = pa.schema([("query_id", pa.int64()), ("text", pa.string()), ("embedded", pa.string())])
FOUND = pa.schema([("id", pa.string()), ("query_text", pa.string())])


def check_request(query: str, top_k: int, candidates: int, most: int = MOST_RESULTS) -> None:
    if not query:
        raise ValueError("the query is empty")
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k must be 1 to {most}")
    if not CANDIDATE_RANGE[0] <= candidates <= CANDIDATE_RANGE[1]:
        raise ValueError(f"candidates must be {CANDIDATE_RANGE[0]} to {CANDIDATE_RANGE[1]}")


def clamp_results(top_k: int) -> int:
    return max(1, min(20, top_k))


class Memory:
    def __init__(self, spark: SparkSession, index_dir: str, embedder: Embedder | None = None, scorer: retrieval.Scorer | StoredScores | None = None, rewriter: Rewriter | None = None, settings: dict | None = None) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.settings = spark, settings or config.load(env={})
        self.store = ChunkStore(spark, index_dir)
        # Searches are small plans with known bounds: planned once, in a session of their own, each is few jobs.
        self.finder = spark.newSession()
        for name, value in {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism), "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone")}.items():
            self.finder.conf.set(name, value)
        self.found = ChunkStore(self.finder, index_dir)
        self.embedder = embedder or embedder_of(self.settings)
        self.scorer, self.rewriter = scorer or retrieval.scorer_of(self.settings), rewriter

    # -- writing -----------------------------------------------------------------------------------
    def add(self, text: str, source: str | None = None, project: str | None = None) -> list[dict]:
        """Chunks of one text in; the decision on each, in order."""
        notes = self.spark.createDataFrame([(source or "", text)], "path string, text string")
        return [r.asDict() for r in self.add_notes(notes, project).orderBy("ordinal").drop("ordinal").collect()]

    def add_notes(self, notes: DataFrame, project: str | None = None) -> DataFrame:
        """Chunks, embeds (once) and judges notes (path, text) in the order of their paths, and writes what they change; a row for each decision."""
        rows = chunking.metadata(chunking.chunk_notes(notes), "path")
        if project:
            rows = rows.withColumn("project", F.lit(project))
        rows = rows.withColumn("embedding", getattr(self.embedder, "embed_many", self.embedder.embed)(F.col("text")))
        return self.add_chunks(rows.withColumn("ordinal", F.concat_ws("\0", "path", F.lpad(F.col("ordinal").cast("string"), 10, "0"))))

    def add_chunks(self, rows: DataFrame) -> DataFrame:
        """rows: the store's columns and an ordinal that settles their order. Returns id, decision, existing_id, similarity, ordinal and path, if there is one."""
        order = rows.checkpoint()
        if not order.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # only then rows are shuffled
            order = order.dropDuplicates(["id"]).checkpoint()
        if self.embedder.backend == "hash" or order.isEmpty():
            found, new = order.select("id", F.lit("insert").alias("decision"), F.lit(None).cast("string").alias("existing_id"), F.lit(None).cast("double").alias("similarity")), order
        else:
            found = dedup.decide_in_order(order, self.store.chunks(), self.settings["dedup_threshold"], self.settings["dedup_skip_low"]).checkpoint()
            new = dedup.changes(order, found)
        if not order.isEmpty():
            self.store.append(new)
        return found.join(order.select("id", "ordinal", *(["path"] if "path" in order.columns else [])), "id")

    def add_file(self, path: str, project: str | None = None) -> int:
        """Chunks inserted or merged from one file."""
        raw = self.spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
        return self.ingest_files(raw, project).where("decision <> 'skip'").count()

    def ingest_files(self, found: DataFrame, project: str | None = None) -> DataFrame:
        return self.add_notes(files.decode(found).select("path", "text"), project)

    def scan(self, folders: Iterable[str] | None = None, ignore: Iterable[str] | None = None, project: str | None = None, incremental: bool = True, dry_run: bool = False, patterns: Iterable[str] | None = None) -> dict:
        """Reads changed notes of some folders in; the report counts files and decisions. Only files that changed are opened."""
        s = self.settings
        found = files.scan(self.spark, folders or s["memory_dirs"], patterns or s["memory_patterns"], s["ignore_patterns"] if ignore is None else ignore, with_content=False).checkpoint()
        state = self.store.scan_state.read()
        kept = found.where("NOT ignored")
        n, left_out, rows_before = found.count(), found.where("ignored").count(), self.store.chunks().count()
        todo = [r.asDict() for r in (files.changed(kept, state) if incremental else kept).select("path", "mtime", "size").orderBy("path").collect()]  # the report names them
        report = {
            "scanned": n, "skipped": left_out, "unchanged": n - left_out - len(todo), "chunks_total": 0, "inserted": 0, "merged": 0, "skipped_dup": 0, "files": [], "incremental": incremental, "dry_run": dry_run,
            "search_width": dedup.search_width(rows_before, most=s["max_search_k"], large=s["large_index_threshold"]),
        }
        if dry_run:
            report["files"] = [r | {"changed": True} for r in todo]
            return report
        by: dict[str, dict[str, int]] = {r["path"]: {} for r in todo}
        for r in dedup.decision_counts(self.ingest_files(files.read(self.spark, list(by)), project), "path").collect():
            by.setdefault(r["path"], {})[r["decision"]] = r["n"]
        total = lambda d: sum(c.get(d, 0) for c in by.values())
        report |= {"chunks_total": sum(map(total, ("insert", "merge", "skip"))), "inserted": total("insert"), "merged": total("merge"), "skipped_dup": total("skip"), "files": [{"path": p, "chunks": sum(c.values()), "decisions": c} for p, c in sorted(by.items())]}
        if incremental:
            self.store.scan_state.write(files.new_state(found))
        return report

    # -- searching ---------------------------------------------------------------------------------
    def ask(self, query: str, top_k: int = 5, **options) -> list[dict]:
        """A search for tools that do not check their requests: the number of results is brought into bounds."""
        return self.search(query, clamp_results(top_k), **options)

    def search(self, query: str, top_k: int = 5, **options) -> list[dict]:
        check_request(query, top_k, options.get("candidates", 20))
        return self.batch_search([query], top_k, **options)[0]

    def batch_search(self, queries: list[str], top_k: int = 5, project: str | None = None, source: str | None = None, use_decay: bool = True, rerank: bool = False, candidates: int = 20, use_hyde: bool = False, record: bool = True, now: str | None = None) -> list[list[dict]]:
        """Results of many queries from one plan; the access log gets a row for each result."""
        if len(queries) > MOST_QUERIES:
            raise ValueError(f"{MOST_QUERIES} queries at most")
        at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        rewriter, asked = self.rewriter or Rewriter(), list(enumerate(queries))
        table = local_rows(self.finder, [(i, q, rewriter.generate(q) if use_hyde else q) for i, q in asked], ASKED)
        legs = [lambda: self._near(table, project, candidates), lambda: self._worded(asked, project, candidates)]
        with ThreadPoolExecutor(len(legs)) as pool:  # two small plans at the same time
            vectors, texts = (f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(leg)) for leg in legs])
        # A request has at most MOST_QUERIES queries with 2 * candidates hits each: its ids are a filter on the files.
        fused = retrieval.fuse(local_rows(self.finder, vectors, LEG), local_rows(self.finder, texts, LEG), self.settings["rrf_k"])
        hits = self.found.with_access(sorted({r[1] for r in [*vectors, *texts]})).drop("embedding").join(F.broadcast(fused), "id")
        again = (lambda h: retrieval.rerank(h, table, self.scorer)) if rerank else None
        found = sorted(retrieval.ranked(hits, at, top_k, source, again, self.settings["tau_days"], use_decay).collect(), key=lambda r: (r["query_id"], r["rank"]))
        if record and found:
            self.found.record_access(local_rows(self.finder, [(r["id"], queries[r["query_id"]]) for r in found], FOUND), at)
        out: list[list[dict]] = [[] for _ in queries]
        for r in found:
            row = r.asDict()
            row["access_count"] += record
            digits = {"score": 4, "rrf_score": 4, "rerank_score": 4, "decay_factor": 3}
            out[row.pop("query_id")].append({k: round(v, digits[k]) if k in digits and v is not None else v for k, v in row.items()})
        return out

    def _near(self, table: DataFrame, project: str | None, candidates: int) -> list[tuple]:
        """The nearest chunks of each query: (query_id, id, rank)."""
        chunks = self.found.chunks()
        pool = chunks.where(F.col("project") == project) if project else chunks
        found = knn(pool, table.select("query_id", self.embedder.embed(F.col("embedded")).alias("vector")), candidates)
        return [tuple(r) for r in found.select("query_id", "id", "rank").collect()]

    def _worded(self, asked: list[tuple[int, str]], project: str | None, candidates: int) -> list[tuple]:
        """The best chunks of each query by its words: (query_id, id, rank). A stored index takes in first what it has missed."""
        if self.found.index.segments():
            self.found.index.catch_up()
            best = self.found.index.best(asked, candidates, "long", self.found.by_project(project) if project else None)
        else:
            best = fulltext.bm25_top(self.found.chunks(), asked, candidates, id_type="long", where=F.col("project") == project if project else None)
        return [tuple(r) for r in best.select("query_id", "id", "rank").collect()]

    # -- maintenance -------------------------------------------------------------------------------
    def stats(self) -> dict:
        return self.store.stats()

    def distill(self, project: str | None = None, top: int | None = None, purge_below: float | None = None, dry_run: bool = False, now: str | None = None) -> dict:
        s = self.settings
        at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        chunks = self.store.with_access().checkpoint()
        rows = maintenance.distill(chunks, at, project, top or s["distill_top_per_group"], s["distill_purge_threshold"] if purge_below is None else purge_below, s["tau_days"]).checkpoint()
        groups = {r["project"]: r.asDict() for r in maintenance.distill_report(rows).collect()}
        purged = sum(g["purge_count"] for g in groups.values())
        average = rows.agg(F.avg("score")).first()[0]
        if purged and not dry_run:
            self.store.delete(rows.where("verdict = 'purge'"))
        return {"groups": groups, "rows": rows, "summary": {"total_chunks": chunks.count(), "projects": len(groups), "purged": 0 if dry_run else purged, "avg_score": round(average or 0.0, 4), "dry_run": dry_run}}

    def inject(self, path: str, dry_run: bool = False, now: str | None = None) -> dict:
        """Writes the digest of the hottest chunks between the markers of a local markdown file."""
        report = self.distill(top=maintenance.PROJECT_ROWS, dry_run=True, now=now)
        rows = [r.asDict() for r in maintenance.digest_rows(report["rows"]).collect()]
        body = maintenance.render_digest(rows, len(report["groups"]), report["summary"]["total_chunks"], (now or datetime.now().isoformat(" "))[:16])
        file = Path(path)
        old = file.read_text(encoding="utf-8") if file.exists() else None
        new = maintenance.put_digest(old, body)
        if not dry_run:
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(new, encoding="utf-8")
        return {"ok": True, "dry_run": dry_run, "before_chars": len(old or ""), "after_chars": len(new), "auto_block_chars": len(body), "projects_injected": body.count("### "), "chunks_injected": body.count("- `")}

    def noise_dedup(self, keep_projects: Iterable[str], dry_run: bool = True) -> dict:
        before = self.store.with_access().checkpoint()
        kept = maintenance.noise_dedup(before, keep_projects).checkpoint()
        n = before.count(), kept.count()
        if not dry_run:
            self.store.delete(before.join(kept.select("id"), "id", "left_anti"))
        return {"before": n[0], "kept": n[1], "dropped": n[0] - n[1]}

    def evaluate(self, gold: DataFrame, top_k: int = 10, timed: int = 10, **options) -> dict:
        """Mean metrics over a gold set (query_id, query, relevant_ids) and those of each query, and the latency of its first ``timed`` queries, searched one by one; the others come in batches."""
        rows = gold.orderBy("query_id").collect()
        found, times = [], []
        for r in rows[:timed]:
            began = time.perf_counter()
            found.append(self.batch_search([r["query"]], top_k, record=False, **options)[0])
            times.append((1000 * (time.perf_counter() - began),))
        found += [x for i in range(timed, len(rows), MOST_QUERIES) for x in self.batch_search([r["query"] for r in rows[i : i + MOST_QUERIES]], top_k, record=False, **options)]
        ranked = [(r["query_id"], h["id"], h["rank"]) for r, hits in zip(rows, found, strict=True) for h in hits]
        metrics = evaluation.per_query(self.spark.createDataFrame(ranked, "query_id string, id string, rank int"), gold)
        ms = evaluation.latency(self.spark.createDataFrame(times, "ms double"), "ms").first() if times else None
        asked, least = {r["query_id"]: r["query"] for r in rows}, {r["query_id"]: t for r, (t,) in zip(rows, times, strict=False)}
        details = [{"query": asked[r["query_id"]], **{k: v for k, v in r.asDict().items() if k != "query_id"}, "latency_ms": least.get(r["query_id"])} for r in metrics.orderBy("query_id").collect()]
        about = {"date": datetime.now().isoformat(" ", "minutes"), "chunks": self.store.chunks().count(), "details": details}
        return evaluation.summary(metrics).first().asDict() | {"latency_p50_ms": ms["p50"] if ms else None, "latency_p95_ms": ms["p95"] if ms else None} | about

    def health(self) -> dict:
        return maintenance.health(self.store.with_access(), self.settings["large_index_threshold"], self.store.files())

    def run_once(self, folders: Iterable[str], digest_path: str | None = None, now: float | None = None) -> dict:
        """Scan, distill if it is due, and write the digest."""
        at = datetime.now().timestamp() if now is None else now
        out = {"scan": self.scan(folders)}
        state = self.store.distill_state.read().take(1)
        if maintenance.should_distill(state[0]["last_distill_ts"] if state else None, at):
            out["distill"] = self.distill()["summary"]
            self.store.distill_state.write(self.spark.createDataFrame([(float(at), out["distill"]["total_chunks"])], self.store.distill_state.schema))
        if digest_path:
            out["inject"] = self.inject(digest_path)
        return out
