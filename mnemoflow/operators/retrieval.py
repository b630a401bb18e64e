"""Hybrid retrieval of many queries in one plan: two ranked legs, rank fusion, re-weighting, rerank, top k."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoflow.embedding import loaded
from mnemoflow.functions import scalar
from mnemoflow.sources.scores import StoredScores
from mnemoflow.sources.workspace import ensure_checkpoint_dir

RRF_K, TAU_DAYS, CANDIDATES, RERANK_TOP = 30, 90.0, 20, 20
#: Hits (three numbers and an id each) that go to all tasks at most.
BROADCAST_HITS = 200_000


class Scorer(Protocol):
    """Scores documents for a query, higher is better."""

    def score(self, query: str, documents: list[str]) -> list[float]: ...


class OverlapScorer:
    """A scorer without a model: the share of the query's words that a document has, on a logistic scale."""

    def score(self, query: str, documents: list[str]) -> list[float]:
        import math

        own = set(query.lower().split())
        return [1 / (1 + math.exp(-(8 * len(own & set(d.lower().split())) / max(1, len(own)) - 4))) for d in documents]


#: Of a worker process: models by scorer, and scores by scorer, query and document with the time they were made.
_MODELS: dict[str, Callable[[list[tuple[str, str]]], list[float]]] = {}
_SCORES: dict[tuple[str, str, str], tuple[float, float]] = {}


class ModelScorer:
    """Any model: ``load`` runs once in each worker and gives a function from (query, document) pairs to scores. Pairs go in batches, and scores are kept for some time."""

    def __init__(self, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 8, ttl: float = 300.0, most: int = 10_000) -> None:
        self.load, self.batch, self.ttl, self.most, self.name = load, batch, ttl, most, uuid.uuid4().hex

    def score(self, query: str, documents: list[str]) -> list[float]:
        now = time.monotonic()
        fresh = lambda k: k in _SCORES and now - _SCORES[k][0] < self.ttl
        keys = [(self.name, query, d) for d in documents]
        todo = [k for k in dict.fromkeys(keys) if not fresh(k)]
        if todo and self.name not in _MODELS:
            _MODELS[self.name] = self.load()
        new = {}
        for i in range(0, len(todo), self.batch):
            part = todo[i : i + self.batch]
            new |= dict(zip(part, map(float, _MODELS[self.name]([(q, d) for _, q, d in part])), strict=True))
        out = [new[k] if k in new else _SCORES[k][1] for k in keys]
        if len(_SCORES) + len(new) > self.most:
            for k in [k for k, (at, _) in _SCORES.items() if now - at >= self.ttl] or list(_SCORES):
                del _SCORES[k]
        _SCORES.update({k: (now, v) for k, v in new.items()})
        return out


def scorer_of(settings: dict) -> Scorer:
    """The scorer that the settings name: "overlap", or ``module:function``, a function of the device that gives a model of pairs."""
    name = settings["reranker_model"]
    return OverlapScorer() if name == "overlap" else ModelScorer(loaded(name, settings["device"]))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Full outer join of two legs (query_id, id, rank from 0) with the reciprocal rank score; a rank is null where a leg misses."""
    v = vector_hits.select("query_id", "id", F.col("rank").alias("vector_rank"))
    b = text_hits.select("query_id", "id", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(rrf_k) + F.col(c) + 1), F.lit(0.0))
    return v.join(b, ["query_id", "id"], "full_outer").withColumn("rrf_score", part("vector_rank") + part("bm25_rank"))


def with_chunks(hits: DataFrame, chunks: DataFrame, most: int = BROADCAST_HITS) -> DataFrame:
    """Hits with their chunks. Hits are few rows for each query: written once and counted, they go to the chunks, up to ``most`` of them; beyond that both are shuffled by id."""
    ensure_checkpoint_dir(hits.sparkSession)
    hits = hits.checkpoint()
    return chunks.join(F.broadcast(hits) if hits.count() <= most else hits, "id")


def weigh(hits: DataFrame, now: Column, tau_days: float = TAU_DAYS, use_decay: bool = True, popularity: str = "intent") -> DataFrame:
    """Adds decay_factor and score to hits with rrf_score, ts, confidence and access_count.

    popularity "intent" uses the real access counts, "constant" none (then the factor is ln 2).
    """
    count = F.col("access_count") if popularity == "intent" else F.lit(0)
    factor = scalar.decay(F.col("ts"), count, now, tau_days) if use_decay else F.lit(1.0)
    weight = 0.7 + 0.3 * F.coalesce(F.col("confidence"), F.lit(0.5))
    return hits.withColumn("decay_factor", factor).withColumn("score", F.col("rrf_score") * F.col("decay_factor") * weight)


def rerank(hits: DataFrame, queries: DataFrame, scorer: Scorer | StoredScores | None = None, top: int = RERANK_TOP, max_length: int = 512, on_error: str = "keep") -> DataFrame:
    """Adds rerank_score to the first ``top`` hits of each query (0 for others).

    Documents are cut to the scorer's room. Stored scores are looked up and completed when this is called. If scoring fails with a runtime, value or system error, the
    fused order stays (on_error "keep") or the error is raised.
    """
    scorer = scorer or OverlapScorer()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id").withColumn("fused_rank", F.row_number().over(order) - 1)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for query, doc in batches:
            out = pd.Series([None] * len(query), dtype="Float64")
            for q, at in query.groupby(query).groups.items():
                try:
                    out.loc[at] = scorer.score(q, doc.loc[at].tolist())
                except (RuntimeError, ValueError, OSError):
                    if on_error != "keep":
                        raise
            yield out

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    score = F.pandas_udf(run, "double")
    first, cut = ranked.where(F.col("fused_rank") < top), scalar.rerank_cut(F.col("text"), max_length)
    if isinstance(scorer, StoredScores):
        first = scorer.score(first.withColumn("document", cut), on_error=on_error, name="rerank_score").drop("document")
    else:
        first = first.withColumn("rerank_score", score(F.col("query"), cut))
    rest = ranked.where(F.col("fused_rank") >= top).withColumn("rerank_score", F.lit(0.0))
    return first.unionByName(rest).drop("query", "fused_rank")


def hybrid(
    chunks: DataFrame, vector_hits: DataFrame, text_hits: DataFrame, now: Column, top_k: int = 5, source: str | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None,
    rrf_k: int = RRF_K, tau_days: float = TAU_DAYS, use_decay: bool = True, popularity: str = "intent",
) -> DataFrame:
    """Ranked results: query_id, id, rank (from 0), score and everything that made it.

    chunks: id, text, source, project, ts, confidence, access_count, and entities if they are kept. A filter by
    source comes after the legs, so it can leave fewer than top_k; a filter by project belongs in the legs.
    """
    hits = with_chunks(fuse(vector_hits, text_hits, rrf_k), chunks)
    return ranked(hits, now, top_k, source, reranker, tau_days, use_decay, popularity)


def ranked(
    hits: DataFrame, now: Column, top_k: int = 5, source: str | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None,
    tau_days: float = TAU_DAYS, use_decay: bool = True, popularity: str = "intent",
) -> DataFrame:
    """The ranking of fused hits that have their chunks."""
    if source is not None:
        hits = hits.where(F.col("source") == source)
    hits = weigh(hits, now, tau_days, use_decay, popularity)
    if reranker is not None:
        hits = reranker(hits).withColumn("score", F.coalesce("rerank_score", "score"))
        by = [F.desc(F.round("score", 12)), F.desc(F.round("rrf_score", 12)), F.col("id")]
    else:
        by = [F.desc(F.round("score", 12)), F.col("id")]
    order = Window.partitionBy("query_id").orderBy(*by)
    return hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top_k)
