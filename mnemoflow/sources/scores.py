"""Scores of (query, document) pairs, kept as a table: a model is called once for each different pair.

Pairs of all queries are dealt by their length, so that the pairs of one call are about as long as each
other and a model pads little; ids break ties, so a length that many pairs have is spread over tasks. Scores
are rows by (model, query, document), as a hash of the three, with the time they were made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.sources.folders import VersionedTable
from mnemoflow.sources.workspace import ensure_checkpoint_dir

SCHEMA = "id string, model string, score double, scored_at timestamp"


class StoredScores:
    """``load`` runs once in each task that calls the model, and gives a function from a list of (query, document) to scores.

    Scores older than ``ttl`` seconds are made again; without ``ttl`` they stay. ``model`` names what is loaded:
    another model needs another name.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 8, ttl: float | None = None) -> None:
        ensure_checkpoint_dir(spark)
        self.table, self.model, self.load, self.batch, self.ttl = VersionedTable(spark, folder, SCHEMA), model, load, batch, ttl

    def known(self, now: Column | None = None) -> DataFrame:
        """(id, score) of this model that are fresh at ``now`` (the current time)."""
        rows = self.table.read().where(F.col("model") == self.model)
        if self.ttl is not None:
            age = F.unix_micros(F.current_timestamp() if now is None else now) - F.unix_micros("scored_at")
            rows = rows.where(age < int(self.ttl * 1_000_000))
        return rows.select("id", "score")

    def missing(self, pairs: DataFrame, now: Column | None = None) -> DataFrame:
        """(id, query, document) of each different pair without a fresh score."""
        different = self._keyed(pairs).groupBy("id").agg(F.first("query").alias("query"), F.first("document").alias("document"))
        return different.join(self.known(now).select("id"), "id", "left_anti")

    def add(self, pairs: DataFrame, now: Column | None = None, on_error: str = "raise") -> int:
        """Scores what is missing, and how many pairs that were. If a call fails with a runtime, value or system error, it is raised (or, "keep": its pairs are tried one by one, and those that fail get no score)."""
        load, batch = self.load, self.batch

        def attempt(model: Callable, some: list[tuple[str, str]]) -> list[float | None]:
            try:
                return [float(x) for x in model(some)]
            except (RuntimeError, ValueError, OSError):
                if on_error != "keep":
                    raise
            return [None] if len(some) == 1 else [x for one in some for x in attempt(model, [one])]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for part in parts:
                model, pairs = model or load(), list(zip(part["query"], part["document"], strict=True))
                scores = [x for i in range(0, len(pairs), batch) for x in attempt(model, pairs[i : i + batch])]
                yield pd.DataFrame({"id": part["id"], "score": pd.Series(scores, part.index, dtype="Float64")})

        by = [F.length("query") + F.length("document"), F.col("id")]
        dealt = self.missing(pairs, now).repartitionByRange(*by).sortWithinPartitions(*by)
        new = dealt.mapInPandas(run, "id string, score double").where("score IS NOT NULL").checkpoint()
        n = new.count()
        if n:
            self.table.change(new.withColumn("model", F.lit(self.model)).withColumn("scored_at", F.current_timestamp() if now is None else now))
        return n

    def score(self, pairs: DataFrame, now: Column | None = None, on_error: str = "raise", name: str = "score") -> DataFrame:
        """The rows of pairs (query, document and any other columns) with their scores, stored ones and new ones.

        Null counts as empty text; repeated pairs are scored once; a pair whose call failed has null.
        """
        pairs = pairs.checkpoint()
        self.add(pairs, now, on_error)
        found = self.known(now).select(F.col("id").alias("_pair"), F.col("score").alias(name))
        return self._keyed(pairs, "_pair").drop(*({name} & set(pairs.columns))).join(found, "_pair", "left").drop("_pair")

    def _keyed(self, pairs: DataFrame, name: str = "id") -> DataFrame:
        q, d = (F.coalesce(F.col(c), F.lit("")) for c in ("query", "document"))
        key = F.sha2(F.concat_ws("\0", F.sha2(F.lit(self.model), 256), F.sha2(q, 256), F.sha2(d, 256)), 256)
        if name == "id":
            return pairs.select(key.alias("id"), q.alias("query"), d.alias("document"))
        return pairs.withColumn(name, key)
