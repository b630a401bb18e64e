"""Embedders turn a text column into a vector column; query rewriters turn a query into a text to embed."""

from __future__ import annotations

import hashlib
import importlib
import logging
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoflow.functions import scalar, vocab


class Embedder(Protocol):
    """backend "hash" says that similarity carries no meaning."""

    backend: str

    def embed(self, text: Column) -> Column: ...


class HashEmbedder:
    backend = "hash"

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, text: Column) -> Column:
        return scalar.hash_embed(text, self.dim)

    def embed_many(self, text: Column) -> Column:
        """The same vectors, for many rows: each text is hashed once, and its hash continued for every position."""
        ends = [f":{i}".encode() for i in range(self.dim)]

        def first_bytes(text: str) -> bytes:
            own, out = hashlib.md5(text.encode("utf-8", "surrogatepass")), bytearray()
            for end in ends:
                one = own.copy()
                one.update(end)
                out += one.digest()[:1]
            return bytes(out)

        def run(texts: pd.Series) -> pd.Series:
            there = texts.notna().to_numpy()
            v = np.frombuffer(b"".join(map(first_bytes, texts[there])), np.uint8).reshape(-1, len(ends)) / 255 - 0.5
            total = np.zeros(len(v))
            for k in range(len(ends)):  # added up in the order of the positions, like the column
                total += v[:, k] * v[:, k]
            found = iter(v / np.sqrt(total)[:, None])
            return pd.Series([next(found) if t else None for t in there], dtype=object)

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "array<double>")(text)


class ModelEmbedder:
    """Any model: ``load`` runs once in each worker and gives a function from a list of texts to vectors, which are normalised here."""

    backend = "model"

    def __init__(self, load: Callable[[], Callable[[list[str]], list]], normalise: bool = True) -> None:
        self.load, self.normalise = load, normalise

    def embed(self, text: Column) -> Column:
        load, normalise = self.load, self.normalise

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import numpy as np

            model = load()
            for texts in batches:
                v = np.asarray(model(texts.fillna("").tolist()), float).reshape(len(texts), -1)
                if normalise and len(v):
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    v = v / np.where(n == 0, 1, n)
                yield pd.Series(list(v))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<double>")(text)


def chosen_device(wanted: str) -> str:
    """The device to load a model on, in the process that loads it; "auto" takes an accelerator if the runtime there has one."""
    if wanted != "auto":
        return wanted
    try:
        import onnxruntime
    except ImportError:
        return "cpu"
    return "cuda" if "CUDAExecutionProvider" in onnxruntime.get_available_providers() else "cpu"


def loaded(name: str, device: str) -> Callable[[], object]:
    """What ``module:function`` gives for a device, as a function that a worker calls. A model that cannot be loaded on its device is loaded on the CPU."""
    module, _, function = name.partition(":")

    def load() -> object:
        make, at = getattr(importlib.import_module(module), function), chosen_device(device)
        try:
            return make(at)
        except (RuntimeError, ValueError, OSError) as e:
            if at == "cpu":
                raise
            logging.getLogger(__name__).warning("%s cannot be loaded on %s (%s), so on the CPU", name, at, e)
            return make("cpu")

    return load


def embedder_of(settings: dict) -> Embedder:
    """The embedder that the settings name: "hash", or ``module:function``, a function of the device that gives a model."""
    name = settings["embedding_model"]
    return HashEmbedder(settings["embedding_dim"]) if name == "hash" else ModelEmbedder(loaded(name, settings["device"]))


def mock_rewrite(query: str) -> str:
    """The template answer without a language model."""
    if not query.strip():
        return query
    templates = vocab.REWRITE_TEMPLATES
    return templates[sum(map(ord, query)) % len(templates)].replace("{query}", query) + " " + query


class Rewriter:
    """Hypothetical answers for queries: a callable, else (or if it fails or is empty) the template; kept for some time."""

    def __init__(self, llm: Callable[[str], str] | None = None, ttl: float = 300.0, most: int = 500) -> None:
        self.llm, self.ttl, self.most = llm, ttl, most
        self.kept: dict[str, tuple[float, str]] = {}

    def generate(self, query: str) -> str:
        if not query.strip():
            return query
        now = time.monotonic()
        if query in self.kept and now - self.kept[query][0] < self.ttl:
            return self.kept[query][1]
        text = ""
        if self.llm is not None:
            try:
                text = self.llm(query) or ""
            except (ValueError, RuntimeError, OSError):
                text = ""
        text = text if text.strip() else mock_rewrite(query)
        if len(self.kept) >= self.most:
            self.kept = {k: v for k, v in self.kept.items() if now - v[0] < self.ttl}
        self.kept[query] = (now, text)
        return text

    def rewrite(self, text: Column) -> Column:
        """The same as a column: without a language model in generated code, else each worker asks and keeps its answers."""
        if self.llm is None:
            return scalar.rewrite(text)
        llm, ttl, most = self.llm, self.ttl, self.most

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = Rewriter(llm, ttl, most)
            for queries in batches:
                yield queries.map(lambda q: None if q is None else own.generate(q))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "string")(text)
