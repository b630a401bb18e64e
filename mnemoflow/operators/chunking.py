"""Segmentation of notes into fact-sized chunks with heuristic metadata, as DataFrame expressions.

A note is cut at embedded JSON blocks, headings, blank lines and, where a paragraph is too long, at
sentence ends. All of it runs in the JVM; only the values inside a JSON block, which are rendered
the way Python prints them, go through an Arrow function, and only for notes that have a block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoflow.functions import scalar, vocab

BLOCK = r"(?s)" + re.escape(vocab.BLOCK_START) + r"\s*\n(.*?)\n\s*" + re.escape(vocab.BLOCK_END)
#: Characters that end a sentence.
STOPS = "。！？；.!?;"
#: The line break before a heading.
HEADING = r"\n(?=#{1,3}\s)"


def blocks(text: Column) -> Column:
    """The contents of the embedded JSON blocks."""
    return F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))


def without_blocks(text: Column, by: str = " ") -> Column:
    return F.regexp_replace(text, BLOCK, by)


def is_profile_copy(text: Column, keys: Iterable[str] = vocab.PROFILE_KEYS) -> Column:
    """A note that is little more than a block whose object has a profile's keys; such notes give no chunks."""
    names = F.json_object_keys(F.get(blocks(text), F.lit(0)))
    return F.coalesce((F.length(scalar.strip(without_blocks(text, ""))) < 20) & F.arrays_overlap(names, F.array(*map(F.lit, keys))), F.lit(False))


def sections(text: Column) -> Column:
    """Cut before headings of one to three marks; the heading stays with its section."""
    return F.split(scalar.strip(text), HEADING)


def paragraphs(section: Column) -> Column:
    """Cut at blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(section, r"\n\n+"), scalar.strip), lambda p: p != "")


def sentences(paragraph: Column, max_length: int = 500) -> Column:
    """Sentences packed until a piece ends one and the pack is longer than half the limit; text without a stop stays whole.

    A pack ends with the first stop that has half the limit of characters before it: one expression finds it, without going back.
    """
    packed = F.regexp_extract_all(paragraph, F.lit(f"(?s).{{{max_length // 2}}}[^{STOPS}]*+[{STOPS}]|.+"), F.lit(0))
    return F.filter(F.transform(packed, scalar.strip), lambda p: p != "")


def text_pieces(text: Column, max_length: int = 500) -> Column:
    """All pieces of the running text in order: the paragraphs of its sections, cut at once, and their sentences where they are too long."""
    cut = lambda p: F.when(F.length(p) > max_length, sentences(p, max_length)).otherwise(F.array(p))
    parts = F.split(scalar.strip(without_blocks(text)), rf"\n\n+|{HEADING}")
    return F.flatten(F.transform(F.filter(F.transform(parts, scalar.strip), lambda p: p != ""), cut))


def block_lines(block: str) -> list[tuple[str, str | None, str | None]]:
    """(line, key, memory_type) of one JSON block: known keys first, then other plain values in their order."""
    body = block.strip()
    try:
        data = json.loads(body)
    except ValueError:
        return [(body, None, None)]
    if not isinstance(data, dict):
        return [(json.dumps(data, ensure_ascii=False), None, None)]
    kind = str(data.get("memory_type", "unknown"))

    def shown(value: object) -> str:
        if isinstance(value, list):
            return "; ".join(map(str, value))
        if isinstance(value, dict):
            return "; ".join(f"{k}={v}" for k, v in value.items())
        return str(value)

    first = [k for k in vocab.PRIORITY_KEYS if k in data]
    rest = [k for k, v in data.items() if k not in vocab.PRIORITY_KEYS and isinstance(v, (str, int, float))]
    return [(f"{k}: {shown(data[k])}", k, kind) for k in first + rest]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("text", "json_key", "memory_type")])))
def _block_pieces(found: pd.Series) -> pd.Series:
    return found.map(lambda bs: [dict(zip(("text", "json_key", "memory_type"), x, strict=True)) for b in bs for x in block_lines(b)])


def metadata(chunks: DataFrame, path: str | None = None, now: str | None = None, entity_terms: Iterable[str] = vocab.ENTITY_TERMS, decision_words: Iterable[str] = vocab.DECISION_WORDS) -> DataFrame:
    """Adds project, entities, confidence, source, length and ts (the given ingest time) to rows that have text."""
    t = F.col("text")
    return chunks.withColumns({
        "project": scalar.extract_project(t), "entities": scalar.extract_entities(t, entity_terms), "confidence": scalar.confidence(t, decision_words),
        "source": scalar.detect_source(t, F.col(path) if path else None), "length": F.length(t), "ts": F.to_timestamp(F.lit(now)) if now else F.current_timestamp(),
    })


def chunk_notes(notes: DataFrame, key: str = "path", min_length: int = 8, max_length: int = 500, with_blocks: bool = True) -> DataFrame:
    """Rows (key, ordinal, id, text, block_type, json_key, memory_type) of notes (key, text).

    The chunks of JSON blocks come first, then those of the text in order. ids are hashes of the note's
    key, the ordinal and the text. Notes that are null, blank or a profile copy give none.
    """
    kind = "array<struct<text:string,json_key:string,memory_type:string,block_type:string>>"
    t = F.col("text")
    plain = F.transform(text_pieces(t, max_length), lambda p: F.struct(p.alias("text"), F.lit(None).cast("string").alias("json_key"), F.lit(None).cast("string").alias("memory_type"), F.lit(None).cast("string").alias("block_type"))).cast(kind)
    notes = notes.select(F.col(key), t).where(t.rlike(r"(?U)\S"))

    def rows(some: DataFrame, pieces: Column) -> DataFrame:
        fine = F.filter(pieces, lambda p: scalar.keeps_length(p["text"], min_length))
        return some.select(key, F.posexplode(fine).alias("ordinal", "p")).select(key, "ordinal", "p.*")

    if with_blocks:
        has = F.contains(t, F.lit(vocab.BLOCK_START)) & (F.size(blocks(t)) > 0)
        own = notes.where(has & ~is_profile_copy(t)).withColumn("b", _block_pieces(blocks(t)))
        first = F.transform("b", lambda p: F.struct(p["text"].alias("text"), p["json_key"].alias("json_key"), p["memory_type"].alias("memory_type"), F.lit("raw_json").alias("block_type"))).cast(kind)
        out = rows(notes.where(~has), plain).union(rows(own, F.concat(first, plain)))
    else:
        out = rows(notes, plain)
    return out.select(key, "ordinal", F.sha2(F.concat_ws("\0", F.col(key).cast("string"), "ordinal", "text"), 256).alias("id"), "text", "block_type", "json_key", "memory_type")
