"""Exact substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt into blocks by a hash of their content. In each block every window of every
document gets a rolling hash; equal windows of a block are merged before the shuffle, so that a
passage which a third of all documents share is sent once per block. The distinct hashes travel as
packed, sorted binaries, cut by hash range into buckets; a bucket's task counts how many blocks hold
each hash and answers every block with a bit mask. A block sends a message for each bucket that it has a
hash of, so there are at most as many messages as blocks times buckets, and never more than windows.
Blocks and buckets follow the bytes of the corpus; up to ``PARTITIONS`` of them are partitions of their
own, more share partitions, and a task still has one at a time. Back at its block each document turns its
repeated windows into maximal removal intervals. Text moves once, hashes once, and no group grows
with the frequency of a passage.

Two Rabin-Karp hashes decide whether windows are equal: 64 bits modulo 2**64 and 16 bits from a prime
field, over word hashes that are not polynomials. A false match is expected once in about 2**80 pairs.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import small_batches
from mnemoflow.llm.textkit import buffers, column_words, give_back, rolling

#: Bytes of text in a block, and of packed hashes in a bucket, on average.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 24 << 20
#: Partitions of a shuffle by number at most.
PARTITIONS = 20_000


def _windows(text: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes (64 and 16 bits), row and first word (in its row) of every window."""
    out = []
    for i, _, w in column_words(text):
        h = w.hashes()
        one, at = rolling(h, w.first, width)
        two, _ = rolling(h, w.first, width, 1)
        row = np.searchsorted(w.first, at, "right") - 1
        out.append((one, (two >> np.uint64(48)).astype(np.uint16), (row + i).astype(np.int32), (at - w.first[row]).astype(np.int32)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, where a new value begins in it, and the number of each value in it."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new, np.cumsum(new) - 1


def _bucket(one: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so that a sorted array is cut into pieces."""
    return (((one >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _hash_block(width: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        one, two, _, _ = _windows(table["text"], width)
        order, new, number = _distinct(one, two)
        a, b = one[order][new], two[order][new]
        twice = np.bincount(number, minlength=len(a)) > 1 if len(a) else np.zeros(0, bool)
        bucket = _bucket(a, buckets)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(a)], strict=True)) if len(a) else []
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "bucket": pa.array([k for k, _, _ in rows], pa.int32()),
            "one": pa.array([a[i:j].tobytes() for _, i, j in rows], pa.binary()),
            "two": pa.array([b[i:j].tobytes() for _, i, j in rows], pa.binary()),
            "twice": pa.array([np.packbits(twice[i:j]).tobytes() for _, i, j in rows], pa.binary()),
        })

    return run


def _count_bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    sizes = [len(x.as_py()) // 8 for x in table["one"]]
    one = np.frombuffer(b"".join(x.as_py() for x in table["one"]), np.uint64)
    two = np.frombuffer(b"".join(x.as_py() for x in table["two"]), np.uint16)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(table["twice"], sizes, strict=True)])
    order, _, number = _distinct(one, two)
    found = np.bincount(number)
    again = found > 1
    again[number[twice[order]]] = True
    mask = np.empty(len(one), bool)
    mask[order] = again[number]
    cut = np.cumsum([0, *sizes])
    masks = [mask[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    some = [x.any() for x in masks]
    return pa.table({
        "block": table["block"].combine_chunks().filter(pa.array(some)),
        "bucket": pa.array([key[0].as_py()] * sum(some), pa.int32()),
        "mask": pa.array([np.packbits(x).tobytes() for x in compress(masks, some)], pa.binary()),
    })


def _cut_block(width: int, buckets: int, keep_text: bool):
    def run(docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        give_back()
        one, two, row, at = _windows(docs["text"], width)
        order, new, number = _distinct(one, two)
        a = one[order][new]
        bucket, asked = _bucket(a, buckets), verdicts["bucket"].to_numpy()
        again = np.zeros(len(a), bool)
        for i, j, mask in zip(np.searchsorted(bucket, asked), np.searchsorted(bucket, asked, "right"), verdicts["mask"].to_pylist(), strict=True):
            again[i:j] = np.unpackbits(np.frombuffer(mask, np.uint8), count=j - i)
        hit = np.empty(len(one), bool)
        hit[order] = again[number]
        row, at = row[hit], at[hit]
        first = np.searchsorted(row, np.arange(len(docs) + 1))
        data, offsets = buffers(docs["text"])
        total, removed, kept = [], [], []
        for d in range(len(docs)):
            own = data[offsets[d] : offsets[d + 1]].tobytes().split()
            mine = at[first[d] : first[d + 1]]
            n = len(own)
            gone = np.zeros(n, bool)
            if len(mine):
                # Windows that touch or overlap make one interval, which none of them can extend.
                edges = np.zeros(n + 1, np.int32)
                np.add.at(edges, mine, 1)
                np.add.at(edges, mine + width, -1)
                gone = np.cumsum(edges[:-1]) > 0
                own = list(compress(own, ~gone))
            total.append(n)
            removed.append(int(gone.sum()))
            kept.append(b" ".join(own))
        out = {"doc_id": docs["doc_id"], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        if keep_text:
            return pa.table(out | {"kept_text": pa.array([x.decode() for x in kept], pa.string())})
        return pa.table(out | {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})

    return run


def _dealt(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.repartitionById(n, column) if n <= PARTITIONS else df.repartition(PARTITIONS, column)


def substring_dedup(docs: DataFrame, width: int = 35, keep_text: bool = True) -> DataFrame:
    """Removes each word covered by a window of ``width`` words that starts anywhere else as well.

    docs: doc_id (long) and text; other columns are not read. Returns doc_id, n_words, n_removed and
    kept_text (kept words joined by one space), or kept_sha256 instead of the text.

    Null and empty texts, and texts without words, have no words: (0, 0, ''). Rows with a null or a
    repeated doc_id are documents like others, so a text of enough words that comes twice is
    removed in both. An empty table gives no rows. A text of fewer words than ``width`` stays whole.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, buckets = max(1, math.ceil(size / BLOCK_BYTES)), max(1, math.ceil(size * 1.8 / BUCKET_BYTES))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    docs = _dealt(docs, "block", blocks)
    hashed = docs.groupBy("block").applyInArrow(_hash_block(width, buckets), "block int, bucket int, one binary, two binary, twice binary")
    counted = _dealt(hashed, "bucket", buckets).groupBy("bucket").applyInArrow(_count_bucket, "block int, bucket int, mask binary")
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_text string" if keep_text else "kept_sha256 string")
    return docs.groupBy("block").cogroup(_dealt(counted, "block", blocks).groupBy("block")).applyInArrow(_cut_block(width, buckets, keep_text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35, keep_text=False)


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), again AS (
  SELECT h FROM s GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT r, list_distinct(flatten(list(range(i, i + 35)))) AS pos FROM s WHERE h IN (SELECT h FROM again) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(pos), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN pos IS NULL THEN array_to_string(ws, ' ')
    ELSE array_to_string(list_transform(list_sort(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(pos, x))), lambda x: ws[x]), ' ') END) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""
