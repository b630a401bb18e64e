"""Runs of repeated words by block matching: aligned blocks are found again, and extended exactly.

A run is a longest stretch of words in which words ``q`` apart are equal, for its smallest period q; it
counts from max(6, 4q) words. At the scale of blocks of B words, B a power of two, the periods are those
whose runs surely hold an aligned block together with its copy q words later. A document's aligned
blocks, as sequences of word numbers, are keys of an Aho-Corasick automaton, which finds them all over
the document in one pass; a block found again at a distance of the scale is a seed, extended to both
sides word by word.

Most documents hold no block twice so near. Before any automaton is built, hashes of the first words
of the blocks show it for many documents at once; a block that they leave out cannot be found.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import small_batches
from mnemoflow.llm.textkit import column_words, mix, tidied

#: Words of a run at least, and in periods; words in the keys of one automaton; words of a block that are hashed to foresee its copies.
LEAST, TIMES, AUTOMATON, HEAD = 6, 4, 1 << 20, 4


def _scales(n: int) -> Iterator[tuple[int, int, int]]:
    """(block, shortest period, longest period) for documents of n words. A run of period q has an aligned block and its copy if 2 * block - 1 words or more are followed by words q apart."""
    block, low = 2, 1
    while max(LEAST, TIMES * low) <= n:
        room = lambda q: max(LEAST, TIMES * q) - q
        high = low
        while room(high + 1) < 4 * block - 1 and max(LEAST, TIMES * (high + 1)) <= n:
            high += max(1, (4 * block - 2) // (TIMES - 1) - high - 1)
        yield block, low, min(high, n // TIMES)
        block, low = 2 * block, high + 1


def _foreseen(hashes: np.ndarray, docs: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int, np.ndarray]]]:
    """For each document with such blocks: (block, shortest, longest period, starts of blocks whose first words come again at such a distance)."""
    n, counts = len(hashes), np.diff(first)
    found: dict[int, list[tuple[int, int, int, np.ndarray]]] = {}
    order = width = None
    for block, low, high in _scales(int(counts.max(initial=0))):
        if width != min(block, HEAD):  # words of a document and those after them, as ranks that are equal where these are
            width = min(block, HEAD)
            head = mix(hashes ^ mix(docs.astype(np.uint64), 5), 1)
            for k in range(1, width):
                head[:-k] = mix(head[:-k] * np.uint64(3) + hashes[k:], 1 + k)
            rank = np.unique(head, return_inverse=True)[1].astype(np.int64) * n
            order = np.sort(rank + np.arange(n))
        long = np.flatnonzero(counts >= max(LEAST, TIMES * low))
        blocks = (counts[long] - low - block) // block + 1
        long, blocks = long[blocks > 0], blocks[blocks > 0]
        if not len(long):
            break
        owner = np.repeat(long, blocks)
        own = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * block
        at = first[owner] + own
        near = np.searchsorted(order, rank[at] + at + low)
        hit = order[np.minimum(near, n - 1)] <= rank[at] + at + high
        hit &= near < n
        hit &= order[np.minimum(near, n - 1)] >= rank[at] + at + low
        cut = np.flatnonzero(np.diff(owner[hit], prepend=-1))
        for d, starts in zip(owner[hit][cut], np.split(own[hit], cut[1:]), strict=bool(len(cut))):
            found.setdefault(int(d), []).append((block, low, high, starts))
    return found


def _reach(w: np.ndarray, q: int, at: int, step: int) -> int:
    """How far from ``at`` words stay equal to those q later: to the first place that differs (step 1), or behind the last one (step -1)."""
    size, end = 64, len(w) - q
    while True:
        a, b = (at, min(end, at + size)) if step > 0 else (max(0, at - size), at)
        if a >= b:
            return at
        differ = np.flatnonzero(w[a:b] != w[a + q : b + q])
        if len(differ):
            return int(a + differ[0]) if step > 0 else int(a + differ[-1]) + 1
        at, size = (b if step > 0 else a), 2 * size


def _seeds(w: np.ndarray, block: int, low: int, high: int, starts: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, distances) of aligned blocks that the automaton finds again at distances of the scale.

    A block inside a run of a period r up to its size comes again inside that run only at multiples of r,
    which the run explains, and else only behind the run's last r words. So it is looked for there alone.
    """
    begin, end = starts + low, np.minimum(starts + high + block, len(w))
    for s, n, r in runs:
        if r <= block < n:
            within = slice(*np.searchsorted(starts, [s, s + n - block + 1]))
            begin[within] = np.maximum(begin[within], s + n - r + 1)
    some = end - begin >= block
    starts, begin, end = starts[some], begin[some], end[some]
    seeds = [(np.zeros(0, np.int64),) * 2]
    step = max(1, AUTOMATON // block)
    for i in range(0, len(starts), step):
        part, a, b = starts[i : i + step], int(starts[i]), int(end[i : i + step].max())
        keys: dict[tuple[int, ...], int] = {}
        key = np.array([keys.setdefault(tuple(w[s : s + block].tolist()), len(keys)) for s in part.tolist()])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for sequence, k in keys.items():
            automaton.add_word(sequence, k)
        automaton.make_automaton()
        there = np.full(b - a + high, -1, np.int64)
        ranges: list[list[int]] = []
        for x, y in sorted(zip(begin[i : i + step].tolist(), end[i : i + step].tolist(), strict=True)):
            if ranges and x <= ranges[-1][1]:
                ranges[-1][1] = max(y, ranges[-1][1])
            else:
                ranges.append([x, y])
        for x, y in ranges:
            for last, k in automaton.iter(tuple(w[x:y].tolist())):
                there[x + last - block + 1 - a] = k
        rows = max(1, AUTOMATON // (high - low + 1))
        for j in range(0, len(part), rows):
            s = part[j : j + rows]
            at = (s - a)[:, None] + np.arange(low, high + 1)
            hit, q = np.nonzero(there[np.minimum(at, len(there) - 1)] == key[j : j + rows, None])
            seeds.append((s[hit], q + low))
    return np.concatenate([s for s, _ in seeds]), np.concatenate([q for _, q in seeds])


def find_runs(w: np.ndarray, foreseen: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document of word numbers, by start, then period."""
    runs: list[tuple[int, int, int]] = []
    by: dict[int, list[tuple[int, int]]] = {}  # (start, end) of each period, ascending

    def inside(start: int, end: int, q: int) -> bool:
        for r in [r for r in by if q % r == 0]:
            k = bisect.bisect_right(by[r], (start, len(w)))
            if k and by[r][k - 1][1] >= end:
                return True
        return False

    for block, low, high, blocks in foreseen:
        start, q = _seeds(w, block, low, high, blocks, runs)
        order = np.lexsort((start, q))
        start, q = start[order], q[order]
        for s, n, r in [x for x in runs if x[1] >= block + low]:  # a shorter period explains these
            keep = (start < s) | (start + block + q > s + n) | (q % r != 0)
            start, q = start[keep], q[keep]
        for period in np.unique(q).tolist():
            mine, i = start[q == period], 0
            while i < len(mine):
                begin = _reach(w, period, int(mine[i]), -1)
                end = _reach(w, period, int(mine[i]) + block, 1)
                length = end + period - begin
                if length >= max(LEAST, TIMES * period) and not inside(begin, end + period, period):
                    runs.append((begin, length, period))
                    by.setdefault(period, []).append((begin, begin + length))
                i = int(np.searchsorted(mine, end))
    return sorted(runs, key=lambda x: (x[0], x[2]))


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word each word becomes, for the documents that get a period; a null doc_id has none."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _first_of_all(runs: list[tuple[int, int, int]]) -> tuple[int, int, int, int] | tuple[None, None, None, None]:
    best = None
    for s, n, p in runs:  # they come by start, then period
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


def _judge(planted: bool, keep_text: bool):
    fields = [("doc_id", pa.int64()), ("n_runs", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")]]
    if keep_text:
        fields += [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]
    else:
        fields += [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    schema = pa.schema(fields)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, words in column_words(batch.column(1)):
                hashes, counts = words.hashes(), words.counts()
                moved = [_planted(d, int(n)) if planted else None for d, n in zip(ids[i:j], counts, strict=True)]
                for at, m in zip(words.first, moved, strict=False):
                    if m is not None:
                        hashes[at : at + len(m)] = hashes[at + m]
                foreseen = _foreseen(hashes, words.docs(), words.first)
                out = []
                for d in range(j - i):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    own = words.data[words.start[a] : words.end[b - 1]].tobytes().split() if b > a else []
                    if moved[d] is not None:
                        own = [own[k] for k in moved[d].tolist()]
                    runs: list[tuple[int, int, int]] = []
                    if d in foreseen:
                        numbers: dict[bytes, int] = {}
                        runs = find_runs(np.array([numbers.setdefault(x, len(numbers)) for x in own]), foreseen[d])
                    if runs:
                        edges = np.zeros(len(own) + 1, np.int64)
                        for s, n, p in runs:
                            edges[s + p] += 1
                            edges[s + n] -= 1
                        own = compress(own, np.cumsum(edges[:-1]) == 0)
                    kept = b" ".join(own)
                    tail = ([{"start": s, "length": n, "period": p} for s, n, p in runs], kept.decode()) if keep_text else (
                        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
                    )
                    out.append((ids[i + d], len(runs), *_first_of_all(runs), *tail))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def periodic_runs(docs: DataFrame, planted: bool = False, keep_text: bool = True) -> DataFrame:
    """All runs of each whole text, and the text without their repetitions.

    docs: doc_id and text; other columns are not read, whatever their names. Returns doc_id, n_runs; start,
    length, period and exponent_milli of the run with the greatest length by period (ties: smallest
    start, then period); and runs with collapsed (kept words joined by one space), or their digests
    runs_sha256 and collapsed_sha256. A word goes if any run has it after the run's first period.
    With ``planted``, documents that a hash of the id chooses first get a period of their own.

    Null and empty texts, and texts without words, have no runs and collapse to ''. Null doc_ids are kept and
    never chosen; repeated rows are judged each by itself. An empty table gives no rows. Memory follows the
    longest text: a few arrays of its words, and an automaton of at most ``AUTOMATON`` words or one block.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tail = "runs array<struct<start: long, length: long, period: long>>, collapsed string" if keep_text else "runs_sha256 string, collapsed_sha256 string"
    return docs.mapInArrow(_judge(planted, keep_text), f"doc_id long, n_runs long, start long, length long, period long, exponent_milli long, {tail}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted=True, keep_text=False)


ORACLE_SQL = None
