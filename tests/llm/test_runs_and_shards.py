"""Periodic runs and sharding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from .conftest import SF, edge_rows, rows

from . import brute
from mnemoflow.llm import op11_periodic_runs, op12_sharding


def plain_runs(w):
    """Every longest stretch of words q apart that are equal, for each q; those that a shorter period explains are left out."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(w[x] == w[x + r] for x in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_periodic(docs, planted=True):
    out = []
    for doc_id, text in docs:
        w = brute.words(text)
        n = len(w)
        h = zlib.crc32(str(doc_id).encode())
        if planted and doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {k for s, length, p in runs for k in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
        top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        out.append((doc_id, len(runs), *top, brute.sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), brute.sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_edge_cases(spark, edge, empty):
    got = rows(op11_periodic_runs.periodic_runs(edge, planted=True, keep_text=False), *COLUMNS)
    assert got == plain_periodic([(r[0], r[1]) for r in edge_rows()])
    assert op11_periodic_runs.periodic_runs(empty).count() == 0


def test_query_of_runs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = sorted(docs, key=lambda d: len(d[1] or ""))
    got = {r[0]: r for r in rows(op11_periodic_runs.query(spark, SF), *COLUMNS)}
    assert len(got) == len(docs)
    want = plain_periodic(docs[:-8])  # the plain version takes too long for the longest ones
    assert [got[r[0]] for r in want] == want and sum(r[1] for r in want) > 5


def words_of(numbers):
    return " ".join(f"w{x}" for x in numbers)


def test_runs_of_constructed_words(spark):
    rng, docs = random.Random(11), []
    for k in range(400):
        n, letters = rng.randint(0, 160), rng.choice([1, 2, 2, 3, 9])
        w = [rng.randrange(letters) for _ in range(n)]
        while rng.random() < 0.7 and n > 10:
            p, s = rng.randint(1, n // 3), rng.randrange(n)
            for i in range(s + p, rng.randint(s, n)):
                w[i] = w[i - p]
        docs.append((k, words_of(w)))
    nested = ([0] * 9 + [1]) * 6
    docs += [(900, words_of([0] * 3000)), (901, words_of([0, 1] * 2000)), (902, words_of(list(range(500)) * 4)), (903, words_of(nested * 5 + [7] + nested * 4)), (904, words_of([*range(30)] * 3 + [*range(29)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    small = [d for d in docs if d[0] < 900 or d[0] > 902]
    got = {r[0]: r for r in rows(op11_periodic_runs.periodic_runs(df, keep_text=False), *COLUMNS)}
    want = plain_periodic(small, planted=False)
    assert [got[r[0]] for r in want] == want and sum(r[1] for r in want) > 300
    assert got[900][1:6] == (1, 0, 3000, 1, 3_000_000) and got[901][1:6] == (1, 0, 4000, 2, 2_000_000) and got[902][1:6] == (1, 0, 2000, 500, 4000) and got[904][1] == 0
    shown = op11_periodic_runs.periodic_runs(df.where("doc_id = 902")).first()
    assert shown["runs"] == [(0, 2000, 500)] and shown["collapsed"] == words_of(range(500))


def test_automata_in_parts(spark, monkeypatch):
    """The same runs where an automaton holds few blocks at a time."""
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(20, 400)
        w = [rng.randrange(2) for _ in range(n)]
        p, s = rng.randint(1, n // 5), rng.randrange(n // 2)
        for i in range(s + p, n):
            w[i] = w[i - p]
        hashes = op11_periodic_runs.mix(np.array(w, np.uint64), 3)
        foreseen = op11_periodic_runs._foreseen(hashes, np.zeros(n, np.int64), np.array([0, n])).get(0, [])
        monkeypatch.setattr(op11_periodic_runs, "AUTOMATON", 8)
        assert op11_periodic_runs.find_runs(np.array(w), foreseen) == plain_runs(w)


# -- sharding ----------------------------------------------------------------------------------------
def plain_differencing(sizes, shards):
    """Spread that differencing reaches, on lists."""
    parts = [sorted([0] * (shards - 1) + [s]) for s in sizes] or [[0] * shards]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(0), parts.pop(0)
        both = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
        parts.append([x - both[0] for x in both])
    return parts[0][-1] - parts[0][0]


@pytest.mark.parametrize("n,shards", [(0, 3), (1, 3), (5, 3), (300, 7), (90, 1), (64, 40)])
def test_differencing(n, shards):
    rng = random.Random(n)
    sizes = np.array(sorted((rng.choice([rng.randint(1, 99), rng.randint(1, 5000)]) for _ in range(n)), reverse=True), np.int64)
    place = op12_sharding.difference(sizes, shards)
    sums = np.bincount(place, sizes, shards)
    assert len(place) == n and place.min(initial=0) >= 0 and place.max(initial=0) < shards
    if n and shards > 1:
        assert np.ptp(sums) <= plain_differencing(sizes.tolist(), shards) + (sizes[-1] if n > shards else 0)


def test_differencing_fills_what_is_there():
    base = np.array([0] * 6 + [5000, 90_000])
    sizes = np.array(sorted(range(1, 900), reverse=True), np.int64)
    sums = np.bincount(op12_sharding.difference(sizes, 8, base), sizes, 8) + base
    assert np.ptp(sums[:7]) <= 5 and sums[7] == 90_000
    level = op12_sharding.fill_level(base, int(sizes.sum()))
    assert abs(level - sums[:7].mean()) < 1


def check_shards(got, docs, shards):
    """got: rows of the operator; docs: (doc_id, text)."""
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    slots, home = defaultdict(list), defaultdict(set)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = {(i, zlib.crc32((t or "").encode()), size(t)): t or "" for i, t in docs}
    for r in got:
        home[of[r["doc_id"], r["text_crc32"], r["size"]]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    return sums


def test_shards_of_edge_cases(spark, mixed_docs, empty):
    docs = [tuple(r) for r in mixed_docs.select("doc_id", "text").collect()]
    check_shards(op12_sharding.shard(mixed_docs, 5).collect(), docs, 5)
    assert op12_sharding.shard(empty).count() == 0


def test_shards_are_level(spark, monkeypatch):
    """Several parts, large groups, one group over the mean, repeated rows in steps; the others are level, and reruns agree."""
    monkeypatch.setattr(op12_sharding, "PART_GROUPS", 200)
    monkeypatch.setattr(op12_sharding, "REPEATS", 16)
    rng = random.Random(4)
    docs = [(k, "x" * rng.randint(1, 900) + str(k)) for k in range(1500)] + [(None, "the same")] * 100 + [(k, "y" * 700) for k in range(2000, 2400)] + [(k, "z" * 4000) for k in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").repartition(5)
    got = op12_sharding.shard(df, 8).collect()
    sums = check_shards(got, docs, 8)
    top, *others = sorted((sums[s] for s in range(8)), reverse=True)
    assert top >= 400 * 716 and max(others) - min(others) <= 0.002 * max(others)
    assert sorted(map(tuple, op12_sharding.shard(df.repartition(3), 8).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_query_of_shards(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(op12_sharding.query(spark, SF).collect(), docs, 40)
