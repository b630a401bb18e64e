"""MinHash near-dedup with an LSH forest.

Each document becomes a set of word shingles and a MinHash signature. Documents with the same set
collapse into one class before anything else. Every tree of the forest is a sorted order of the
classes by its own part of the signature: rows are range-partitioned and sorted by (prefix, rest), so
classes with a long common prefix are neighbours and a crowded prefix spreads over many tasks. In a
region of equal prefix all pairs are candidates while it is small; a larger region joins its
neighbours in order and its most central member (in some trees its first one too) to all others, and
splits by the next signature values, a depth of its own, down to small regions. So candidates grow
with the rows and not with the square of a group.

Candidates are confirmed on the full sets in rounds: first the stars of some trees, which already
connect nearly every group; then all candidates that are still in different components; at last, for
each crowded region, the classes that are not in its largest component against all its members, in
blocks of bounded rows and bytes inside a task that give back confirmed links alone. Confirmed links
give connected components by label propagation; each later round works on the components of the one
before, so only the first meets all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import mark, materialize, release, small_batches
from mnemoflow.llm.textkit import Words, buffers, column_words, mix, rolling, slices, tidied, words

#: Outsiders and members of a crowded region in a block, and bytes of their texts; every block of outsiders meets every block of members.
CROWD, CROWD_BYTES = 4096, 8 << 20
#: Trees; signature values of a prefix at least and of a tree; trees whose stars are confirmed first; classes whose pairs are all candidates.
TREES, LEAST_DEPTH, DEPTH, STARS, REGION = 16, 3, 7, 4, 8
_RNG = np.random.default_rng(5)
_MUL = _RNG.integers(1, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def _sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), sorted and distinct; documents of fewer words have their whole sequence as one shingle."""
    h = w.hashes(lower=True)
    win, at = rolling(h, w.first, width)
    row = np.searchsorted(w.first, at, "right") - 1
    n = w.counts()
    parts = [(row, win)]
    for size in range(1, width):
        own = np.flatnonzero(n == size)
        acc = np.full(len(own), size, np.uint64)
        for j in range(size):
            acc = mix(acc * np.uint64(0xD1342543DE82EF95) + h[w.first[own] + j], 3)
        parts.append((own, acc))
    row, win = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(win)
    order = order[np.argsort(row[order].astype(np.uint16) if len(w.first) < 65536 else row[order], kind="stable")]
    row, win = row[order], win[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (win[1:] != win[:-1])
    return row[new], win[new]


def _class_ids(row: np.ndarray, win: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes; first shingle of each document that has any; a 64-bit name of the set."""
    n = np.bincount(row, minlength=docs)
    first = (np.cumsum(n) - n)[n > 0]
    cid = np.zeros(docs, np.uint64)
    if len(first):
        cid[n > 0] = mix(np.add.reduceat(mix(win, 1), first) ^ mix(np.add.reduceat(mix(win, 2), first), 3) + n[n > 0].astype(np.uint64), 4)
    return n, first, cid.view(np.int64)


def _packed(rows: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as binaries; null where there is none."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.dtype.itemsize
    valid = None if there is None else pa.py_buffer(np.packbits(there, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(rows), [valid, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows.view(np.uint8))])


def _unpacked(column: pa.Array) -> np.ndarray:
    """Signatures (or parts of them) as a matrix."""
    data, offsets = buffers(column)
    return data.view(">u2").reshape(len(offsets) - 1, -1)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in column_words(batch.column(3)):
                row, win = _sets(w, width)
                n, first, cid = _class_ids(row, win, j - i)
                sig, full = np.zeros((j - i, TREES * DEPTH), ">u2"), n > 0
                if len(first):
                    short = (win >> np.uint64(32)).astype(np.uint32)
                    buffer = np.empty_like(short)
                    for p in range(TREES * DEPTH):
                        np.bitwise_xor(short, _XOR[p], out=buffer)
                        np.multiply(buffer, _MUL[p], out=buffer)
                        sig[full, p] = (np.minimum.reduceat(buffer, first) * np.uint32(2654435761)) >> np.uint32(16)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(n, pa.int64()), pa.array(cid, pa.int64(), mask=~full), _packed(sig, full)], ["doc_id", "row", "bytes", "n", "cid", "sig"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rest, cid, n) of each class in each tree; the key's low bits are the tree."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            sig = _unpacked(part.column(2))
            for t in range(TREES):
                own = sig[:, t * DEPTH : (t + 1) * DEPTH].astype(np.uint64)
                key = np.zeros(len(own), np.uint64)
                for d in range(LEAST_DEPTH):
                    key = key << np.uint64(16) | own[:, d]
                key = mix(key, 7 + t) & ~np.uint64(TREES - 1) | np.uint64(t)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), _packed(sig[:, t * DEPTH + LEAST_DEPTH : (t + 1) * DEPTH]), part.column(0), part.column(1)], ["key", "rest", "cid", "n"])


def _region(rest: np.ndarray, cid: np.ndarray, lo: int, hi: int, depth: int, out: list[np.ndarray]) -> None:
    """Candidate pairs (indices) of the sorted rows lo to hi, which agree on all values before ``depth``."""
    m = hi - lo
    if m <= REGION:
        i, j = np.triu_indices(m, 1)
        out.append(np.stack([i + lo, j + lo]))
        return
    if depth == 0:
        at = np.arange(lo, hi)
        for step in (1, 2):
            out.append(np.stack([at[:-step], at[step:]]))
        agree = np.zeros(m, np.int64)
        for d in range(rest.shape[1]):
            _, inverse, count = np.unique(rest[lo:hi, d], return_inverse=True, return_counts=True)
            agree += inverse == np.argmax(count)
        lead = int(np.lexsort((cid[lo:hi], -agree))[0])
        out.append(np.stack([np.full(m - 1, lo + lead), np.delete(at, lead)]))
    if depth < rest.shape[1]:
        cuts = np.flatnonzero(np.diff(rest[lo:hi, depth])) + 1
        edges = [lo, *(cuts + lo), hi]
        if len(edges) > 2 or depth + 1 < rest.shape[1]:
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    _region(rest, cid, a, b, depth + 1, out)


def _pairs(key: int, rest: list[bytes], cid: np.ndarray, n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a < b) of one region and whether each is in its star; sizes that exclude the similarity are left out."""
    values = np.frombuffer(b"".join(rest), ">u2").reshape(len(rest), -1)
    found: list[np.ndarray] = []
    _region(values, cid, 0, len(cid), 0, found)
    star = int(np.argmin(cid))
    if key & (TREES - 1) < STARS:
        found.append(np.stack([np.full(len(cid), star), np.arange(len(cid))]))
    pairs = np.concatenate(found, axis=1)
    i, j = np.divmod(np.unique(pairs.min(0) * len(cid) + pairs.max(0)), len(cid))
    fine = (cid[i] != cid[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]))
    i, j = i[fine], j[fine]
    a, b = np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])
    return a, b, ((i == star) | (j == star)) & (key & (TREES - 1) < STARS)


def _settle(width: int, least_percent: int):
    """Confirmed links of a crowd's outsiders with a part of its members, as many as connect them; full sets are compared inside the task, and no pair leaves it unconfirmed."""

    def read(table: pa.Table) -> list:
        """cid, label, sizes, and the sorted distinct (row, shingle) of the rows whose text is of their class."""
        row, win, at = [], [], 0
        n, cid = [], []
        for i, j, w in column_words(table["text"]):
            r, h = _sets(w, width)
            sizes, _, names = _class_ids(r, h, j - i)
            row.append(r + i), win.append(h), n.append(sizes), cid.append(names)
            at = j
        row, win, n, cid = (np.concatenate(x) if at else np.zeros(0, np.int64) for x in (row, win, n, cid))
        own = table["cid"].to_numpy()
        n = np.where(cid == own, n, 0) if at else n
        return [own, table["label"].to_numpy().copy(), n, row, win.astype(np.uint64)]

    def run(outsiders: pa.Table, members: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if len(outsiders) and len(members):
            (cu, lu, nu, row_u, win_u), (cm, lm, nm, row_m, win_m) = read(outsiders), read(members)
            order = np.argsort(win_m, kind="stable")
            posts, who = win_m[order], row_m[order]
            first = np.searchsorted(row_u, np.arange(len(cu) + 1))
            for k in range(len(cu)):
                fine = (lm != lu[k]) & (100 * np.minimum(nm, nu[k]) >= least_percent * np.maximum(nm, nu[k])) & (nm > 0)
                near = np.flatnonzero(fine)
                if not len(near):
                    continue
                own = win_u[first[k] : first[k + 1]]
                lo, hi = np.searchsorted(posts, own, "left"), np.searchsorted(posts, own, "right")
                found = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
                both = np.bincount(who[found], minlength=len(cm))[near]
                for m in near[100 * both >= least_percent * (nm[near] + nu[k] - both)]:
                    if lm[m] != lu[k]:
                        links.append((int(cu[k]), int(cm[m])))
                        old, new = lu[k], lm[m]
                        lu[lu == old] = new
                        lm[lm == old] = new
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def _walk(least: float):
    """Regions of a sorted partition. What touches the partition's ends may go on in another one: up to 2 * REGION rows there are passed on (star is null) to be joined by key. Rows of crowded regions are passed on with their key as the name of the crowd, the same in all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "star", "key", "rest", "n", "crowd"]
        held: list[pa.RecordBatch] = []
        begun = False

        def region(key: np.ndarray, table: pa.Table, cut: np.ndarray, edge: tuple[bool, bool]) -> Iterator[pa.RecordBatch]:
            rest, cid, n = table["rest"].to_pylist(), table["cid"].to_numpy(), table["n"].to_numpy()
            out, last = [], len(cut) - 2
            for k in range(len(cut) - 1):
                i, j = cut[k], cut[k + 1]
                if j - i > 1:
                    out.append(_pairs(int(key[i]), rest[i:j], cid[i:j], n[i:j], least))
                rows = {*range(i, min(j, i + REGION))} if k == 0 and edge[0] else set()
                rows |= {*range(max(i, j - REGION), j)} if k == last and edge[1] else set()
                if rows:
                    rows = sorted(rows)
                    nulls = pa.nulls(len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(cid[rows]), nulls, pa.nulls(len(rows), pa.bool_()), pa.array(key[rows]), pa.array([rest[x] for x in rows], pa.binary()), pa.array(n[rows]), nulls], names)
                if rows or j - i > REGION:
                    nulls = pa.nulls(j - i, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(cid[i:j]), nulls, pa.nulls(j - i, pa.bool_()), nulls, pa.nulls(j - i, pa.binary()), nulls, pa.array(key[i:j])], names)
            if out:
                a, b, star = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(star), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names)

        def take(table: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, begun
            key = table["key"].to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            if not final:
                held = table.slice(cut[-2]).combine_chunks().to_batches()
                cut = cut[:-1]
            if len(cut) > 1:
                yield from region(key, table, cut, (not begun, final))
                begun = True

        for batch in batches:
            held.append(batch)
            if len(held) > 1 and held[0].column(0)[0] == batch.column(0)[batch.num_rows - 1]:
                continue
            yield from take(pa.Table.from_batches(held), False)
        if held:
            yield from take(pa.Table.from_batches(held), True)

    return run


def _seam(least: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.group_by(["rest", "cid", "n"]).aggregate([]).sort_by([("rest", "ascending"), ("cid", "ascending")])
        a, b, star = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) if len(table) < 2 else _pairs(key[0].as_py(), table["rest"].to_pylist(), table["cid"].to_numpy(), table["n"].to_numpy(), least)
        return pa.table({"a": a, "b": b, "star": star})

    return run


def _confirm(width: int, least_percent: int):
    """Rows (a, b, text_a, text_b) whose sets are as similar as asked for; a text that is not of its class (a repeated doc_id) confirms nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = buffers(batch.column(2)), buffers(batch.column(3))
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(oa + ob):
                sets = [_sets(words(d[o[i] : o[j]], o[i : j + 1] - o[i]), width) for d, o in ((da, oa), (db, ob))]
                (na, _, ca), (nb, _, cb) = (_class_ids(*x, j - i) for x in sets)
                row, win = (np.concatenate(x) for x in zip(*sets, strict=True))
                order = np.argsort(win)
                order = order[np.argsort(row[order], kind="stable")]
                row, win = row[order], win[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (win[1:] == win[:-1])], minlength=j - i)
                fine = (100 * both >= least_percent * (na + nb - both)) & (ca == a[i:j]) & (cb == b[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(a[i:j][fine]), pa.array(b[i:j][fine])], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) reaches, by minimum labels and pointer jumping.

    Labels are unique by node, so in every join the side that a popular node or label repeats on can be
    split by the skew handling of adaptive execution.
    """
    links = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), "label")
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        new = materialize(new.join(jump, "new").select("node", F.least("new", "far").alias("label"), F.col("label").alias("old")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds a_label and b_label to pairs (a, b); a node without a label is its own."""
    for x in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")), x, "left").withColumn(f"{x}_label", F.coalesce(f"{x}_label", x))
    return pairs


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of the links so far and of some more, worked out on the components alone."""
    links = _named(links, labels).where("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()
    links = materialize(links, "contracted")
    if links.isEmpty():
        return labels
    new = components(links)
    moved = new.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(old.union(new.join(labels, "node", "left_anti").select("node", "label")), "labels")


def near_dedup(docs: DataFrame, width: int = 5, least_percent: int = 80) -> DataFrame:
    """Groups documents whose sets of ``width``-word shingles have a Jaccard similarity of ``least_percent`` percent or more.

    docs: doc_id (long) and text; other columns are not read. Words are compared with A-Z lower-cased.
    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself
    included) and kept (doc_id = component_id), one row for each row.

    A document with fewer words is one shingle. Null and empty texts and texts without words have no
    shingles, are linked with nothing and kept. Equal sets are linked, so repeated rows share a
    component; rows that repeat the smallest doc_id are all kept. Rows with a null doc_id take part; a
    component of such rows alone has a null component_id and is kept. An empty table gives no rows.
    Shingles and classes are told apart by 64-bit hashes of their words.
    """
    spark, began = docs.sparkSession, mark()
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    signed = materialize(docs.mapInArrow(tidied(_sign(width)), "doc_id long, row long, bytes long, n long, cid long, sig binary"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "bytes")).alias("rep")
    classes = materialize(signed.where("n > 0").groupBy("cid").agg(first, F.first("n").alias("n"), F.first("sig").alias("sig")).select("cid", "n", "sig", "rep.doc_id", "rep.row", "rep.bytes"), "classes")
    forest = classes.select("cid", "n", "sig").mapInArrow(tidied(_forest), "key long, rest binary, cid long, n long")
    forest = forest.repartitionByRange("key", "rest", "cid").sortWithinPartitions("key", "rest", "cid")
    walked = materialize(forest.mapInArrow(tidied(_walk(least_percent / 100)), "a long, b long, star boolean, key long, rest binary, n long, crowd long"), "walked")
    seams = walked.where("star IS NULL AND crowd IS NULL").select("key", "rest", F.col("a").alias("cid"), "n").groupBy("key").applyInArrow(_seam(least_percent / 100), "a long, b long, star boolean")
    pairs = walked.where("star IS NOT NULL").select("a", "b", "star").union(seams)
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")

    # The text of each class that is in a pair or a crowd, once: that of its first row, whose hash is unique but for repeated rows.
    named = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).union(walked.where("crowd IS NOT NULL").select(F.col("a").alias("cid")))
    named = materialize(named.distinct().join(classes.select("cid", "row"), "cid"), "named")
    texts = materialize(docs.select("row", "text").join(named.hint("merge"), "row").dropDuplicates(["row", "cid"]).select("cid", "text"), "texts")

    def confirmed(some: DataFrame) -> DataFrame:
        two = some.hint("merge").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        two = two.hint("merge").join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
        return materialize(two.select("a", "b", "text_a", "text_b").mapInArrow(tidied(_confirm(width, least_percent)), "a long, b long"), "confirmed")

    labels = components(confirmed(pairs.where("star").select("a", "b")))
    others = _named(pairs.where("NOT star").select("a", "b"), labels).where("a_label <> b_label").select("a", "b")
    labels = extended(labels, confirmed(others))

    crowds = walked.where("crowd IS NOT NULL").select(F.col("crowd").alias("key"), F.col("a").alias("cid")).distinct()
    crowds = crowds.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    crowds = materialize(crowds.join(classes.select("cid", "bytes"), "cid"), "crowds")
    sizes = crowds.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = sizes.groupBy("key").agg(F.max_by(F.struct("label", "n", "bytes"), F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(n / CROWD), F.ceil(size / CROWD_BYTES), F.lit(1)).cast("int")
    split = sizes.where("main.n < n").select("key", F.col("main.label").alias("main"), blocks(F.col("n"), F.col("bytes")).alias("parts"), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("blocks"))
    dealt = lambda to: F.pmod(F.xxhash64("cid"), F.col(to)).cast("int")
    every = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    rest = materialize(crowds.join(materialize(split, "split"), "key").drop("bytes").hint("merge").join(texts, "cid"), "unsettled")
    members = rest.select("key", dealt("parts").alias("part"), every("blocks").alias("block"), "cid", "label", "text")
    outsiders = rest.where("label <> main").select("key", every("parts").alias("part"), dealt("blocks").alias("block"), "cid", "label", "text")
    outsiders, members = outsiders.toDF(*outsiders.columns), members.toDF(*members.columns)
    settled = outsiders.groupBy("key", "part", "block").cogroup(members.groupBy("key", "part", "block")).applyInArrow(_settle(width, least_percent), "a long, b long")
    labels = extended(labels, materialize(settled, "settled"))

    known = classes.select("cid", "doc_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    first = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = materialize(known.join(first, "label").select("cid", "component_id"), "components")
    release(spark, began, keep=("signed", "components"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(known, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), c AS (
  SELECT doc_id, len(s) AS n, s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM s
), u AS (
  SELECT doc_id, n, unnest(s) AS x FROM c WHERE doc_id = rep
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), e AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM c WHERE doc_id = rep UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), k AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id, CASE WHEN n = 0 THEN true ELSE doc_id = component_id END AS kept
FROM c JOIN k ON k.x = c.rep
"""
