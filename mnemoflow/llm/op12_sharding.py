"""Sharding by Karmarkar-Karp differencing: equal texts stay together, and shards get near equal bytes.

A partial partition has a sum for each shard. Differencing takes the two with the largest spread, adds
one in ascending to the other in descending order, and goes on with the result, until one is left; the
orders of all steps, read backwards, tell the shard of every group.

Groups of at least a ``FINE``-th of a shard, in bytes or rows, are few at any size of the corpus; they
are differenced first. All other groups are dealt by a hash into parts, which tasks difference at the
same time. In each of them the sums that the large groups made, scaled to the part, are one more
partial partition, so that every part fills the gaps of the large groups by its share.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import mark, materialize, release

SHARDS, ROW_BYTES = 40, 16
#: A group of a FINE-th of a mean shard is large: at most 2 * FINE * shards groups are. Groups that a task differences; rows of a slot range; rows that one step repeats.
FINE, PART_GROUPS, RANGE_ROWS, RANGES, REPEATS = 64, 32_768, 100_000, 64, 65_536


def difference(sizes: np.ndarray, shards: int, base: np.ndarray | None = None) -> np.ndarray:
    """The shard of each size, by differencing; base has sums that the shards begin with."""
    n = len(sizes)
    if shards == 1 or not n:
        return np.zeros(n, np.int64)
    zero = np.zeros(shards, np.int64)
    own = np.argsort(zero if base is None else base, kind="stable")
    start = zero if base is None else base[own] - base[own[0]]
    live = {n: start}
    heap = [(-int(s), i) for i, s in enumerate(sizes)] + [(-int(start[-1]), n)]
    heapq.heapify(heap)
    steps: list[tuple[int, int, np.ndarray]] = []

    def sums(i: int) -> np.ndarray:
        if i in live:
            return live.pop(i)
        out = zero.copy()
        out[-1] = sizes[i]
        return out

    small = np.uint8 if shards <= 256 else np.int64
    for node in range(n + 1, 2 * n + 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums(a) + sums(b)[::-1]
        order = both.argsort(kind="stable")
        live[node] = both = both[order] - both[order[0]]
        steps.append((a, b, order.astype(small)))
        heapq.heappush(heap, (-int(both[-1]), node))
    # Backwards: what the slots of a node are called, from the last one to the groups.
    called, out = {2 * n: np.arange(shards)}, np.zeros(n, np.int64)
    names = called[2 * n]
    for node in range(2 * n, n, -1):
        (a, b, order), mine = steps[node - n - 1], called.pop(node)
        up = np.empty(shards, np.int64)
        up[order] = mine
        for child, labels in ((a, up), (b, up[::-1])):
            if child < n:
                out[child] = labels[-1]
            elif child == n:
                names = labels
            else:
                called[child] = labels
    shard = np.empty(shards, np.int64)
    shard[names] = own
    return shard[out]


def fill_level(sums: np.ndarray, rest: int) -> float:
    """The level up to which ``rest`` fills the sums."""
    low = np.sort(sums).astype(float)
    levels = (rest + np.cumsum(low)) / np.arange(1, len(low) + 1)
    fits = np.append(low[1:], np.inf) >= levels
    return float(levels[np.argmax(fits)])


def _difference_part(shards: int, filled: np.ndarray, rest: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("key", "ascending")])
        sizes = table["bytes"].to_numpy()
        base = np.floor(filled * (float(sizes.sum()) / max(1, rest))).astype(np.int64)
        return pa.table({"key": table["key"], "shard": pa.array(difference(sizes, shards, base), pa.int32())})

    return run


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Puts every document into one of ``shards`` shards, equal texts into the same.

    docs: doc_id and text; other columns are not read, whatever their names. Returns doc_id, size
    (UTF-8 bytes and 16), text_crc32, law ('bytes'), shard, slot (from 0 without gaps in each shard) and
    grown_shard (null: this law says nothing of one more shard).

    Sizes of shards are near equal; a group of equal texts that is larger than a shard's mean keeps one
    for itself as far as possible. A null text has no bytes and counts as equal to an empty one. Very
    long texts are one row of a few bytes here like others. Null and repeated doc_ids, and repeated rows,
    are documents of their own, each with its slot; which of some equal rows has which slot is no
    difference. Ties are settled by the hash of the text. An empty table gives no rows.
    """
    spark, began = docs.sparkSession, mark()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = materialize(one.groupBy("doc_id", "key", "size", "text_crc32").agg(F.count("*").alias("n")), "rows")
    groups = materialize(rows.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("copies")), "groups")
    total, n_rows, n_groups = (x or 0 for x in groups.agg(F.sum("bytes"), F.sum("copies"), F.count("*")).first())
    big = (F.col("bytes") * (FINE * shards) >= total) | (F.col("copies") * (FINE * shards) >= n_rows)
    large = sorted(((r["bytes"], bytes(r["key"])) for r in groups.where(big).select("bytes", "key").collect()), reverse=True)  # 2 * FINE * shards at most
    sizes = np.array([b for b, _ in large], np.int64)
    place = difference(sizes, shards)
    sums = np.bincount(place, sizes, shards).astype(np.int64)
    rest = total - int(sizes.sum())
    filled = np.minimum(sums, fill_level(sums, rest))
    parts = max(1, math.ceil(n_groups / PART_GROUPS))
    small = groups.where(~big).select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"))
    placed = small.groupBy("part").applyInArrow(_difference_part(shards, filled, rest), "key binary, shard int")
    first = F.broadcast(spark.createDataFrame([(bytearray(k), int(s)) for (_, k), s in zip(large, place, strict=True)], "key binary, shard int"))
    # Rows of large groups never meet in a join by key.
    found = rows.join(first, "key").unionByName(rows.join(first.select("key"), "key", "left_anti").join(placed, "key"))
    ranges = max(RANGES, math.ceil(n_rows / RANGE_ROWS))
    found = materialize(found.withColumn("range", F.pmod(F.xxhash64("doc_id", "key"), F.lit(ranges)).cast("int")), "shards")
    release(spark, began, keep=("shards",))
    counts = found.groupBy("shard", "range").agg(F.sum("n").alias("own"))
    before = counts.select("shard", "range", (F.sum("own").over(Window.partitionBy("shard").orderBy("range")) - F.col("own")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("shard", "range").orderBy("doc_id", "key")) - F.col("n")
    slots = found.withColumn("inside", inside).join(before, ["shard", "range"])
    # Repeated rows come out in steps, so that no array is as long as there are repeats.
    steps = slots.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS)))).withColumn("done", F.col("step") * REPEATS)
    last = F.least(F.col("n") - F.col("done"), F.lit(REPEATS)) - 1
    each = steps.withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    slot = F.col("before") + F.col("inside") + F.col("done") + F.col("again")
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = None
