"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words. Whole passes over the source are taken as often as they
fit; what is left of the target is filled exactly if it can be: documents are counted by exact
length, an even share of every length is taken, and a bounded-knapsack dynamic programme over the
lengths that are left chooses how many documents of each to add for the remaining budget. Which
documents of a length are taken is settled by a seeded hash, so reruns agree.

Only counts by length are gathered, one source in a task. Documents are ranked inside (source,
length, slice of the hash of id and text), so that a length which a third of all documents share is
spread out. Sources are ranked in ranges, so no task has all of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import carried, carry, mark, materialize, release

#: Words at most that the dynamic programme fills, or twice the longest length; slices of the hash.
DP_WORDS, SLICES = 1 << 16, 64
WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2


def n_words(text: Column) -> Column:
    """Words of a text: places where a separator, or the beginning, is followed by a word."""
    blank = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " ", -1), lambda x: x != "")).cast("long")


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near to the budget, from below, as the method can.

    An even share of each length comes first, rounded down. Where that leaves over DP_WORDS, shares are
    rounded by one running remainder over the sorted lengths instead, which begins anywhere; so their
    words are off by the longest length at most, and as much is reserved. A bounded knapsack (lengths split into powers of two, reachable sums as bits of an
    integer) fills the rest: its best sum is reached exactly.
    """
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if total <= budget:
        return list(counts)
    order = sorted((k for k in range(len(lengths)) if lengths[k]), key=lambda k: -lengths[k])
    taken = [b * budget // total if a else 0 for a, b in zip(lengths, counts, strict=True)]
    rest = budget - sum(a * b for a, b in zip(lengths, taken, strict=True))
    if rest > DP_WORDS:
        share, run = max(0, budget - max(lengths[order[0]], DP_WORDS // 2)), (total * 2654435761 % (1 << 32)) * total >> 32
        for k in order:
            taken[k], run = divmod(run + counts[k] * share, total)
        rest = budget - sum(a * b for a, b in zip(lengths, taken, strict=True))
    bits, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for k in order:
        free, power = min(counts[k] - taken[k], rest // lengths[k]), 1
        while free > 0 and not bits >> rest & 1:
            m = min(power, free)
            steps.append((k, m, bits))
            bits |= bits << (m * lengths[k]) & mask
            free, power = free - m, 2 * power
    left = bits.bit_length() - 1
    for k, m, before in reversed(steps):
        if not before >> left & 1:
            taken[k] += m
            left -= m * lengths[k]
    return taken


def targets(sources: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """Adds target to (source, source_size): shares by weight, none above ``most`` times its size, the excess reshared until none is.

    The rounds run over the table of sources, one small aggregate each; at most as many rounds as
    there are sources, and few in practice.
    """
    order = [F.col("source").isNull(), F.col("source")]
    place = F.monotonically_increasing_id()  # the partition's number in the upper bits, the row's in the lower 33
    placed = materialize(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place), "ranges")
    part, row = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, parts = 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count("*")).collect()):  # a row for each partition
        parts.append((p, before))
        before += n
    starts = sources.sparkSession.createDataFrame(parts, "part long, before long")
    rank = F.col("before") + row
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sources = materialize(placed.withColumn("part", part).join(F.broadcast(starts), "part").select("source", "source_size", weight.alias("weight")), "sources")
    limit = most * F.col("source_size")
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        fixed, free = sources.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (budget * whole - fixed) / free if free else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level)))


def _choose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    target = table["rest"][0].as_py()
    taken = fit(table["size"].to_pylist(), table["n"].to_pylist(), max(0, round(target)))
    return pa.table({"source": table["source"], "size": table["size"], "extra": pa.array(taken, pa.int64())})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = 17, keep: tuple[str, ...] = (), keep_source: bool = False) -> DataFrame:
    """How often the mix takes each document.

    docs: doc_id, text, source. Returns doc_id, size (words), source_size, target (of its source),
    taken (words, repeats counted), times (0 to ``most``), with ``keep_source`` the source, and the
    columns named in ``keep``, whatever their names (one named like a column of the result comes as
    ``name_in``). Sources are ordered by code point, null last, and weighed by ``weights``, repeating;
    they share ``budget`` times all words.

    A null text has size 0 and is never taken; a null source is a source. Repeated rows and null ids
    count as documents of their own. An empty table gives no rows. The order of ties (equal id and text)
    does not change the result's rows.
    """
    spark, began = docs.sparkSession, mark()
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), h.alias("h"), *carry(keep))
    docs = docs.withColumn("slice", F.pmod("h", F.lit(SLICES)))
    small = ["source", "size", "slice"]
    counts = materialize(docs.groupBy(*small).agg(F.count("*").alias("n")), "lengths")
    sources = targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, budget, most)
    size = F.col("source_size")
    passes = F.when(size > 0, F.least(F.lit(most), F.floor(F.col("target") / size))).otherwise(0).cast("long")
    sources = materialize(sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * size), "targets")
    same = lambda a, b: a.eqNullSafe(b)
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    s = sources.select(F.col("source").alias("s_source"), "source_size", "target", "passes", "rest")
    chosen = lengths.join(s, same(F.col("source"), F.col("s_source"))).groupBy("source").applyInArrow(_choose, "source string, size long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = chosen.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "extra")
    first = counts.withColumn("before", before).join(c, same(F.col("source"), F.col("c_source")) & (F.col("size") == F.col("c_size")))
    first = materialize(first.join(s, same(F.col("source"), F.col("s_source"))).select("source", "size", "slice", "n", (F.col("extra") - F.col("before")).alias("left"), "source_size", "target", "passes"), "choices")
    release(spark, began, keep=("choices",))
    f = first.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), F.col("slice").alias("f_slice"), "left", "source_size", "target", "passes")
    docs = docs.join(f, same(F.col("source"), F.col("f_source")) & (F.col("size") == F.col("f_size")) & (F.col("slice") == F.col("f_slice")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("h", "doc_id"))
    times = F.col("passes") + (F.col("left") >= rank).cast("long")
    docs = docs.withColumn("times", F.when(F.col("size") > 0, times).otherwise(F.lit(0).cast("long")))
    own = ["doc_id", "size", "source_size", "target", "taken", "times", *(["source"] if keep_source else [])]
    return docs.withColumn("taken", F.col("size") * F.col("times")).select(*own, *carried(keep, own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = None
