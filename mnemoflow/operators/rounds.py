"""Decisions of a strictly sequential writer, taken in rounds.

Rows of the batch with equal vectors are a class. A row reads the classes that are similar to its own, the
nearest first, until it meets one that holds kept rows; it can do so as soon as no undecided earlier row could still
change what it reads. Rows are cut into blocks of consecutive turns with a bounded number of links;
in each round all blocks decide what they can, each in its own task, from the kept rows as they were before the
round. A class is only read, and so only changed, by the earliest block with undecided rows near it; so
no two tasks change one class in a round, and after round k at least the first k blocks are done.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemoflow.functions import vocab
from mnemoflow.sources.workspace import arrow_rows, fresh_folder

#: Links (and rows) of a block, one row's more at most.
LINKS = 500_000
#: Rows (a vector, or a link with its kept rows) that go to a worker at once.
ROWS = 2000


def in_turns(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """rows (ordinal, node, c, ...) with turn (a number in order of ordinal and node) and block, and the number of blocks.

    A block has at most ``LINKS`` links and rows, and those of one row more. Running sums are taken within the
    partitions of a sort; the driver sees one sum for each of these.
    """
    weight = links.groupBy("c").agg((F.count("*") + 1).alias("weight"))
    turned = rows.join(weight, "c").repartitionByRange("ordinal", "node").sortWithinPartitions("ordinal", "node")
    turned = turned.withColumn("turn", F.monotonically_increasing_id()).withColumn("part", F.shiftright("turn", 33)).checkpoint()
    before, offsets = 0, []
    for part, weight in sorted(tuple(r) for r in turned.groupBy("part").agg(F.sum("weight")).collect()):
        offsets.append((part, before))
        before += weight
    if before <= LINKS:
        return turned.withColumn("block", F.lit(0).cast("long")).drop("weight", "part"), 1
    offset = rows.sparkSession.createDataFrame(offsets, "part long, offset long")
    running = F.sum("weight").over(Window.partitionBy("part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    at = F.floor((F.coalesce(running, F.lit(0)) + F.col("offset")) / LINKS).cast("long")
    return turned.join(F.broadcast(offset), "part").withColumn("block", at).drop("weight", "part", "offset").checkpoint(), before // LINKS + 1


def settle(rows: pa.Table, near: pa.Table, merge_at: float, skip_at: float, schema: pa.Schema) -> pa.Table:
    """What one block can decide: rows of decisions (x null), and all kept rows of each class that changed (slot null: none left).

    Links are numbers in arrays, the nearest of each class first; only classes are Python objects, one for each.
    """
    level = lambda s: vocab.SOURCE_LEVELS.get(s or "unknown", "full")
    coded = pa.chunked_array([*near["own"].chunks, *near["x"].chunks, *rows["c"].chunks], pa.string()).combine_chunks().dictionary_encode()
    own, x, c = np.split(coded.indices.to_numpy(), [len(near), 2 * len(near)])
    far, sim = near["far"].to_numpy(), near["sim"].to_numpy()
    seen, first = np.unique(x, return_index=True)
    shut = np.array(near["shut"].take(pa.array(first)).to_numpy(), bool)
    closed = set(seen[shut].tolist())
    slots = near["slots"].take(pa.array(first)).combine_chunks()
    size, each = pc.fill_null(pc.list_value_length(slots), 0).to_pylist(), slots.flatten()
    each = zip(each.field("slot").to_pylist(), map(sys.intern, pc.fill_null(each.field("source"), "unknown").to_pylist()), each.field("confidence").to_pylist(), strict=True)
    kept: dict[int, list[tuple]] = {x: list(islice(each, n)) for x, n in zip(seen.tolist(), size, strict=True)}
    order = np.lexsort((far, own))
    x, far, sim, start = x[order], far[order], sim[order], np.searchsorted(own[order], np.arange(len(coded.dictionary) + 1))
    turns = pc.sort_indices(rows["turn"])
    decided, changed = [], set()
    for turn, id_, c, source, confidence in zip(*(rows[n].take(turns).to_pylist() for n in ("turn", "id")), c[turns.to_numpy()].tolist(), *(rows[n].take(turns).to_pylist() for n in ("source", "confidence")), strict=True):
        at, end = int(start[c]), int(start[c + 1])
        xs, fars, met, waits, i = x[at:end].tolist(), far[at:end].tolist(), None, False, 0
        while i < len(xs) and not met:
            j = bisect_right(fars, fars[i])  # those at the same distance
            if any(x in closed for x in xs[i:j]):
                waits = True
                break
            met = min(((slot, xs[k], float(sim[at + k]), s, conf) for k in range(i, j) for slot, s, conf in kept[xs[k]]), default=None, key=lambda m: m[0])
            i = j
        if waits:
            closed.update(xs)
            continue
        verdict = "insert"
        if met and met[2] >= merge_at:
            blocked = level(source) == "summary" and level(met[3]) == "full"
            verdict = "merge" if not blocked and confidence >= met[4] else "skip"
        elif met and met[2] >= skip_at:
            verdict = "skip"
        known = met is not None and met[2] >= skip_at
        decided.append((turn, id_, verdict, met[0] if known else None, met[2] if known else None, None, None, None, None))
        if verdict == "merge":
            kept[met[1]] = [k for k in kept[met[1]] if k[0] != met[0]]
            changed.add(met[1])
        if verdict != "skip":
            kept[c] = [*kept[c], (id_ if verdict == "insert" else met[0], source, confidence)]
            changed.add(c)
    left = [(None,) * 5 + (coded.dictionary[x].as_py(), *k) for x in sorted(changed) for k in kept[x] or [(None, None, None)]]
    columns = zip(*decided, *left, strict=True) if decided or left else [[] for _ in schema]
    return pa.table([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def decide(rows: DataFrame, links: DataFrame, index: DataFrame, merge_at: float, skip_at: float) -> DataFrame:
    """(id, decision, existing_id, similarity) of rows (node, id, ordinal, c, source, confidence), c being their class.

    links: (c, x, far, sim) of each class with itself and all that are similar: classes, or nodes of the
    index; far orders them. index: (x, slot, source, confidence) of those nodes. The rounds are as many as a dependency
    has blocks in a row, never more than there are blocks.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    left, blocks = in_turns(rows, links)
    left = left.select("turn", "id", "c", "source", "confidence", "block")
    state = index.select("x", "slot", "source", "confidence")
    schema = f"turn long, id {kind}, decision string, existing_id {kind}, similarity double, x string, slot {kind}, source string, confidence double"
    own = to_arrow_type(rows.schema["id"].dataType)
    arrow = pa.schema([("turn", pa.int64()), ("id", own), ("decision", pa.string()), ("existing_id", own), ("similarity", pa.float64()), ("x", pa.string()), ("slot", own), ("source", pa.string()), ("confidence", pa.float64())])
    folder, written = fresh_folder(spark, "rounds"), []
    for k in range(blocks):
        if k and left.isEmpty():
            break
        first = left.groupBy("c").agg(F.min("block").alias("block")).join(links, "c").groupBy("x").agg(F.min("block").alias("first"))
        slots = state.groupBy("x").agg(F.collect_list(F.struct("slot", "source", "confidence")).alias("slots"))
        known = first.join(slots, "x", "left")
        near = left.select("block", "c").distinct().join(links, "c").join(known, "x")
        near = near.select(F.col("block").alias("at"), F.col("c").alias("own"), "x", "far", "sim", (F.col("first") < F.col("block")).alias("shut"), "slots")
        out = left.groupBy("block").cogroup(near.groupBy("at")).applyInArrow(lambda a, b: settle(a, b, merge_at, skip_at, arrow), schema)
        written.append(f"{folder}/{k}")
        with arrow_rows(spark, ROWS):
            out.write.parquet(written[-1])
        if k + 1 < blocks:
            done = spark.read.schema(schema).parquet(written[-1])
            left = left.join(done.where("x IS NULL").select("turn"), "turn", "left_anti").checkpoint()
            new = done.where("x IS NOT NULL").select("x", "slot", "source", "confidence")
            state = state.join(new.select("x").distinct(), "x", "left_anti").union(new.where("slot IS NOT NULL")).checkpoint()
    return spark.read.schema(schema).parquet(*written).where("x IS NULL").select("id", "decision", "existing_id", "similarity")
