"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions alone.

A run is a table (k1, k2, n, keeper), bucketed and sorted by the line's 128-bit hash; every line is in one
run only. Lines are hashed once, into a table by batch; batches are ranges of doc_id, the largest ids
first. Each new batch aggregates its lines and is merged with the runs, bucket by bucket. A line without a
partner in any run (the anti-join) is new: it goes into the batch's own run, on level 0, with the batch's
largest doc_id as its keeper. The count of a line that has a partner is sent to the run that owns it, as a
row of that run's delta. Whenever a level has ``fanout`` runs, they and their deltas are compacted into one
run of the next level. For a merge only the batch's own lines are shuffled, after they were counted on
their side; runs and deltas are read in their buckets.

The runs name the shared lines. Those that very many documents hold are met by broadcast (their number
is bounded, whatever the corpus), the others by a shuffled join. Positions to drop are gathered by
document, and each document then leaves out its own lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import SortedRun, carried, carry, mark, materialize, release

#: Fixed values of the line key: what is stripped, and letters that are lower-cased.
BLANKS, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a batch, about; batches at least, one more than the default fanout, so that runs are compacted at any size, and at most, beyond which batches grow.
BATCH_ROWS, LEAST_BATCHES, MOST_BATCHES = 1 << 21, 5, 16
#: A line is hot if more than one in so many of all lines is a copy of it, so fewer than so many lines are hot.
HOT = 10_000
GRID = 240
RUN = ("k1", "k2")
#: The owner of a line that is in no run; rows of a batch for which a bucket is made, and buckets at least.
NEW, BUCKET_ROWS, LEAST_BUCKETS = -1, 1 << 18, 16


def n_batches(rows: int) -> int:
    return min(MOST_BATCHES, max(LEAST_BATCHES, -(-rows // BATCH_ROWS)))


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once although body may use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(text: Column, least_chars: int) -> Column:
    """Array of (k1, k2, pos, first) of the lines with a long enough key, sorted by hash; first marks one of each key."""
    one = lambda x, i: _let(line_key(x), lambda k: F.when(F.length(k) >= least_chars, F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(1), k).alias("k2"), i.alias("pos"))))
    found = F.array_sort(F.array_compact(F.transform(_lines(text), one)))

    def marked(a: Column) -> Column:
        same = lambda x, j: F.get(a, j - 1)["k1"].eqNullSafe(x["k1"]) & F.get(a, j - 1)["k2"].eqNullSafe(x["k2"])
        return F.transform(a, lambda x, j: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), x["pos"].alias("pos"), (~same(x, j)).alias("first")))

    return _let(found, marked)


@dataclass
class Owner:
    """The run that a batch or a compaction wrote, and the tables in which later batches sent it counts, each with its number there."""

    run: SortedRun
    deltas: list[tuple[SortedRun, int]] = field(default_factory=list)

    def lines(self) -> DataFrame:
        return self.run.df.where(F.col("owner") == NEW)

    def total(self) -> DataFrame:
        """(k1, k2, n, keeper) with the counts of the deltas; nothing is shuffled."""
        out = self.lines().select(*RUN, "n", "keeper")
        for table, k in self.deltas:
            sent = table.df.where(F.col("owner") == k).select(*RUN, F.col("n").alias("more"))
            out = out.join(sent.hint("merge"), list(RUN), "left").select(*RUN, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "keeper")
        return out


class LineRuns:
    """The levelled runs; every one is a bucketed, sorted table in the shared folder."""

    def __init__(self, buckets: int, fanout: int = 4) -> None:
        self.buckets, self.fanout = buckets, fanout
        self.levels: list[list[Owner]] = []
        self.tables: list[SortedRun] = []

    def runs(self) -> list[Owner]:
        return [r for level in self.levels for r in level]

    def _owner(self, own: DataFrame) -> DataFrame:
        """Adds ``owner``: the number of the run that has the line, or NEW where the anti-join with all of them leaves it."""
        found = F.lit(None).cast("int")
        for k, r in enumerate(self.runs()):
            own = own.join(r.lines().select(*RUN, F.lit(k).alias(f"run{k}")).hint("merge"), list(RUN), "left")
            found = F.coalesce(found, F.col(f"run{k}"))
        return own.select(*RUN, "n", "keeper", F.coalesce(found, F.lit(NEW)).alias("owner"))

    def add(self, keys: DataFrame) -> None:
        """Takes a batch (k1, k2, doc_id; a document's line once) in. One table has its new lines and what it sends to each run."""
        own = keys.groupBy(*RUN).agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        before = self.runs()
        table = self._write(self._owner(own))
        for k, r in enumerate(before):
            r.deltas.append((table, k))
        self._put(Owner(table), 0)

    def _write(self, df: DataFrame) -> SortedRun:
        """By no more tasks than there are buckets: with many shuffle partitions each of them would write a part of every bucket."""
        self.tables.append(SortedRun.write(df.coalesce(self.buckets), "run", RUN, self.buckets, by=("owner",)))
        return self.tables[-1]

    def _put(self, run: Owner, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            whole = reduce(DataFrame.union, [r.total() for r in self.levels[level]]).repartition(self.buckets, *RUN)
            merged = Owner(self._write(whole.withColumn("owner", F.lit(NEW))))
            self.levels[level] = []
            self._put(merged, level + 1)

    def merged(self) -> DataFrame:
        """(k1, k2, n, keeper) of all lines, each from the run that owns it."""
        return reduce(DataFrame.union, [r.total() for r in self.runs()])

    def drop(self) -> None:
        for table in self.tables:
            table.drop()


def line_dedup(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int | None = None, fanout: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drops lines that many documents share, except in the document with the largest doc_id among them.

    docs: doc_id (long) and text. Returns doc_id, n_lines (before), n_dropped, kept_text, and the columns
    named in ``keep``, whatever their names (one named like a column of the result comes as ``name_in``).
    ``batches`` follows the rows where it is not given. A line's key is the line stripped of ASCII white
    space with A-Z in lower case; keys of ``least_chars`` code points or more that ``least_docs`` rows
    hold lose all their lines elsewhere.

    A null or empty text is one empty line. Rows with the same doc_id are documents each, and all of
    them keep the line if theirs is the largest id. A row with a null doc_id counts as a document and
    owns a line only where all its holders are such rows. An empty table gives no rows. Lines are told
    apart by 128-bit hashes. A very long text is one array of its lines in the task that reads it.
    """
    spark, began = docs.sparkSession, mark()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry(keep))
    docs = docs.withColumn("t", F.xxhash64("text"))
    rows, grid = docs.agg(F.count("*"), F.percentile_approx("doc_id", [k / GRID for k in range(1, GRID)], 1000)).first()
    batches = batches or n_batches(rows)
    cuts = sorted({grid[round(k * GRID / batches) - 1] for k in range(1, batches)} if grid else (), reverse=True)
    batch = sum((F.when(F.col("doc_id") <= c, 1).when(F.col("doc_id").isNull(), 1).otherwise(0) for c in cuts), F.lit(0))
    held = docs.select("doc_id", "t", batch.alias("batch"), F.explode(hashed_lines(F.col("text"), least_chars)).alias("x")).select("doc_id", "t", "batch", "x.*")
    held = materialize(held, "lines", by=("batch",))

    lines = held.count()
    runs = LineRuns(max(LEAST_BUCKETS, -(-lines // BUCKET_ROWS)), fanout)
    for k in range(len(cuts) + 1):
        runs.add(held.where(F.col("first") & (F.col("batch") == k)).select(*RUN, "doc_id"))
    shared = materialize(runs.merged().where(F.col("n") >= least_docs), "shared")
    runs.drop()
    often = F.col("n") * HOT > lines
    hot, others = shared.where(often).select(*RUN, "keeper"), shared.where(~often).select(*RUN, "keeper")
    held = held.select("doc_id", "t", "pos", *RUN)
    met = held.join(F.broadcast(hot), list(RUN)).union(held.join(F.broadcast(hot.select(*RUN)), list(RUN), "left_anti").join(others, list(RUN)).select(*RUN, "doc_id", "t", "pos", "keeper"))
    drops = met.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc_id").alias("d_id"), F.col("t").alias("d_t")).agg(F.collect_list("pos").alias("drops"))
    drops = materialize(drops, "drops")
    release(spark, began, keep=("drops",))
    docs = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("t") == F.col("d_t")), "left")

    def left(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.transform(F.when(F.col("drops").isNull(), every).otherwise(F.array_except(every, "drops")), lambda i: F.get(lines, i))

    changed = F.when(F.col("drops").isNotNull(), _let(_lines(F.col("text")), lambda x: F.struct(F.size(x).alias("n"), left(x).alias("kept"))))
    docs = docs.select("*", changed.alias("changed"))
    n = F.coalesce(F.col("changed.n"), F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    own = ("doc_id", "n_lines", "n_dropped", "kept_text")
    return docs.select(
        "doc_id", n.alias("n_lines"), F.coalesce(F.col("changed.n") - F.size("changed.kept"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("changed.kept", "\n"), F.col("text")).alias("kept_text"), *carried(keep, own),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH l AS (
  SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), h AS (
  SELECT key, true AS shared, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3
), s AS (
  SELECT r, k.doc_id, i, line, shared IS NOT NULL AND k.doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN h USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM s GROUP BY r, doc_id
"""
