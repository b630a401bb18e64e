"""A full-text index that lives with the chunks: every change adds a small segment, and nothing is rebuilt.

A segment holds what some changes of the chunk table brought, in folders of Parquet files: ``docs`` (the ids
they touched, with their length, or null if they are gone), ``places`` (which chunks of a block hold a word,
sorted by word), ``words`` (gram, token: the trigrams of its different words, sorted by gram) and ``figures``
(how many chunks there are since, and their length). An id in a later segment hides its rows in the earlier
ones. Segments of like size are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.operators import fulltext
from mnemoflow.sources.folders import GRACE, VersionedTable, like_size, spans

PLACES = "token string, block long, docs array<int>, times array<int>, ids array<string>, dls array<long>"
WORDS, DOCS, FIGURES = "gram string, token string", "id string, dl long", "n long, total long"
#: Ids that a segment touches and that are looked up in the earlier ones by broadcast at most.
TOUCHED = 100_000
#: Rows of a page of the files of places.
PAGE_ROWS = 2_000


class LiveIndex:
    def __init__(self, spark: SparkSession, path: str, table: VersionedTable) -> None:
        self.spark, self.path, self.table = spark, path.rstrip("/"), table
        self._known: tuple[tuple[int, int], tuple[int, int]] | None = None

    def segments(self) -> list[tuple[int, int]]:
        """The segments that count, oldest first, as the numbers of the changes that they cover. ``figures`` is written last."""
        return spans(self.table.done(f"{self.path}/figures"))

    def _read(self, kind: str, schema: str, segments: list[tuple[int, int]]) -> DataFrame:
        """Rows of some segments with the last change of each in ``seg``."""
        out = None
        for a, b in segments:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{a}-{b}").withColumn("seg", F.lit(b))
            out = part if out is None else out.union(part)
        return self.spark.createDataFrame([], f"{schema}, seg int") if out is None else out

    def covers(self) -> bool:
        """Whether every change of the table is in a segment."""
        return not self._missing() and bool(self.segments())

    def _missing(self) -> list[tuple[str, int, int]]:
        """What the table has and no segment does, oldest first: changes, or a whole version where the changes up to it are not all there."""
        here, out = self.segments(), []
        upto = here[-1][1] if here else -1
        changes = spans(self.table.done(self.table.path, "d="))
        whole = self.table.versions()[-1:]
        if whole and whole[0] > upto and (not here or not set(range(upto + 1, whole[0] + 1)) <= {n for a, b in changes for n in range(a, b + 1)}):
            out, here, upto = [("v", 0, whole[0])], [], whole[0]
        return out + [("d", a, b) for a, b in changes if b > upto]

    def live(self, rows: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
        """rows (id, seg) whose id no later segment touched."""
        if len(segments) < 2:
            return rows
        last = self._read("docs", DOCS, segments[1:]).groupBy("id").agg(F.max("seg").alias("last"))
        return rows.join(last, "id", "left").where("last IS NULL OR seg >= last").drop("last")

    def catch_up(self) -> int:
        """Adds what the table has got since; the number of segments written. Only new rows are read, and the lengths of the chunks they take the place of."""
        todo = self._missing()
        for kind, a, b in todo:
            if kind == "v":
                rows = self.table.whole(b)
                self._add(rows, None, a, b, [])
            else:
                change = self.table.change_rows(a, b)
                self._add(change.where("NOT gone").drop("gone"), change.where("gone").select("id"), a, b, [s for s in self.segments() if s[1] < b])
            self._merge()
        return len(todo)

    def _add(self, rows: DataFrame, gone: DataFrame | None, a: int, b: int, before: list[tuple[int, int]]) -> None:
        places, lengths = fulltext.places_of(rows, salt=b)
        docs = lengths if gone is None else lengths.unionByName(gone.select("id", F.lit(None).cast("long").alias("dl")))
        self._put("docs", docs, a, b)
        self._put_places(places, a, b)
        docs = self._read("docs", DOCS, [(a, b)])
        n, total, touched = docs.agg(F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0)), F.count("*")).first()
        if before:
            ids = docs.select("id")
            hit = self.live(self._read("docs", DOCS, before), before).join(F.broadcast(ids) if touched <= TOUCHED else ids, "id", "left_semi")
            old_n, old_total = hit.agg(F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            was_n, was_total = self.figures(before[-1])
            n, total = was_n + n - old_n, was_total + total - old_total
        self._put("figures", self.spark.createDataFrame([(n, total)], FIGURES), a, b)

    def _put_places(self, places: DataFrame, a: int, b: int) -> None:
        """Sorted by word, and words by gram, in pages of so few rows that a lookup reads little beside them. Words are read back, so places are made once."""
        paged = lambda df, kind: df.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/{kind}/{a}-{b}")
        own = F.when(F.col("token") == "", F.col("block"))  # rows of blocks share a token
        paged(places.select("token", "block", "docs", "times", "ids", "dls").repartition("token", own).sortWithinPartitions("token"), "places")
        tokens = self._read("places", PLACES, [(a, b)]).where("token <> ''").select("token").distinct()
        paged(fulltext.grams_of(tokens).repartition("gram").sortWithinPartitions("gram"), "words")

    def _living(self, some: list[tuple[int, int]]) -> DataFrame:
        """The rows of places of some segments without chunks that a later one of them touched."""
        rows = self._read("places", PLACES, some)
        each = rows.where("token = ''").select("block", "seg", F.explode(F.arrays_zip("docs", "ids", "dls")).alias("x")).select("block", "seg", F.col("x.docs").alias("doc"), F.col("x.ids").alias("id"), F.col("x.dls").alias("dl"))
        left = self.live(each, some).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc", "id", "dl"))).alias("x"))
        own = left.select(F.lit("").alias("token"), "block", F.col("x.doc").alias("docs"), F.lit(None).cast("array<int>").alias("times"), F.col("x.id").alias("ids"), F.col("x.dl").alias("dls"))
        flags = F.aggregate("x.doc", F.lit(""), lambda s, i: F.concat(F.rpad(s, i, F.lit("0")), F.lit("1")))
        held = rows.where("token <> ''").join(left.select("block", flags.alias("flags")), "block")
        kept = held.withColumn("y", F.filter(F.arrays_zip("docs", "times"), lambda y: F.substring("flags", y["docs"] + 1, F.lit(1)) == "1")).where(F.size("y") > 0)
        return kept.select("token", "block", F.col("y.docs").alias("docs"), F.col("y.times").alias("times"), "ids", "dls").union(own)

    def _put(self, kind: str, rows: DataFrame, a: int, b: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/{a}-{b}")

    def figures(self, segment: tuple[int, int]) -> tuple[int, int]:
        """How many chunks there are after a segment, and the sum of their lengths; remembered for the last one asked for."""
        if not self._known or self._known[0] != segment:
            row = self._read("figures", FIGURES, [segment]).first()
            self._known = segment, (row["n"], row["total"])
        return self._known[1]

    def _merge(self) -> None:
        """Brings the last segments of like size together, for as long as there are some; then segments that others cover go."""
        while some := like_size([(s, self.table.size(f"{self.path}/places/{s[0]}-{s[1]}")) for s in self.segments()]):
            a, b = some[0][0], some[-1][1]
            kept = {s: self.figures(s) for s in some[-1:]}
            first = some[0] == self.segments()[0]
            docs = self._read("docs", DOCS, some).groupBy("id").agg(F.max_by("dl", "seg").alias("dl"))
            self._put("docs", docs.where("dl IS NOT NULL") if first else docs, a, b)  # nothing earlier is left to hide
            self._put_places(self._living(some), a, b)
            self._put("figures", self.spark.createDataFrame([kept[some[-1]]], FIGURES), a, b)
        counts = self.segments()
        for a, b in self.table.done(f"{self.path}/figures"):
            if (a, b) not in counts and self.table._age(f"{self.path}/figures/{a}-{b}/_SUCCESS") > GRACE:
                for kind in ("figures", "places", "words", "docs"):
                    self.table.delete_folder(f"{self.path}/{kind}/{a}-{b}")

    def rebuild(self) -> int:
        """The whole index anew as one segment; how many pairs of a word and a chunk it has."""
        b = self.table.current()
        self._known = None
        for a, c in self.table.done(f"{self.path}/figures"):
            self.table.delete_folder(f"{self.path}/figures/{a}-{c}")
        if b < 0:
            return 0
        self._add(self.table.read(), None, 0, b, [])
        return self._read("places", PLACES, [(0, b)]).where("token <> ''").agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0]

    def _asked(self) -> tuple[tuple[DataFrame, int, float], dict]:
        """What a search takes: rows, statistics, words, and what drops chunks that are gone."""
        here = self.segments()
        n, total = self.figures(here[-1]) if here else (0, 0)
        more = {"alive": lambda rows: self.live(rows, here), "words": self._read("words", WORDS, here).drop("seg")}
        return (self._read("places", PLACES, here), n, total / n if n else 0.0), more

    def scores(self, queries: list[tuple[object, str]], id_type: str = "string") -> DataFrame:
        """BM25 scores of some queries over the chunks as they are now."""
        index, more = self._asked()
        return fulltext.bm25_by_places(*index, queries, id_type, **more)

    def best(self, queries: list[tuple[object, str]], k: int = 20, id_type: str = "string", wanted: DataFrame | None = None, ids_as: str = "string") -> DataFrame:
        """The best k chunks of each query (query_id, id, score, rank), among the ids of ``wanted`` if there are some; ties by id as that type."""
        index, more = self._asked()
        return fulltext.best_by_places(*index, queries, k, id_type, wanted=wanted, ids_as=ids_as, **more)
