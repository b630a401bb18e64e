"""Tables that change: folders of Parquet files for whole versions and for the changes since."""

from __future__ import annotations

import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Neighbours of like size that are merged at a time, and how much larger the first may be than the others together.
FANOUT, LIKE = 4, 2.0
#: Seconds after which a number that was taken and never written counts as given up, and for which a folder that others cover stays, for those who read it.
GIVEN_UP, GRACE = 3600, 600
#: Changed ids that go to all tasks at most, and bytes of changes below which they are not counted for that.
KEYS, UNCOUNTED = 500_000, 4 << 20


def spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of ranges of changes those that no other range covers, oldest first."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def matching(rows: DataFrame, ids: DataFrame, few: bool, how: str) -> DataFrame:
    """rows with (left_semi) or without (left_anti) some ids, null being an id; few ids go to all tasks, so that rows are not shuffled."""
    there = ids.select(F.col("id").alias("there"))
    return rows.join(F.broadcast(there) if few else there, F.col("id").eqNullSafe(F.col("there")), how)


def like_size(sized: list[tuple[tuple[int, int], int]]) -> list[tuple[int, int]]:
    """The last ``FANOUT`` or more ranges, if the first of them is not much larger than those after it."""
    for k in range(len(sized) - FANOUT, -1, -1):
        rest = sum(n for _, n in sized[k + 1 :])
        if sized[k][1] <= LIKE * rest:
            while k and sized[k - 1][1] <= LIKE * sum(n for _, n in sized[k:]):
                k -= 1
            return [s for s, _ in sized[k:]]
    return []


class VersionedTable:
    """Folders v=0, d=1-1, d=2-5, v=6, ... of Parquet: whole versions and changes since; those with a success marker count.

    A change has the rows that are new or other, by their id, and the ids that are gone. Reading takes the
    last whole version and the latest change of each id after it. Changes of like size are merged; once they
    hold half as many bytes as the whole version (or the first change, where there is none), a whole version
    is written under the number of the last change. So a small write costs its own bytes a few times over, and a read a number of folders
    that grows with the logarithm of the changes.

    A writer takes its number by creating a file that must not be there, and puts its folder under it only
    then, so writers at the same time lose nothing; merges stop before a number that is taken and not written yet.
    Folders that others cover stay for a while.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._rows: dict[tuple[int, int], int] = {}

    # -- folders -----------------------------------------------------------------------------------
    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []

    def done(self, folder: str, prefix: str = "") -> list[tuple[int, int]]:
        """The ranges of the finished folders there that are named ``prefix`` first-last."""
        fs, path = self._fs()
        named = [re.fullmatch(re.escape(prefix) + r"(\d+)-(\d+)", n) for n in self._names(folder)]
        return sorted((int(m[1]), int(m[2])) for m in named if m and fs.exists(path(f"{folder}/{m[0]}/_SUCCESS")))

    def size(self, folder: str) -> int:
        fs, path = self._fs()
        return fs.getContentSummary(path(folder)).getLength()

    def delete_folder(self, folder: str) -> None:
        fs, path = self._fs()
        fs.delete(path(folder), True)

    # -- numbers -----------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        """Numbers of the whole versions."""
        fs, path = self._fs()
        return sorted(int(n[2:]) for n in self._names(self.path) if re.fullmatch(r"v=\d+", n) and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def spans(self) -> list[tuple[int, int]]:
        """The ranges of changes since the last whole version, each number in one of them."""
        last = (self.versions()[-1:] or [-1])[0]
        return [s for s in spans(self.done(self.path, "d=")) if s[1] > last]

    def current(self) -> int:
        """The number of what ``read`` gives; -1 for nothing."""
        return max([*self.versions(), *(b for _, b in self.done(self.path, "d="))], default=-1)

    def _draft(self, df: DataFrame) -> str:
        """Writes df into a folder that does not count."""
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        df.write.parquet(draft)
        return draft

    def _publish(self, draft: str, name: str) -> int:
        """Puts a draft under the next free number; ``name`` has the folder's name for a number."""
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.path}/_numbers"))
        while True:
            n = max([self.current(), *(int(x) for x in self._names(f"{self.path}/_numbers") if x.isdigit())]) + 1
            try:
                if fs.createNewFile(path(f"{self.path}/_numbers/{n}")):
                    break
            except Exception as e:  # another writer was faster
                if "FileAlreadyExists" not in str(e):
                    raise
        fs.rename(path(draft), path(f"{self.path}/{name.format(n)}"))
        return n

    def _age(self, path_: str) -> float:
        """Seconds since a file was written."""
        fs, path = self._fs()
        return time.time() - fs.getFileStatus(path(path_)).getModificationTime() / 1000

    def _settled(self) -> int:
        """The number below which every number that was taken is written, or given up."""
        taken = sorted(int(x) for x in self._names(f"{self.path}/_numbers") if x.isdigit())
        there = {*self.versions(), *(n for a, b in self.done(self.path, "d=") for n in range(a, b + 1))}
        last = (self.versions()[-1:] or [-1])[0]
        late = (n for n in taken if n > last and n not in there and self._age(f"{self.path}/_numbers/{n}") < GIVEN_UP)
        return next(late, taken[-1] + 1 if taken else 0)

    # -- rows --------------------------------------------------------------------------------------
    def whole(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={n}")

    def change_rows(self, a: int, b: int) -> DataFrame:
        """The rows of a range of changes, and ``gone``."""
        return self.spark.read.schema(f"{self.schema}, gone boolean").parquet(f"{self.path}/d={a}-{b}")

    def _few(self, some: list[tuple[int, int]]) -> bool:
        """Whether some ranges of changes have so few ids that all tasks can have them."""
        if sum(self.size(f"{self.path}/d={a}-{b}") for a, b in some) <= UNCOUNTED:
            return True
        for s in some:
            if s not in self._rows:
                self._rows[s] = self.change_rows(*s).count()
        return sum(self._rows[s] for s in some) <= KEYS

    def _without(self, rows: DataFrame, some: list[tuple[int, int]]) -> DataFrame:
        """rows whose id is in none of some ranges of changes."""
        return matching(rows, reduce(DataFrame.union, [self.change_rows(*s).select("id") for s in some]), self._few(some), "left_anti") if some else rows

    def _latest(self, some: list[tuple[int, int]], *columns: str) -> DataFrame:
        """The latest row of each id in some ranges of changes, oldest first, gone ones too. An id is in a range once, so rows are those of a range without the ids of later ones."""
        parts = [self.change_rows(*s).select(*(columns or ("*",)), *(("gone",) if columns else ())) for s in some]
        return reduce(DataFrame.union, [self._without(p, some[k + 1 :]) for k, p in enumerate(parts)])

    def read(self, *columns: str) -> DataFrame:
        """The rows as they are now, or some of their columns, with id."""
        return self._content(self.spans(), *columns)

    def write(self, df: DataFrame) -> int:
        """A whole version, which is exactly these rows."""
        return self._publish(self._draft(df.select(*self.spark.createDataFrame([], self.schema).columns)), "v={}")

    def change(self, rows: DataFrame, gone: bool = False) -> int:
        """Rows to put under their ids (columns that are missing are null), or ids to take out. Of rows that share an id the greatest counts, by their columns in order.

        Rows are written as they come, and only those that turn out to share an id are shuffled and written again with the others.
        """
        empty = self.spark.createDataFrame([], self.schema)
        names = [c for c in empty.columns if c in rows.columns]
        shaped = lambda df: empty.unionByName(df.select(*names), allowMissingColumns=True).withColumn("gone", F.lit(gone))
        if len(names) == 1:
            draft = self._draft(shaped(rows.select("id").distinct()))
        else:
            draft = self._draft(shaped(rows))
            written = self.spark.read.schema(f"{self.schema}, gone boolean").parquet(draft)
            again = written.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
            if shared := again.limit(KEYS + 1).count():
                one = matching(written, again, shared <= KEYS, "left_semi").groupBy("id").agg(F.max(F.struct(*names)).alias("row")).select("row.*")
                first, draft = draft, self._draft(matching(written, again, shared <= KEYS, "left_anti").union(shaped(one)))
                self.delete_folder(first)
        n = self._publish(draft, "d={0}-{0}")
        self._tidy()
        return n

    def _tidy(self) -> None:
        """Deletes changes that a merge or a whole version covered before; merges those of like size; writes a whole version where changes are a large share."""
        fs, path = self._fs()
        limit = self._settled()  # before the folders are listed: what comes later has a greater number
        found, counts = self.versions(), self.spans()
        for a, b in self.done(self.path, "d="):
            if (a, b) not in counts and (not found or b > found[-1]) and self._age(f"{self.path}/d={a}-{b}/_SUCCESS") > GRACE:
                self.delete_folder(f"{self.path}/d={a}-{b}")
        some = [(s, self.size(f"{self.path}/d={s[0]}-{s[1]}")) for s in counts if s[1] < limit]
        if not some:
            return
        sizes = ([self.size(f"{self.path}/v={found[-1]}")] if found else []) + [n for _, n in some]
        if len(some) >= FANOUT and 2 * sum(sizes[1:]) > sizes[0]:
            last = some[-1][0][1]
            df, name = self._content([s for s, _ in some]), f"v={last}"
        elif merged := like_size(some):
            df, name = self._latest(merged), f"d={merged[0][0]}-{merged[-1][1]}"
        else:
            return
        draft = self._draft(df)
        if fs.exists(path(f"{self.path}/{name}")) or not fs.rename(path(draft), path(f"{self.path}/{name}")):
            self.delete_folder(draft)  # another writer has done the same
        if name.startswith("v="):
            self.retire(age=GRACE)

    def _content(self, some: list[tuple[int, int]], *columns: str) -> DataFrame:
        """The rows after some ranges of changes since the last whole version, or some of their columns."""
        found = self.versions()
        whole = (self.whole(found[-1]) if found else self.spark.createDataFrame([], self.schema)).select(*(columns or ("*",)))
        if not some:
            return whole
        new = self._latest(some, *columns).where("NOT gone").drop("gone")
        return self._without(whole, some).union(new) if found else new

    def retire(self, keep: int = 2, age: float = 0) -> None:
        """Deletes all whole versions but the last ones, and the changes before them, if they are as old as that."""
        found = self.versions()
        old = [f"{self.path}/v={n}" for n in found[:-keep]]
        if len(found) >= keep:
            old += [f"{self.path}/d={a}-{b}" for a, b in self.done(self.path, "d=") if b <= found[-keep]]
        for folder in old:
            if self._age(f"{folder}/_SUCCESS") >= age:
                self.delete_folder(folder)
