"""Shared scratch space: the one folder that the driver and all executors can reach.

The folder is ``spark.checkpoint.dir`` of the session; only where that is unset and everything runs on
one machine (tests, a laptop) a local temporary folder is made and set. Intermediate tables written
here survive lost executors and cut lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between the JVM and a Python worker; Spark's own default is 64 MB, which both sides hold several times.
ARROW_BYTES = "4m"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; on a cluster without spark.checkpoint.dir an error."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="mnemoflow-")
        spark.sparkContext.setCheckpointDir(got)
    return got


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands text to Python workers in small batches, so that their memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of that name in the shared folder; it is not created yet."""
    path = f"{shared_dir(spark).rstrip('/')}/mnemoflow/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str, by: Iterable[str] = ()) -> DataFrame:
    """Writes df as Parquet into the shared folder, in folders by some columns if wanted, and reads it back, with lineage cut."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class SortedRun:
    """A table in the shared folder, dealt into buckets by its keys and sorted by them in each: joins by the keys read it without a shuffle.
    """

    name: str
    path: str
    df: DataFrame

    @staticmethod
    def write(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int, by: tuple[str, ...] = ()) -> SortedRun:
        """Writes df, in folders by some columns if wanted."""
        spark, table, path = df.sparkSession, f"mnemoflow_{name}_{uuid.uuid4().hex}", new_folder(df.sparkSession, name)
        writer = df.write.partitionBy(*by) if by else df.write
        writer.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        return SortedRun(table, path, spark.table(table))

    def drop(self) -> None:
        """Takes the table out of the catalog; its folder stays until it is released."""
        self.df.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def mark() -> int:
    """A point in time for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> None:
    """Deletes the scratch folders made since a mark but for those of some names; results built on them end with them."""
    jvm, conf, keep = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), tuple(keep)
    stays = []
    for made in _made[since:]:
        if made.rpartition("/")[2].rpartition("-")[0] in keep:
            stays.append(made)
        else:
            path = jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(conf).delete(path, True)
    _made[since:] = stays


def carry(keep: Iterable[str]) -> list[Column]:
    """The caller's columns as one struct, so that no name of theirs meets one of an operator's own."""
    keep = tuple(keep)
    return [F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("carried columns")] if keep else []


def carried(keep: Iterable[str], own: Iterable[str]) -> list[Column]:
    """The caller's columns again; one that is named like a column of the result comes as ``name_in``."""
    own = set(own)
    return [F.col("`carried columns`").getField(c).alias(f"{c}_in" if c in own else c) for c in keep]
