"""The folder for checkpoints that the driver and all executors share, and rows that the driver has."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: By session: how many hold batches by their rows, and the settings from before the first of them.
_held: dict[str, list] = {}
_lock = threading.Lock()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send batches of so many rows to Python, whatever their bytes: for small rows whose size has a bound, as Spark's limit by bytes takes the size of the whole batch after each row."""
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        held = _held.setdefault(key, [0, [spark.conf.get(c, None) for c in _ARROW]])
        held[0] += 1
        for c, n in zip(_ARROW, (rows, 2**31 - 1), strict=True):
            spark.conf.set(c, n)
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _held[key]
                for c, before in zip(_ARROW, held[1], strict=True):
                    spark.conf.set(c, before) if before is not None else spark.conf.unset(c)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where it is unset and everything runs on one machine, a local temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mnemoflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared one; it is not created yet."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_rows(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows that the driver has, as a relation of the plan itself: no task turns them from Python objects."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
