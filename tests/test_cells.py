"""Stored cells: the results of exhaustive search, from few partitions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoflow.operators import vector
from mnemoflow.operators.vector import knn
from mnemoflow.sources.cells import VectorCells
from mnemoflow.sources.workspace import ensure_checkpoint_dir

ROW = "id string, embedding array<float>, project string, cell string"


@pytest.fixture(scope="module")
def rows(spark):
    """40 groups of vectors, one of which has a third of all rows; equal vectors, and rows without one."""
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(3)
    centres = 4 * rng.normal(size=(40, 8))
    group = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
    vectors = (centres[group] + rng.normal(size=(3000, 8)) * 0.2).astype(np.float32)
    vectors[100:140] = vectors[99]
    data = [(f"c{k:04d}", v.tolist(), f"p{k % 3}", "x") for k, v in enumerate(vectors)]
    return spark.createDataFrame([*data, ("none", None, "p0", None)], ROW)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    found = VectorCells(spark, str(tmp_path_factory.mktemp("cells") / "index"))
    found.build(rows)
    return found


def asked(spark, rows):
    some = rows.where("id IN ('c0000', 'c0099', 'c1500', 'c2999')").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return some.union(spark.createDataFrame([("far", [50.0] * 8), ("null", None)], "query_id string, vector array<float>"))


def shown(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 60, 5000])
def test_results_are_those_of_exhaustive_search(spark, rows, index, k):
    assert shown(index.search(asked(spark, rows), k)) == shown(knn(rows, asked(spark, rows), k))


def test_few_cells_are_read(spark, rows, index):
    index.search(asked(spark, rows).where("query_id = 'c1500'"), 5)
    assert index.seen["cells"] >= 20 and index.seen["first"] + index.seen["second"] <= 3
    visits = np.zeros((1, index.seen["cells"]), bool)
    visits[0, :2] = True
    cells = [r["cell"] for r in spark.read.parquet(f"{index.folder}/cells").orderBy("cell").collect()]
    near = index._near(index._rows(), pa.array(["c1500"]), np.zeros((1, 8)), visits, np.array(cells), 5, asked(spark, rows))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*cell#\d+ IN \({cells[0]},{cells[1]}\)", plan)
    assert index._rows().count() == rows.count() - 1


@pytest.mark.parametrize("k", [3, 2000])
def test_filters_are_exact(spark, rows, index, k):
    got = index.search(asked(spark, rows), k, F.col("project") == "p1")
    assert shown(got) == shown(knn(rows.where("project = 'p1'"), asked(spark, rows), k))
    assert index.search(asked(spark, rows), k, F.col("project") == "nowhere").count() == 0


def test_more_queries_than_a_batch(spark, rows, index, monkeypatch):
    monkeypatch.setattr(vector, "BATCH", 2)
    assert shown(index.search(asked(spark, rows), 3)) == shown(knn(rows, asked(spark, rows), 3))


def test_empty_tables(spark, rows, tmp_path):
    empty = VectorCells(spark, str(tmp_path / "none"))
    empty.build(rows.where("false"))
    assert empty.search(asked(spark, rows), 3).count() == 0
    one = VectorCells(spark, str(tmp_path / "one"))
    one.build(rows.where("id = 'c0001'"))
    assert {r["id"] for r in one.search(asked(spark, rows), 3).collect()} == {"c0001"}
    assert one.search(asked(spark, rows).where("false"), 3).count() == 0
