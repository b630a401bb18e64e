"""The registered queries against their oracles, and that no branch stands empty."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from mnemoflow.plans import catalog, views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Searches for all benchmark texts; here on small tables, to save time.
SEARCHES = ("bm25_topk", "bm25_filtered", "bm25_postings", "rrf_fusion", "hybrid_batch", "hybrid_constant_popularity", "source_postfilter", "hybrid_rerank", "fuse_weights")


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(float(r[k]) if isinstance(r[k], float) else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in SEARCHES])
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cur = con.execute(catalog.oracle_sql()[name])
    want = shown(cur.fetchall(), [c[0] for c in cur.description])
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert shown([tuple(r) for r in df.collect()], df.columns) == want


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """Tables of 25 documents and six benchmark texts."""
    folder, c = tmp_path_factory.mktemp("small"), duckdb.connect()
    for t in ("events", "embeddings"):
        c.execute(f"COPY (FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet'")
    c.execute(f"COPY (FROM '{SF}/documents.parquet' WHERE doc_id % 8 = 0) TO '{folder}/documents.parquet'")
    c.execute(f"COPY (FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 6) TO '{folder}/benchmark.parquet'")
    for t in ("events", "embeddings", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", SEARCHES)
def test_searches(spark, small, name):
    folder, c = small
    df = catalog.queries()[name](spark, folder)
    cur = c.execute(catalog.oracle_sql()[name])
    want = shown(cur.fetchall(), [x[0] for x in cur.description])
    assert shown([tuple(r) for r in df.collect()], df.columns) == want and want


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_every_branch_has_rows(spark):
    values = lambda name, c: {r[0] for r in catalog.queries()[name](spark, SF).select(c).distinct().collect()}
    assert values("dedup_decide", "decision") == {"insert", "merge", "skip"} == values("dedup_sequential", "decision")
    assert values("incremental_scan", "status") == {"changed", "new", "unchanged"}
    assert len(values("confidence_score", "confidence")) > 3 and len(values("reclassify", "new_source")) == 4 and len(values("source_detect", "detected")) == 4


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_mixed_vectors_take_a_norm_once_a_row(spark):
    """Not inside the function of each component."""
    from mnemoflow.plans import views

    assert "/ sqrt(" not in views.mixed(spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_accesses_go_to_the_chunks_however_many_events_there_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = views.chunks(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
