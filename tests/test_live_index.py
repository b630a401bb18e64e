"""Tables that change, and the index that follows them."""

import math
import random
import re
import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoflow.memory import Memory
from mnemoflow.operators import fulltext
from mnemoflow.sources import folders
from mnemoflow.sources.folders import VersionedTable, like_size, spans
from mnemoflow.sources.store import ChunkStore
from mnemoflow.sources.workspace import fresh_folder

ROWS = "id string, text string, project string, entities array<string>"
ASKED = [("q1", "spark engine"), ("q2", "the ana anan"), ("q3", "nothing-here"), ("q4", "向量检索 engine"), ("q5", "proj")]


def rounded(df):
    return sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in df.collect())


def note(rng, k):
    words = ["spark", "engine", "banana", "ananas", "the", "向量检索系统", "other", "re-engineer", "x", "the spark"]
    return (f"n{k}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["project a", None, "spark"]), rng.choice([None, ["engine"], ["a", "b"]]))


def plain(rows, asked):
    """The formula, term by term."""
    import json

    low = {i: [(t or "").lower(), (p or "").lower(), json.dumps(e, separators=(",", ":"), ensure_ascii=False).lower() if e is not None else "[]"] for i, t, p, e in rows}
    size = {i: sum(max(0, len(c) - 2) for c in cols) for i, cols in low.items()}
    average = sum(size.values()) / len(size)
    out = []
    for q, text in asked:
        total = {}
        for t in (x.lower() for x in fulltext.query_terms(text) if len(x) >= 3):
            f = {i: sum(len(re.findall(f"(?={re.escape(t)})", c)) for c in cols) for i, cols in low.items()}
            n = sum(x > 0 for x in f.values())
            idf = math.log((len(low) - n + 0.5) / (n + 0.5))
            for i, x in f.items():
                if x:
                    total[i] = total.get(i, 0.0) - (idf if idf > 0 else 1e-6) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[i] / average))
        out += [(q, i, round(s, 9)) for i, s in total.items()]
    return sorted(out)


def test_ranges():
    assert spans([(0, 0), (1, 1), (2, 2), (1, 4), (3, 3), (6, 6)]) == [(0, 0), (1, 4), (6, 6)] and spans([]) == []
    sized = lambda *n: [((k, k), x) for k, x in enumerate(n)]
    assert like_size(sized(1, 1, 1)) == [] and like_size(sized(1000, 1, 1, 1)) == []
    assert like_size(sized(1000, 1, 1, 1, 1)) == [(1, 1), (2, 2), (3, 3), (4, 4)] and like_size(sized(3, 1, 1, 1)) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def written(spark):
    """Bytes that all stages have shuffled so far."""
    context = spark.sparkContext
    found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(found.apply(k).shuffleWriteBytes() for k in range(found.size()))


def test_changes_shuffle_ids_and_not_rows(spark, monkeypatch):
    """Appending, updating and reading; rows that share an id are brought together, whether ids go to all tasks or not."""
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"{k}")), 512) for k in range(8)])
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), text.alias("text"))
    before, t = written(spark), VersionedTable(spark, fresh_folder(spark, "changes"), "id string, text string")
    t.change(rows)
    t.change(rows.where("id % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text")))
    assert t.read().where("text LIKE 'new %'").count() == 1000 and t.read().count() == 3000 and t.read("id").columns == ["id"]
    assert written(spark) - before < 500_000  # the texts are 3 MB
    for keys, uncounted in ((folders.KEYS, folders.UNCOUNTED), (1, 0)):
        monkeypatch.setattr(folders, "KEYS", keys)
        monkeypatch.setattr(folders, "UNCOUNTED", uncounted)
        t = VersionedTable(spark, fresh_folder(spark, "changes"), "id string, text string")
        t.change(spark.createDataFrame([("a", "1"), ("a", "3"), ("a", "2"), ("b", "1"), (None, "x"), (None, "y"), ("c", None), ("c", "0")], "id string, text string"))
        t.change(spark.createDataFrame([("b", "2"), (None, "z")], "id string, text string"))
        t.change(spark.createDataFrame([("c",), ("d",)], "id string"), gone=True)
        assert sorted(map(repr, map(tuple, t.read().collect()))) == ["('a', '3')", "('b', '2')", "(None, 'z')"]


def test_index_follows_every_change(spark):
    """After appends, updates, deletions, a replaced table and merges, without a rebuild: scores of the stored index, of a scan and of the formula are the same."""
    rng = random.Random(8)
    store = ChunkStore(spark, fresh_folder(spark, "live"))
    have = {r[0]: r for r in (note(rng, k) for k in range(30))}
    store.append(spark.createDataFrame(list(have.values()), ROWS))
    assert not store.index.segments() and store.rebuild_postings() > 100
    most = 1
    for step in range(9):
        new = [note(rng, rng.randrange(60)) for _ in range(rng.randint(1, 4))]
        if step % 3 == 2:
            gone = rng.sample(sorted(have), 3)
            store.delete(gone)
            have = {i: r for i, r in have.items() if i not in gone}
        elif step == 4:
            have = {i: (i, (r[1] or "") + " spark", *r[2:]) for i, r in have.items()}
            store.replace(spark.createDataFrame(list(have.values()), ROWS).withColumns({c: F.lit(None).cast(t) for c, t in store.chunks().dtypes if c not in ("id", "text", "project", "entities")}))
        elif step == 6:
            known = [r for r in {n[0]: n for n in new}.values() if r[0] in have] + [("unknown", "spark", None, None)]
            store.update(spark.createDataFrame(known, ROWS))
            have |= {r[0]: r for r in known if r[0] in have}
        else:
            new = list({n[0]: n for n in new}.values())
            store.append(spark.createDataFrame(new, ROWS))
            have |= {r[0]: r for r in new}
        most = max(most, len(store.index.segments()))
        assert store.has_postings()
        want = plain(list(have.values()), ASKED)
        assert rounded(store.index.scores(ASKED)) == want, step
    assert rounded(fulltext.bm25(store.chunks(), ASKED)) == want
    assert most > 2 and store.index.figures(store.index.segments()[-1])[0] == len(have)


def test_segments_are_merged_and_changes_cost_their_own_rows(spark, monkeypatch):
    """Many one-row changes of a table leave few segments, and write little of it again."""
    rng = random.Random(3)
    store = ChunkStore(spark, fresh_folder(spark, "live"))
    store.append(spark.createDataFrame([(f"b{k}", " ".join(f"{rng.random()}" for _ in range(90)), "p", None) for k in range(400)], ROWS))
    store.rebuild_postings()
    written, put = [], store.table._publish
    whole = store.table.size(f"{store.table.path}/d=0-0")
    monkeypatch.setattr(store.table, "_publish", lambda df, name: (written.append(name), put(df, name))[1])
    for k in range(9):
        store.append(spark.createDataFrame([(f"n{k}", f"spark note {k}", "p", None)], ROWS))
    assert len(store.index.segments()) <= 5 and len(store.table.spans()) <= 5 and store.chunks().count() == 409
    assert store.index.segments()[0] == (0, 0) and not store.table.versions()  # neither the large segment nor the large change was written again
    assert store.table.size(store.table.path) < 3 * whole
    assert len(rounded(store.index.scores([("q", "spark note")]))) == 9


def test_a_lookup_reads_no_text(spark):
    store = ChunkStore(spark, fresh_folder(spark, "live"))
    store.append(spark.createDataFrame([note(random.Random(1), k) for k in range(20)], ROWS))
    store.rebuild_postings()
    scored = store.index.scores(ASKED)
    assert "/chunks/" not in scored._jdf.queryExecution().toString() and scored.count() > 0


def test_an_unfinished_segment_does_not_count(spark):
    """A writer that died after some folders of a segment: the next one writes it again."""
    store = ChunkStore(spark, fresh_folder(spark, "live"))
    rows = [note(random.Random(5), k) for k in range(12)]
    store.append(spark.createDataFrame(rows[:8], ROWS))
    store.rebuild_postings()
    store.table.change(spark.createDataFrame(rows[8:], ROWS))
    store.index._put("docs", spark.createDataFrame([("n9", 1)], "id string, dl long"), 1, 1)
    assert not store.has_postings()
    assert store.index.catch_up() == 1 and rounded(store.index.scores(ASKED)) == plain(rows, ASKED)


def test_writers_at_the_same_time(spark):
    """None of their changes is lost, and each has a number of its own."""
    table = VersionedTable(spark, fresh_folder(spark, "table"), "id string, n long")
    write = lambda k: table.change(spark.createDataFrame([(f"r{k}", k)], "id string, n long"))
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write, range(10)))
    assert sorted(numbers) == list(range(10)) and {r["id"] for r in table.read().collect()} == {f"r{k}" for k in range(10)}


def test_a_number_that_is_taken_holds_merges_back(spark, monkeypatch):
    """A change that comes late, under a number that its writer took before, is not covered by a merge."""
    table = VersionedTable(spark, fresh_folder(spark, "table"), "id string, n long")
    one = lambda i, n: spark.createDataFrame([(i, n)], "id string, n long")
    table.change(one("a", 1))
    fs, path = table._fs()
    fs.createNewFile(path(f"{table.path}/_numbers/1"))
    for k in range(6):
        table.change(one("b", k))
    assert table.versions() == [] and (1, 1) not in table.spans()
    one("a", 2).withColumn("gone", F.lit(False)).write.parquet(f"{table.path}/d=1-1")
    assert {(r["id"], r["n"]) for r in table.read().collect()} == {("a", 2), ("b", 5)}
    table.change(one("c", 1))
    assert table.versions() and {(r["id"], r["n"]) for r in table.read().collect()} == {("a", 2), ("b", 5), ("c", 1)}
    monkeypatch.setattr(folders, "GIVEN_UP", 0)
    fs.createNewFile(path(f"{table.path}/_numbers/99"))
    assert table._settled() == 100 and table.change(one("d", 1)) == 100


def test_a_search_takes_few_jobs(spark):
    """A single search over a stored index with changes since: few jobs, and none of them writes but a checkpoint of hits."""
    m = Memory(spark, fresh_folder(spark, "memory"))
    m.add("spark engine notes are here\n\nother things about bananas and engines")
    m.store.rebuild_postings()
    m.search("spark engine", 3, record=False)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one search", "")
    assert m.search("spark engine", 3, record=False)[0]["bm25_rank"] == 0
    spark.sparkContext.setJobGroup("later", "")
    assert 1 < len(tracker.getJobIdsForGroup("one search")) <= 10
    m.add("a third note about spark")
    assert m.store.has_postings() and any("third" in h["text"] for h in m.search("third spark", 3))


@pytest.mark.parametrize("texts", [[], [None], ["", "ab"]])
def test_places_of_little(spark, texts):
    df = spark.createDataFrame([(str(k), t, None, None) for k, t in enumerate(texts)], ROWS)
    places, lengths = fulltext.places_of(df)
    assert places.count() == 0 and lengths.count() == len(texts)


def test_the_index_is_no_larger_than_the_texts(spark):
    """A row for each word and block, none for each trigram and chunk; a batch of many phrases and a small one find the same."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    rows = [(f"n{k}", " ".join(rng.choice(words) for _ in range(300)), "p", None) for k in range(300)]
    store = ChunkStore(spark, fresh_folder(spark, "live"))
    store.append(spark.createDataFrame(rows, ROWS))
    store.rebuild_postings()
    assert store.table.size(store.index.path) < sum(len(r[1]) for r in rows)
    asked = [(f"q{k}", " ".join(words[100 * k : 100 * k + 100])) for k in range(25)]
    found = lambda df: {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in df.collect()}
    many = found(store.index.best(asked, 5))
    assert many == found(fulltext.topn(fulltext.bm25(store.chunks(), asked), 5)) and len(many) == 125
    one = found(store.index.best(asked[:1], 5, wanted=store.chunks().where("id < 'n2'").select("id")))
    assert one == found(fulltext.topn(fulltext.bm25(store.chunks(), asked[:1]).where("id < 'n2'"), 5))


def test_merged_segments_lose_hidden_chunks(spark):
    store = ChunkStore(spark, fresh_folder(spark, "live"))
    for k in range(5):
        store.append(spark.createDataFrame([(f"n{i}", f"shared word{k}a", "p", None) for i in range(k, 6)], ROWS))
        if not k:
            store.rebuild_postings()
    assert len(store.index.segments()) < 5
    places = store.index._read("places", "token string, block long, docs array<int>, times array<int>, ids array<string>, dls array<long>", store.index.segments()[:1])
    assert places.where("token = 'shared'").selectExpr("sum(size(docs))").first()[0] == 6
    assert {r["id"] for r in store.index.scores([("q", "word1a")]).collect()} == {"n1"} and len(rounded(store.index.scores([("q", "shared")]))) == 6


def test_a_place_costs_no_more_where_many_phrases_begin_alike():
    match = fulltext._matcher(["abc", "bcx", *(f"abc{i:05d}" for i in range(20_000))])
    assert match("abcxabc00007") == [(0, 2), (1, 1), (9, 1)] and match("ab") == [] == match("")
    began = time.process_time()
    for _ in range(2000):
        match("abcxyzabcxyz")
    assert time.process_time() - began < 1


def test_blocks_have_a_bounded_number_of_chunks():
    n = 3 * fulltext.BLOCK_CHUNKS - 1
    batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "dl": [1] * n} | {c: ["abc"] * n for c in fulltext.COLUMNS})
    assert [p.num_rows for p in fulltext._parts(batch)] == [fulltext.BLOCK_CHUNKS, fulltext.BLOCK_CHUNKS, fulltext.BLOCK_CHUNKS - 1]


def test_rows_of_the_index_go_to_python_by_their_number(spark):
    """Spark's limit by bytes takes the size of the batch after each row, and rows of the index are small and many."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(limit), []
    chunks = spark.createDataFrame([(str(i), f"some words {i} here") for i in range(9)], "id string, text string")
    places, _ = fulltext.places_of(chunks)
    got = fulltext.best_by_places(places, 9, 10.0, [(1, "words")], 3, "long", alive=lambda rows: seen.append(spark.conf.get(limit)) or rows)
    assert [r["id"] for r in got.orderBy("rank").collect()] == ["0", "1", "2"]
    assert seen == [str(2**31 - 1)] and spark.conf.get(limit) == before
