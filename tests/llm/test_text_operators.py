"""Operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from . import brute
from .conftest import rows
from mnemoflow.llm import op1_pii, op3_substring_dedup, op5_minhash_forest, op6_bpe_tree, op7_quality_rules, op8_line_dedup, textkit


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = [None, "", " a\tb ", "x y  z", "\x1c\x1d w\x0b\x0cv", "日本 語", "tail "]
    for most in (1, 5, 1 << 20):
        got = {}
        for i, j, w in textkit.column_words(pa.array(texts), most):
            data = w.data.tobytes()
            for d in range(j - i):
                got[i + d] = [data[w.start[k] : w.end[k]].decode() for k in range(w.first[d], w.first[d + 1])]
        assert [got[k] for k in range(len(texts))] == [brute.words(t) for t in texts]


def twins():
    """Two words of 1,024 letters that share every hash that is a polynomial modulo 2**64 with an odd base."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_words_with_one_polynomial_hash_are_told_apart(spark):
    a, b = twins()
    filler = [f"f{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join([*filler[:20], a, *filler[20:]])), (2, " ".join([*filler[:20], b, *filler[20:]])), (3, a), (4, b)], "doc_id long, text string")
    assert rows(op3_substring_dedup.substring_dedup(docs, 35), "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 0), (4, 0)]
    assert rows(op5_minhash_forest.near_dedup(docs.where("doc_id > 2"), 3, 85), "doc_id", "component_id") == [(3, 3), (4, 4)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB é日", min_size=0, max_size=40), max_size=20), st.integers(1, 5))
def test_hashes_tell_words_and_windows_apart(texts, width):
    import pyarrow as pa

    texts = [*texts, "x" * 300 + " " + "x" * 301 + " " + "X" * 300]
    for lower in (False, True):
        for which in (0, 1):
            seen = {}
            for i, j, w in textkit.column_words(pa.array(texts)):
                h = w.hashes(lower)
                win, at = textkit.rolling(h, w.first, width, which)
                doc = w.docs()
                for x, k in zip(win.tolist(), at.tolist(), strict=True):
                    own = brute.words(texts[i + doc[k]])[k - w.first[doc[k]] :][:width]
                    seen.setdefault(x, set()).add(tuple(map(brute.lower, own)) if lower else tuple(own))
            assert all(len(x) == 1 for x in seen.values())
            assert sum(map(len, seen.values())) == len(set().union(*seen.values(), set()))


def test_substring_dedup(mixed_docs, edge, empty):
    want = sorted(brute.substring_dedup(pairs(mixed_docs)), key=repr)
    assert rows(op3_substring_dedup.substring_dedup(mixed_docs, 35, keep_text=False), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert any(r[2] for r in want)
    out = op3_substring_dedup.substring_dedup(edge, 35)
    assert {brute.sha(r["kept_text"]) for r in out.collect()} == {r[3] for r in brute.substring_dedup(pairs(edge))}
    assert op3_substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_with_many_blocks(mixed_docs, monkeypatch):
    monkeypatch.setattr(op3_substring_dedup, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(op3_substring_dedup, "BUCKET_BYTES", 60_000)
    got = rows(op3_substring_dedup.substring_dedup(mixed_docs, 20, keep_text=False), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring_dedup(pairs(mixed_docs), 20), key=repr)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_dedup(mixed_docs, width, percent):
    got = rows(op5_minhash_forest.near_dedup(mixed_docs, width, percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_dedup(pairs(mixed_docs), width, percent), key=repr)
    assert sum(not r[3] for r in got) > 5


def test_near_dedup_edges(edge, empty):
    got = rows(op5_minhash_forest.near_dedup(edge, 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_dedup(pairs(edge), 3, 85), key=repr)
    assert op5_minhash_forest.near_dedup(empty, 3, 85).count() == 0


def test_near_dedup_of_a_crowded_group(spark):
    """A star: copies of one text, each with other words changed, which are often not similar to each other."""
    import random

    rng = random.Random(1)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    docs = [(0, " ".join(base))]
    for k in range(1, 300):
        own = base[:]
        for at in rng.sample(range(200), 4):
            own[at] = f"x{rng.randint(0, 10**9)}"
        docs.append((k, " ".join(own)))
    got = rows(op5_minhash_forest.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_dedup(docs, 3, 85), key=repr)
    assert {r[2] for r in got} == {0}


@pytest.mark.parametrize("crowd", [4096, 20])
def test_near_dedup_of_a_template(spark, monkeypatch, crowd):
    """Many texts about as similar to each other as the threshold, so that some links exist and most do not."""
    import random

    monkeypatch.setattr(op5_minhash_forest, "CROWD", crowd)
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    docs = []
    for k in range(250):
        own = base[:]
        for at in rng.sample(range(200), rng.choice([2, 3, 4, 5, 6])):
            own[at] = f"x{rng.randint(0, 10**9)}"
        docs.append((k, " ".join(own)))
    got = rows(op5_minhash_forest.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    want = sorted(brute.near_dedup(docs, 3, 85), key=repr)
    assert 10 < len({r[2] for r in want}) < 240
    assert got == want


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Repeated rows, rows that share an id, and null ids."""
    import corpus_pipeline

    text = lambda a: " ".join(f"{a}{k}" for k in range(120))
    near = text("a").replace("a119", "other")
    docs = [(7, text("a")), (7, text("a")), (9, near), (None, near), (None, text("b")), (None, text("b")), (None, ""), (None, None), (5, ""), (3, text("c")), (3, text("d"))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = [(7, text("a")), (None, text("b")), (None, ""), (None, None), (5, ""), (3, text("c")), (3, text("d"))]
    assert rows(corpus_pipeline.near_dups(spark, df, ""), "doc_id", "text") == sorted(want, key=repr)


def walked_crowds(key, sizes):
    """The names of the crowds that _walk passes on, for partitions of so many classes of one key."""
    import pyarrow as pa

    found = set()
    for part, n in enumerate(sizes):
        rest = pa.array([bytes([part, k // 256, k % 256, 0, 0, 0, 0, 0]) for k in range(n)], pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array([key] * n), rest, pa.array([part * 10_000 + k for k in range(n)]), pa.array([100] * n)], ["key", "rest", "cid", "n"])
        for out in op5_minhash_forest._walk(0.85)(iter([batch])):
            found |= {(c, a) for c, a in zip(out["crowd"].to_pylist(), out["a"].to_pylist(), strict=True) if c is not None}
    return found


def test_near_dedup_names_a_crowd_alike_in_all_partitions(monkeypatch):
    """One partition holds more rows of the key than a block, the next one fewer."""
    monkeypatch.setattr(op5_minhash_forest, "CROWD", 20)
    found = walked_crowds(1600, (60, 12))
    assert {c for c, _ in found} == {1600} and len(found) == 72


@pytest.mark.parametrize("tree", range(op5_minhash_forest.TREES))
def test_near_dedup_passes_crowds_on_in_every_tree(tree):
    assert {c for c, _ in walked_crowds(1600 + tree, (60,))} == {1600 + tree}


def test_near_dedup_settles_whatever_the_signatures_say():
    """A link at the threshold whose signatures agree nowhere, and a class whose size alone excludes its region's other ones."""
    import pyarrow as pa

    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base[:40])]
    cid = []
    for _, _, w in textkit.column_words(pa.array(texts)):
        cid += op5_minhash_forest._class_ids(*op5_minhash_forest._sets(w, 3), len(texts))[2].tolist()
    tables = [pa.table({"cid": [c], "label": [c], "sig": [bytes([k]) * 224], "text": [t]}) for k, (c, t) in enumerate(zip(cid, texts, strict=True))]
    settle = op5_minhash_forest._settle(3, 85)
    assert settle(tables[0], tables[1]).to_pylist() == [{"a": cid[0], "b": cid[1]}]
    assert settle(tables[0], tables[2]).num_rows == 0


def test_line_dedup(mixed_docs, edge, empty):
    got = rows(op8_line_dedup.line_dedup(mixed_docs), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == sorted(brute.line_dedup(pairs(mixed_docs)), key=repr)
    assert any(r[2] for r in got)
    assert rows(op8_line_dedup.line_dedup(edge, batches=5, fanout=2), "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(brute.line_dedup(pairs(edge)), key=repr)
    assert op8_line_dedup.line_dedup(empty).count() == 0


def test_substring_dedup_where_blocks_share_partitions(spark, monkeypatch):
    """Many blocks and buckets, more than there are partitions."""
    for name, value in (("BLOCK_BYTES", 4000), ("BUCKET_BYTES", 4000), ("PARTITIONS", 3)):
        monkeypatch.setattr(op3_substring_dedup, name, value)
    passage = " ".join(f"p{k}" for k in range(80))
    docs = [(k, f"{' '.join(f'w{k}x{j}' for j in range(40))} {passage if k % 3 else ''} tail {k}") for k in range(60)]
    got = rows(op3_substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), keep_text=False), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring_dedup(docs), key=repr) and any(r[2] for r in got)


def test_line_dedup_compacts_runs_by_default(mixed_docs, monkeypatch):
    """Runs are compacted with the parameters of production, and the number of batches follows the rows."""
    made, init = [], op8_line_dedup.LineRuns.__init__
    monkeypatch.setattr(op8_line_dedup.LineRuns, "__init__", lambda self, *a: (init(self, *a), made.append(self))[0])
    got = rows(op8_line_dedup.line_dedup(mixed_docs), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == sorted(brute.line_dedup(pairs(mixed_docs)), key=repr)
    assert [len(x) for x in made[0].levels] == [1, 1]
    assert [op8_line_dedup.n_batches(n) for n in (0, 1 << 20, 16 << 20, 1 << 40)] == [5, 5, 8, 16]


def test_line_runs_are_merged_without_a_shuffle(spark):
    """Only the batch's own lines are shuffled; the runs and their deltas are read in their buckets."""
    runs = op8_line_dedup.LineRuns(4)
    keys = spark.range(1000).selectExpr("id % 50 AS k1", "id % 7 AS k2", "id AS doc_id")
    for k in range(2):
        runs.add(keys.where(f"doc_id % 2 = {k}"))
    plan = runs._owner(keys.groupBy("k1", "k2").agg({"*": "count"}).selectExpr("k1", "k2", "`count(1)` AS n", "0L AS keeper"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 2
    assert "Exchange" not in runs.runs()[0].total()._jdf.queryExecution().executedPlan().toString()
    runs.drop()


def test_the_anti_join_decides(mixed_docs, monkeypatch):
    """Without it, lines stand in several runs, none of which has their count or alone their keeper."""
    want = sorted(brute.line_dedup(pairs(mixed_docs)), key=repr)
    columns = ("doc_id", "n_lines", "n_dropped", "kept_text")
    assert rows(op8_line_dedup.line_dedup(mixed_docs), *columns) == want
    from pyspark.sql import functions as F

    monkeypatch.setattr(op8_line_dedup.LineRuns, "_owner", lambda self, own: own.withColumn("owner", F.lit(op8_line_dedup.NEW)))
    assert rows(op8_line_dedup.line_dedup(mixed_docs), *columns) != want


def test_every_line_is_in_one_run(spark):
    runs = op8_line_dedup.LineRuns(4, fanout=3)
    keys = spark.range(3000).selectExpr("id % 37 AS k1", "id % 11 AS k2", "5000 - id AS doc_id")
    for k in range(7):
        runs.add(keys.where(f"int(({'5000 - doc_id'}) / 430) = {k}"))
        held = [r for x in runs.runs() for r in rows(x.lines(), "k1", "k2")]
        assert len(held) == len(set(held))
    want = {(r["k1"], r["k2"]): (r["n"], r["keeper"]) for r in keys.where("5000 - doc_id < 3010").groupBy("k1", "k2").agg({"*": "count", "doc_id": "max"}).toDF("k1", "k2", "n", "keeper").collect()}
    assert {(r["k1"], r["k2"]): (r["n"], r["keeper"]) for r in runs.merged().collect()} == want and [len(x) for x in runs.levels] == [1, 2]


def test_line_dedup_of_common_lines(spark, monkeypatch):
    """The same rows whether lines are met by broadcast or by a shuffled join, and with lines of one document in any number."""
    import random

    rng = random.Random(6)
    pool = [f"a line that is long enough, number {k}" for k in range(40)]
    docs = [(k if k % 9 else None, "\n".join(rng.choice(pool[: 1 + k % 40]) for _ in range(rng.randint(0, 30)))) for k in range(150)]
    docs.append((500, "\n".join(pool * 300)))
    df, want = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), sorted(brute.line_dedup(docs), key=repr)
    for hot in (1, 20, 10_000):
        monkeypatch.setattr(op8_line_dedup, "HOT", hot)
        assert rows(op8_line_dedup.line_dedup(df), "doc_id", "n_lines", "n_dropped", "kept_text") == want


def test_kept_columns_of_any_name_come_through(mixed_docs):
    """Columns that are named like an operator's own, inside or in the result."""
    from mnemoflow.llm import op10_mixing
    from .conftest import CLASH

    keep = tuple(CLASH)
    n = mixed_docs.count()
    want = mixed_docs.where("key = 'clash'").count()
    for out in (op1_pii.find_pii(mixed_docs, keep), op7_quality_rules.quality_rules(mixed_docs, keep=keep), op8_line_dedup.line_dedup(mixed_docs, keep=keep), op10_mixing.mix(mixed_docs, keep=keep)):
        names = [c if c in out.columns and f"{c}_in" not in out.columns else f"{c}_in" for c in keep]
        assert set(names) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        got = out.select(*[f"`{c}`" for c in names]).collect()
        assert len(got) == n and sum(all(x == "clash" for x in r) for r in got) == want


def test_line_runs_are_compacted(spark):
    runs = op8_line_dedup.LineRuns(3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 10 - k), (k, 7, 10 - k)], "k1 long, k2 long, doc_id long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {(r["k1"], r["k2"]): (r["n"], r["keeper"]) for r in runs.merged().collect()}
    assert got[1, 1] == (5, 10) and got[3, 7] == (1, 7)


def test_runs_are_written_by_few_tasks(spark):
    """With many shuffle partitions a run still has a few files for each bucket."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        runs = op8_line_dedup.LineRuns(4)
        for k in range(2):
            runs.add(spark.range(2000).selectExpr("id * 7 % 2000 AS k1", "id % 7 AS k2", f"id + {k} AS doc_id"))
        assert all(len(t.df.inputFiles()) <= 4 * 4 for t in runs.tables)
        assert {(r["n"]) for r in runs.merged().collect()} == {2}
    finally:
        for c, x in old.items():
            spark.conf.set(c, x)


def test_quality_rules(mixed_docs, empty):
    got = {}
    for r in op7_quality_rules.quality_rules(mixed_docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in pairs(mixed_docs):
        w = brute.words(t)
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        n = brute.repeat_words(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w))
        assert want in [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got[i]], (i, want)
    kept = [r["kept"] for rs in got.values() for r in rs]
    assert any(kept) and not all(kept) and not any(r["kept"] and r["base_failed"] for rs in got.values() for r in rs)
    assert op7_quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_are_one_projection(mixed_docs):
    plan = op7_quality_rules.quality_rules(mixed_docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Python" not in plan


def test_pii(mixed_docs, empty):
    got = {}
    from pyspark.sql import functions as F

    out = op1_pii.find_pii(mixed_docs).select("doc_id", op1_pii._written(F.col("base")).alias("b"), op1_pii._written(F.col("found")).alias("f"))
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in pairs(mixed_docs):
        assert brute.pii(t)[1] in [r["b"] for r in got[i]], i
    assert all(set(filter(None, r["b"].split(","))) <= set(r["f"].split(",")) for rs in got.values() for r in rs)
    assert op1_pii.find_pii(empty).count() == 0


def test_pii_base_patterns_on_awkward_texts(spark):
    import random

    rng = random.Random(5)
    pieces = ["a@b.c", "x.y@z-1.co.uk", "1.2.3.4", "255.255.255.256", "4111111111111111", "4111-1111 1111-1111", "+12 (3) 456-7890", "+1", "@", ".", " ", "-", "9", "é", "😀", "a@b", "++1 22", "00001.2.3.4.5", "\n"]
    docs = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for k in range(300)] + [(1000, "a" * 50_000), (1001, "1." * 20_000), (1002, "a@b" + ".c" * 20_000), (1003, "7" * 30_000), (1004, "+1" + "(" * 20_000)]
    from pyspark.sql import functions as F

    out = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", op1_pii._written(op1_pii.base_spans(op1_pii.raw_spans(F.col("text")))).alias("b")).collect()
    want = {i: brute.pii(t)[1] for i, t in docs}
    assert {r["doc_id"]: r["b"] for r in out} == want
    assert sum(map(bool, want.values())) > 100


def test_pii_em_and_classifier():
    votes = {(1, 1, 1, 1, 1): 50, (1, 1, 0, 1, 1): 50, (-1, -1, 0, 1, -1): 80, (-1, -1, -1, -1, 1): 40, (-1, 1, 0, 1, 1): 5}
    p = op1_pii.em(votes)
    want = brute.em(votes)
    assert all(abs(p[v] - want[v]) < 1e-9 for v in votes)
    assert p[1, 1, 0, 1, 1] > 0.9 and p[-1, -1, 0, 1, -1] < 0.1
    w = op1_pii.train_classifier([((*v, 0, 0, 2), p[v], n) for v, n in votes.items()])
    assert w["regex", 1] > 0 > w["regex", -1]


def test_pii_adds_what_the_labelers_agree_on(spark):
    """Secrets are added and numbers that only look like cards are not; base spans stay."""
    import random

    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    docs = []
    for k in range(200):
        kind, own = k % 5, "some words before "
        if kind == 0:
            own += f'token = "{rng.getrandbits(160):040x}" and after'
        elif kind == 1:
            own += f"api_key: {''.join(rng.choice('abcdefghijkLMNOPQRST0123456789') for _ in range(30))}Z9 then"
        elif kind == 2:
            card = "4" + digits(14)
            own += card + next(str(x) for x in range(10) if brute.luhn(card + str(x))) + " paid"
        elif kind == 3:
            card = "9" + digits(14)
            own += card + next(str(x) for x in range(10) if not brute.luhn(card + str(x))) + " counted"
        else:
            own += "Note: internationalisation, see https://example/path-of-things, id: abcdefghijklmnop"
        docs.append((k, own))
    out = op1_pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    texts = dict(docs)
    for r in out:
        got = [(x["s"], x["e"]) for x in r["found"] if x["k"] == len(op1_pii.KINDS)]
        assert got == brute.secrets(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert [x for x in r["found"] if x["k"] < len(op1_pii.KINDS)] == r["base"]
    assert sum(bool(brute.secrets(t)) for t in texts.values()) == 80


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op6_bpe_tree.default_vocabulary()[0])


def test_bpe_equals_the_library(mixed_docs, empty, library):
    got = {}
    for r in op6_bpe_tree.bpe(mixed_docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], list(r["ids"]), r["decoded"]))
    for i, t in pairs(mixed_docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (len(ids), ids, library.decode(ids, skip_special_tokens=False)) in got[i], i
    assert op6_bpe_tree.bpe(empty).count() == 0


def test_bpe_by_leaves(mixed_docs, library):
    """Long texts as rows of leaves, joined: the library's ids, and joins where tokens had to change."""
    docs = mixed_docs.union(mixed_docs.where("length(text) > 5000"))
    got = sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in op6_bpe_tree.bpe(docs, leaf=300).collect()), key=repr)
    want = []
    for i, t in pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    some = op6_bpe_tree.bpe(docs, leaf=300, digests=True).agg({"n_leaves": "sum", "n_mended": "sum"}).first()
    assert some["sum(n_leaves)"] > 2 * docs.count() and some["sum(n_mended)"] > 100


def test_bpe_joins_leaves_in_the_query(spark):
    """With the parameters of production."""
    out = op6_bpe_tree.query(spark, "/root/testdata/sf0.01").agg({"n_leaves": "max", "n_mended": "sum", "doc_id": "count"}).first()
    assert out["max(n_leaves)"] > 1 and out["sum(n_mended)"] > 0 and out["count(doc_id)"] == 1000


PIECES = ["a", "b", "th", "e", " ", "  ", "\n", "\n\n ", "'s", "'ll", "'", "l", "<|endoftext|>", "<|", "é", "日本", "😀", "12", "!!", "...", "\t", "don't "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.sampled_from([3, 7, 40]))
def test_bpe_joins_are_exact(pieces, leaf):
    c, text = op6_bpe_tree.codec(*op6_bpe_tree.default_vocabulary()), "".join(pieces)
    parts = c.halves(text, leaf)
    found = c.concatenated([c.encode_pieces(p) for p in parts])
    assert "".join(parts) == text and found.ids == c.encode(text) and sum(found.counts) == len(found.ids)


def test_bpe_joins_of_long_unsplit_text():
    import random

    rng, c = random.Random(2), op6_bpe_tree.codec(*op6_bpe_tree.default_vocabulary())
    for text in ("a" * 20_000, "日本語" * 5000, "ab" * 9001 + "c", " " * 9000 + "x", "\n" * 5000 + "y" * 7000 + " " * 3000, "".join(rng.choice("thein") for _ in range(30_000))):
        assert c.concatenated([c.encode_pieces(p) for p in c.halves(text, 2500)]).ids == c.encode(text)


def test_bpe_of_long_unsplit_text(library):
    import random

    c = op6_bpe_tree.codec(*op6_bpe_tree.default_vocabulary())
    rng = random.Random(2)
    for text in ("a" * 20_000, "".join(rng.choice("abcdeé") for _ in range(30_000)), "日本語" * 5000, "ab" * 9001 + "c", "".join(rng.choice("thein") for _ in range(50_000)), "=" * 7777):
        ids = library.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == ids and c.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé \n'sl1<|endoftext>", max_size=200))
def test_bpe_by_halves(text):
    from tokenizers import Tokenizer

    c = op6_bpe_tree.codec(*op6_bpe_tree.default_vocabulary())
    data = text.encode()
    if data:
        assert op6_bpe_tree.encode_tree(data, c.raw, c.words.__getitem__, leaf=3) == c.raw(data)
    library = Tokenizer.from_file(op6_bpe_tree.default_vocabulary()[0])
    assert c.encode(text) == library.encode(text, add_special_tokens=False).ids
