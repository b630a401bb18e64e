"""Search, classifier, archives, mixing and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from .conftest import SF, rows

from . import brute
from mnemoflow.llm import op2_topk, op4_quality_classifier, op9_warc, op10_mixing
from mnemoflow.llm.scratch import new_folder


def plain_topk(vectors, queries, k):
    out = []
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in itertools.zip_longest(x, y, fillvalue=0)), i) for i, y in vectors if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,n", [(5, 700), (3, 4), (1, 1)])
def test_topk(spark, k, n):
    rng = random.Random(k)
    vectors = [(i, [rng.randint(-3, 3) * (1 + 100 * (j % 5 == 0)) for j in range(19)]) for i in range(n)]
    df = spark.createDataFrame([(*v, "clash") for v in vectors], "vec_id long, vector array<long>, score string").repartition(3)
    got = sorted(tuple(r) for r in op2_topk.topk(df, df.where("vec_id % 7 = 0"), k).collect())
    assert got == plain_topk(vectors, [v for v in vectors if v[0] % 7 == 0], k)


def test_topk_of_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(op2_topk, "WAVE", 2)
    raw = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [-1.0, -0.001]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame(raw, "vec_id long, embedding array<double>").select("vec_id", op2_topk.quantised(__import__("pyspark").sql.functions.col("embedding")).alias("vector"))
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in raw if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = sorted(tuple(r) for r in op2_topk.topk(df, df.where("vec_id IN (0, 5, 6, 8)"), 5).collect())
    assert got == plain_topk(fine, [v for v in fine if v[0] in (0, 5, 6, 8)], 5)
    assert op2_topk.topk(df.where("false"), df, 5).count() == 0 and op2_topk.topk(df, df.where("false"), 5).count() == 0


def test_topk_of_large_components(spark):
    vectors = [(i, [(2**28) * (i + 1), 3 - i]) for i in range(6)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    assert sorted(tuple(r) for r in op2_topk.topk(df, df, 2).collect()) == plain_topk(vectors, vectors, 2)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = op4_quality_classifier.train(docs, labels.where("doc_id % 2 = 0"), 1500)
    held = op4_quality_classifier.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = held.quality == 1
    assert held.kept[good].mean() > 0.99 and held.kept[~good].mean() < 0.1
    again = op4_quality_classifier.classify(docs, op4_quality_classifier.train(docs, labels.where("doc_id % 2 = 0").repartition(7), 1500)).limit(50)
    want = {r["doc_id"]: r["score"] for r in again.collect()}
    assert all(abs(want[i] - s) < 1e-9 for i, s in zip(held.doc_id, held.score, strict=True) if i in want)


def test_co_training_uses_the_other_view():
    """Few labels; the second view settles the others, and its labels teach the first."""
    rng = np.random.default_rng(0)
    n = 1500
    y = rng.integers(0, 2, n).astype(float)
    text = np.concatenate([y[:, None] * 1.2 + rng.normal(0, 1, (n, 1)), rng.normal(0, 1, (n, 30))], 1)
    meta = y[:, None] * 8 + rng.normal(0, 1, (n, 1))
    model = brute.co_train(text[:40], meta[:40], y[:40], text[40:], meta[40:], np.arange(n - 40), 2)
    alone = op4_quality_classifier.Logistic.fit(text[:40], y[:40])
    both, _, combined = model.score(text[40:], meta[40:])
    acc = lambda p: ((p > 0.5) == y[40:]).mean()
    assert acc(model.text.logit(text[40:]) + 0.5) > acc(alone.logit(text[40:]) + 0.5)
    assert acc(combined) > 0.97 and len(both) == n - 40


def test_classifier_equals_one_on_arrays(spark):
    """The rounds over all documents in Spark against the same rounds on arrays."""
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = op4_quality_classifier.train(docs.repartition(5), labels)
    got = {r["doc_id"]: r["score"] for r in op4_quality_classifier.classify(docs, model).collect()}
    rows_ = docs.withColumn("h", F.xxhash64(F.lit(29), "doc_id")).join(labels, "doc_id", "left").orderBy("doc_id").toArrow()
    text = np.concatenate([op4_quality_classifier.text_features(w) for _, _, w in op4_quality_classifier.column_words(rows_["text"])])
    meta = op4_quality_classifier.meta_features(*(rows_[c].to_pylist() for c in ("lang", "source", "n_chars")))
    y = np.array([np.nan if q is None else q for q in rows_["quality"].to_pylist()], float)
    known = np.flatnonzero(~np.isnan(y))
    mixed, free = known[np.random.default_rng(11).permutation(len(known))], np.flatnonzero(np.isnan(y))
    plain = brute.co_train(text[mixed], meta[mixed], y[mixed], text[free], meta[free], rows_["h"].to_numpy()[free], op4_quality_classifier.ROUNDS)
    want = dict(zip(rows_["doc_id"].to_pylist(), plain.score(text, meta)[2].tolist(), strict=True))
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (None, 1, 0), (9, None, 0), (8, 0, 1), (15, 1, 0)], "doc_id long, quality int, toxic int")
    model = op4_quality_classifier.train(edge, labels)
    out = op4_quality_classifier.classify(edge, model).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert op4_quality_classifier.train(edge, labels.where("quality = 1")) is None
    assert all(r["score"] == 1 for r in op4_quality_classifier.classify(edge, None).collect())
    assert op4_quality_classifier.train(empty, labels) is None and op4_quality_classifier.classify(empty, model).count() == 0


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b c\n", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "long " * 200_000), (6, "http://f", "é\r\n\r\nbody"), (None, "http://g", "<p>x</p>"), (None, "http://h", "only null"), (7, "http://i", "é\r\n\r\nbody"), (1, "http://a", "<p>x</p>")]


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(op9_warc, "FRAME_BYTES", 500)
    monkeypatch.setattr(op9_warc, "BUNDLE_BYTES", 2000)
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, key string, first string")
    folder = new_folder(spark, "test")
    index = op9_warc.write_archive(pages, folder)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) if r["page_id"] is not None else (-1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op9_warc.read_archive(index, folder).collect())
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        f = first.get(h or "")
        data = (h or "").encode()
        want.append((-1 if i is None else i, len(data), op9_warc.payload_digest(data), "response" if i == f else "revisit", None if i == f else f))
    assert got == sorted(want, key=lambda r: r)
    texts = {r["page_id"]: r["payload"] for r in op9_warc.read_archive(index, folder).where("record_type = 'response'").collect()}
    assert texts[5] == PAGES[4][2] and texts[6] == PAGES[5][2]
    one = op9_warc.read_archive(index.where("page_id = 6"), folder).collect()
    assert [r["payload"] for r in one] == [PAGES[5][2]]
    ids = [r["record_id"] for r in index.collect()]
    assert len(ids) == len(PAGES) and len(set(ids)) == len(set(PAGES))
    again = op9_warc.write_archive(pages.repartition(7), new_folder(spark, "test"))
    assert {(r["record_id"], r["page_id"]) for r in again.collect()} == {(r["record_id"], r["page_id"]) for r in index.collect()}
    wanted = op9_warc.record_id(None, "http://h", op9_warc.payload_digest(b"only null"))
    assert [r["payload"] for r in op9_warc.read_archive(index.where(index.record_id == wanted), folder).collect()] == ["only null"]


def test_bundles_are_plain_zstandard(spark, tmp_path):
    import pyarrow.fs as pafs
    import zstandard

    fs = pafs.LocalFileSystem()
    w = op9_warc.BundleWriter(fs, str(tmp_path / "b.zst"))
    records = [op9_warc.record(k, f"http://x/{k}", b"p" * (k * 5000), k * 5000, "D", None, "urn:o") for k in range(120)]
    places = [w.add(r) for r in records]
    w.close()
    raw = (tmp_path / "b.zst").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(records)
    r = op9_warc.BundleReader(fs, str(tmp_path / "b.zst"))
    for k in (119, 0, 57):
        frame, start, length = places[k]
        assert r.frame(frame)[start : start + length] == records[k]
        assert op9_warc.parse(records[k])[1] == b"p" * (k * 5000)


def test_small_payloads_can_stay_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = new_folder(spark, "test")
    out = op9_warc.read_archive(op9_warc.write_archive(pages, folder, least_bytes=9), folder).collect()
    assert len(out) == len(PAGES) and {(r["page_id"], r["record_type"]) for r in out if r["payload_bytes"] >= 9} == {(5, "response"), (6, "response"), (7, "revisit"), (None, "response")}
    assert all(r["record_type"] == "response" for r in out if r["payload_bytes"] < 9)
    assert op9_warc.archive(pages.where("false")).count() == 0


def test_fit_reaches_the_budget_where_it_can_be_reached():
    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 6)))
        counts = [rng.randint(1, 4) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts, strict=True))
        budget = rng.randint(0, total + 5)
        taken = op10_mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        got = sum(a * b for a, b in zip(lengths, taken, strict=True))
        assert got <= budget
        # With the even share fixed, no choice of the rest comes nearer.
        share = [c * budget // total for c in counts] if total > budget else counts
        best = max(sum(a * b for a, b in zip(lengths, x, strict=True)) for x in itertools.product(*[range(s, c + 1) for s, c in zip(share, counts, strict=True)]) if sum(a * b for a, b in zip(lengths, x, strict=True)) <= budget)
        assert got == best
    big = op10_mixing.fit(list(range(1, 3000)), [50] * 2999, 100_000_001)
    assert sum(a * b for a, b in zip(range(1, 3000), big, strict=True)) == 100_000_001


def test_mixing(spark, mixed_docs, edge, empty):
    for docs in (mixed_docs, edge):
        got = op10_mixing.mix(docs, keep_source=True).collect()
        words = {}
        for r in docs.select("doc_id", "text").collect():
            words.setdefault(r["doc_id"], set()).add(len(brute.words(r["text"])))
        assert all(r["size"] in words[r["doc_id"]] for r in got) and len(got) == docs.count()
        total = sum(r["size"] for r in got)
        by = {}
        for r in got:
            by.setdefault(r["source"], []).append(r)
        names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [s for s in by if s is None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        size = {s: sum(r["size"] for r in by[s]) for s in by}
        target, left, free = {}, 1.5 * total, set(by)
        while True:
            level = left / sum(weight[s] for s in free)
            full = {s for s in free if weight[s] * level > 2 * size[s]}
            if not full:
                break
            for s in full:
                target[s] = 2.0 * size[s]
                left -= target[s]
            free -= full
        target |= {s: weight[s] * level for s in free}
        for s, rs in by.items():
            assert all(abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and r["source_size"] == size[s] for r in rs)
            assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rs)
            longest = max(r["size"] for r in rs)
            assert abs(sum(r["taken"] for r in rs) - target[s]) <= max(1, longest)
        again = rows(op10_mixing.mix(docs.repartition(5)), "doc_id", "size", "taken")
        assert again == rows(op10_mixing.mix(docs), "doc_id", "size", "taken")
    assert op10_mixing.mix(empty).count() == 0


def test_pipeline(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from mnemoflow.llm.op6_bpe_tree import default_vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "mixing", "bpe"]
    kept = stages["quality classifier"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    lines = stages["line dedup"](spark, kept, SF).cache()
    assert lines.columns == docs.columns
    assert rows(lines, "doc_id", "text") == sorted(((i, t) for i, _, _, t in brute.line_dedup(before)), key=repr)
    before = [(r["doc_id"], r["text"]) for r in lines.collect()]
    near = stages["near dedup"](spark, lines, SF).cache()
    assert near.columns == docs.columns
    assert [x for (x,) in rows(near, "doc_id")] == sorted((i for i, _, _, k in brute.near_dedup(before, 5, 80) if k), key=repr)
    mixed = stages["mixing"](spark, near, SF).cache()
    assert mixed.columns == docs.columns and mixed.exceptAll(near.union(near)).isEmpty()
    library = Tokenizer.from_file(default_vocabulary()[0])
    out = stages["bpe"](spark, mixed, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(out) == mixed.count()
    for r in out:
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["decoded"] == texts[r["doc_id"]]
    whole = corpus_pipeline.run(spark, SF)
    assert rows(whole, "doc_id", "n_tokens") == sorted(((r["doc_id"], r["n_tokens"]) for r in out), key=repr)


def test_mixing_takes_what_a_plain_version_takes(spark, mixed_docs):
    """The same choice by lists: passes, the fit by lengths, and the documents of a length in the order of their hash."""
    from pyspark.sql import functions as F

    h = F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text"))
    docs = [(r["doc_id"], r["source"], len(brute.words(r["text"])), r["h"]) for r in mixed_docs.select("doc_id", "source", "text", h.alias("h")).collect()]
    got = op10_mixing.mix(mixed_docs, keep_source=True).collect()
    target = {r["source"]: r["target"] for r in got}
    want = []
    for source, t in target.items():
        own = [(i, n, x) for i, s, n, x in docs if s == source]
        size = sum(n for _, n, _ in own)
        passes = min(2, int(t // size)) if size else 0
        lengths = sorted({n for _, n, _ in own})
        extra = dict(zip(lengths, op10_mixing.fit(lengths, [sum(n == k for _, n, _ in own) for k in lengths], max(0, round(t - passes * size))), strict=True))
        for n in lengths:
            same = sorted(((x % 64, x, i is not None, i or 0, i) for i, k, x in own if k == n))
            want += [(i, source, n * (passes + (k < extra[n]))) for k, (*_, i) in enumerate(same)]
    assert rows(op10_mixing.mix(mixed_docs, keep_source=True), "doc_id", "source", "taken") == sorted(want, key=repr)


def test_mixing_ranks_many_sources_by_code_point(spark):
    names = [chr(c) + x for c in (0x1F600, 0xE9, 0x7A, 0x41, 0xFFFD) for x in ("", "1", "2", "10")] + [None, ""]
    docs = spark.createDataFrame([(k, "w " * (5 + k % 7), s, "clash") for k, s in enumerate(names * 8)], "doc_id long, text string, source string, part string").repartition(6)
    sizes = docs.groupBy("source").agg({"doc_id": "count"}).selectExpr("source", "`count(doc_id)` * 100 AS source_size")
    got = {r["source"]: r["weight"] for r in op10_mixing.targets(sizes, (5, 2, 1), 0.5, 2).selectExpr("source", "target / 100 AS weight").collect()}
    order = [*sorted((x for x in names if x is not None), key=lambda x: x.encode()), None]
    assert [round(got[s] / min(got.values())) for s in order] == [(5, 2, 1)[k % 3] for k in range(len(order))]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_edges(spark, edge, empty, stage):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table, for each stage alone."""
    import corpus_pipeline

    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, edge, SF)
    n, got = edge.count(), out.count()
    assert got <= 2 * n and (stage > 1 or got <= n)
    if stage < 4:
        assert out.columns == list(corpus_pipeline.COLUMNS)
    if stage == 1:
        assert got == n
    if stage == 2:
        texts = [t for _, t in rows(out, "doc_id", "text")]
        assert sum(not brute.words(t) for t in texts) == sum(not brute.words(t) for _, t in rows(edge, "doc_id", "text"))
    if stage == 4:
        assert got == n
    assert f(spark, empty, SF).count() == 0


def test_fit_has_no_preference_for_length_at_any_size():
    """Many lengths that one document each has: short ones are taken as often as long ones, and the budget is met."""
    from mnemoflow.llm import op10_mixing

    for lengths, count in ((list(range(1, 20_000, 7)), 1), (list(range(20_000, 0, -3)), 1), ([*range(1, 5000)], 3)):
        counts = [count] * len(lengths)
        total = count * sum(lengths)
        for budget in (total // 2, total // 3, total * 9 // 10):
            taken = op10_mixing.fit(lengths, counts, budget)
            assert all(0 <= t <= n for t, n in zip(taken, counts, strict=True))
            assert sum(a * t for a, t in zip(lengths, taken, strict=True)) == budget
            by = sorted(zip(lengths, taken, strict=True))
            parts = [sum(t for _, t in by[k * len(by) // 4 : (k + 1) * len(by) // 4]) / (count * len(by) / 4) for k in range(4)]
            assert max(abs(x - budget / total) for x in parts) < 0.03, parts
