import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = [
    "block", "key", "n", "size", "h", "slice", "first", "t", "kept", "cid", "sig", "vector", "base", "raw", "m", "label", "rank", "times", "drops", "line", "bundle",
    "row", "bytes", "batch", "pos", "k1", "changed", "d_id", "found", "leaf", "ids", "quality", "view", "n_words", "source_size", "target", "n_dropped", "carried columns",
]


def edge_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    long = " ".join(word() for _ in range(6000))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(120)]
    near = base[:]
    near[50] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "one"), (5, "two words"), (6, long), (7, "x" * 9000), (8, passage), (9, "start " + passage + " end"), (10, passage + "\n" + passage),
        (11, " ".join(base)), (12, " ".join(near)), (13, " ".join(base).upper()), (14, "a b c d e f g " * 30), (None, "A row without an id, but with a text of its own."), (None, None),
        (15, "repeated row of some words"), (15, "repeated row of some words"), (16, "Shared boilerplate line, long enough.\nown 16"), (17, "  shared BOILERPLATE line, long enough.\t\nown 17"), (18, "own 18\nshared boilerplate line, long enough."),
        (19, "naïve café — ünïcödé   non breaking 日本語 text 😀"), (20, "<|endoftext|> inside <|endoftext|>"), (21, "a\u0000b\u001cc"), (22, "\n\n\n"),
        (23, "mail a.b@c.de, ip 1.2.3.4, card 4111 1111 1111 1111, tel +1 (234) 555-0199."), (24, "999.1.1.1 4111111111111112 +1 2 a@b"),
    ]
    return [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if k % 4 == 0 else len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), DOCS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="session")
def mixed_docs(spark, edge):
    """The edge cases and a whole small table, with the clashing columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return edge.unionByName(docs.withColumn("doc_id", docs.doc_id + 1000), allowMissingColumns=True).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
