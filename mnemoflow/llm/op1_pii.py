"""Personal data by weak supervision, in DataFrame functions alone.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; wider patterns propose more
spans, also secrets (keys, tokens, passwords). Labelers vote on each candidate, base span or not: a
strict regular expression or checksum of its kind, gazetteers (top-level domains, issuer prefixes,
country codes, reserved networks, key prefixes and digest lengths), words of the context before it, its
neighbours and its form. None of them knows whether a span is of the base. Votes are counted by pattern
in Spark; expectation-maximisation over that bounded table estimates each labeler's reliability and a
probability for each pattern of votes; these soft labels train a logistic span classifier on the votes
and on the span's shape. It is compiled into a Spark expression, which decides over the proposed spans
while base spans always stay.

Everything on a document is one projection, without joins or shuffles. Only the table of vote and
shape patterns, which is bounded by the labelers, comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import carried, carry

#: Kinds of the base, and a kind that only proposals have.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: The base patterns, written so that no text makes them slow: possessive, and never begun inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals beyond the base.
_KEY = r"(?:AKIA|ASIA|AIza|eyJ|gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-)[A-Za-z0-9_.-]{12,}+"
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])|(?<![0-9+-])00[1-9][0-9]{0,2}[\x20-][0-9][\x20()0-9-]{5,14}[0-9](?![0-9-])",
    "secret": r"(?<=[:=]\x20?[\"']?)[A-Za-z0-9+/_.~-]{12,}+={0,2}|(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])|(?<![A-Za-z0-9])" + _KEY,
}
#: A cheap test that every wide pattern implies.
MAY_HAVE_MORE = r"[\[({](?:at|AT)[\])}]|\x20at\x20[A-Za-z0-9-]+\x20dot\x20|[0-9]{3}[.-][0-9]{4}|[0-9]{4}[\x20-][0-9]{4}|00[1-9]|[0-9A-Fa-f]:[0-9A-Fa-f]|[:=]\x20?[\"']?[A-Za-z0-9+/_.~-]{12}|[0-9A-Fa-f]{32}|AKIA|ASIA|AIza|eyJ|gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The strict expression of each kind; cards and phone numbers are checked by their digits besides.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)++(?<=\.)[A-Za-z]{2,24}$|^[A-Za-z0-9][^@]*(?:at|AT)[^@]*(?:dot|DOT|\.)[\])}]?\x20?[A-Za-z]{2,24}$",
    "ip": rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$|^(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$",
    "card": r"^[0-9]",
    "phone": r"^(?:\+|00|\([0-9]{3}\)|[0-9]{3}[.\x20-][0-9]{3}[.-][0-9]{4}$)",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=~-]{20,}$|^[0-9A-Fa-f]{32,}$|^" + _KEY + "$",
}
#: Gazetteers as patterns over the whole span, and words that speak for or against a kind before it.
GAZETTEER = {
    "email": r"(?i).*(?:\.|dot[\])}]?\x20?)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us|ca|at|ch|it|nl)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|23[0-9]\.).*$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|4|5)).*$",
    "phone": r"^(?:(?:\+|00)(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])[^0-9]?|\(?[2-9][0-9]{2}[)\x20.-]).*$",
    "secret": r"^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{48}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})$|^" + _KEY + "$",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|kontakt|courriel|correo|schreib)",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|adresse|direcci)",
    "card": r"(?i)(?:card|credit|visa|master|amex|karte|carte|tarjeta|pay)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|whatsapp|anruf|appel|llama)",
    "secret": r"(?i)(?:api|access|auth|secret|token|passw|passphrase|pwd|\bkey|_key|bearer|credential)[A-Za-z_]{0,12}[\"']?\s{0,3}[:=]?\s{0,3}[\"']?$",
}
_REFERENCE = r"(?i)(?:order|invoice|isbn|serial|version|token|hash|item|ticket|ref|part|id|no\.?|#)\s*[:=#.]?\s*[\"']?$"
AGAINST = {k: _REFERENCE for k in KINDS} | {"secret": r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|etag|rev|https?:?|version)\s*[:=#]?\s*[\"']?$"}
#: Forms that a kind usually has; other spans of the kind count against it.
FORM = {
    "email": r"[A-Za-z]{2,24}$",
    "ip": r"^(?!.*(?:^|\.)0[0-9])",
    "card": r"^(?:[0-9]+|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    "phone": r"[0-9)][\x20().-]+[0-9]",
    "secret": r"^(?![A-Za-z]+$)(?!.*[a-z]{12})[^./]{16,}$",
}
BEFORE = 32
#: Digits that a base match of each kind must have to be proposed although it failed its check. How probable a proposal must be.
LEAST_DIGITS, SURE = (0, 4, 12, 9), 0.8
LABELERS = ("regex", "gazetteer", "context", "around", "form")
SHAPES = ("left", "right", "size")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The checks after the base pattern."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind number, start, end, match): leftmost matches that do not overlap, in code points. The pieces between matches give the places."""
    ends = "struct<at:int,out:array<struct<k:int,s:int,e:int,m:string>>>"

    def placed(m: Column) -> Column:
        pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("p"), m.alias("m"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["p"])
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(ALL_KINDS.index(kind)).alias("k"), start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<k:int,s:int,e:int,m:string>>").alias("out"))
        return F.aggregate(pieces, start.cast(ends), lambda a, x: step(a, x).cast(ends))["out"]

    none = F.array().cast("array<struct<k:int,s:int,e:int,m:string>>")
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def raw_spans(text: Column) -> Column:
    """All matches of the base patterns, before their checks."""
    return F.concat(*[spans(text, k, BASE[k]) for k in KINDS])


def base_spans(raw: Column) -> Column:
    """The matches that pass, by start and kind."""
    return F.filter(F.when(F.size(raw) > 1, F.array_sort(raw, _order)).otherwise(raw), _passes)


def _passes(x: Column) -> Column:
    return F.coalesce(*[F.when(x["k"] == i, valid(k, x["m"])) for i, k in enumerate(KINDS)])


def _order(a: Column, b: Column) -> Column:
    by = lambda x, y, then: F.when(x < y, -1).when(x > y, 1).otherwise(then)
    return by(a["s"], b["s"], by(a["k"], b["k"], by(a["e"], b["e"], F.lit(0))))


def proposals(text: Column, raw: Column, base: Column) -> Column:
    """Spans beyond the base: wider patterns, and base matches of some digits that failed their check. But for secrets they overlap no base span."""
    none = F.array().cast("array<struct<k:int,s:int,e:int,m:string>>")
    wide = F.when(text.rlike(MAY_HAVE_MORE), F.concat(*[spans(text, k, WIDE[k]) for k in ALL_KINDS])).otherwise(none)
    failed = F.filter(raw, lambda x: (F.length(_digits(x["m"])) >= F.element_at(F.array(*map(F.lit, LEAST_DIGITS)), x["k"] + 1)) & ~_passes(x))
    free = lambda x: (x["k"] >= len(KINDS)) | ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return _let(F.concat(wide, failed), lambda c: F.when(F.size(c) > 0, F.array_distinct(F.filter(c, free))).otherwise(none))


def _strict(kind: str, match: Column) -> Column:
    fine = match.rlike(STRICT[kind])
    return fine & valid(kind, match) if kind in ("card", "phone") else fine


def votes(text: Column, x: Column) -> Column:
    """What each labeler says of a span (-1, 0, 1), and the span's shape."""
    per_kind = lambda f: F.coalesce(*[F.when(x["k"] == i, f(k)) for i, k in enumerate(ALL_KINDS)])
    before = F.substring(text, F.greatest(F.lit(1), x["s"] - BEFORE + 1), F.least(F.lit(BEFORE), x["s"]))
    left, right = F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise(" "), F.substring(text, x["e"] + 1, F.lit(1))
    glued = lambda c: c.rlike(r"^[\p{L}0-9_]")
    yes = lambda c: F.when(c, 1).otherwise(-1)
    digits = F.length(_digits(x["m"]))
    return F.struct(
        x["k"].alias("k"),
        yes(per_kind(lambda k: _strict(k, x["m"]))).alias("regex"),
        yes(per_kind(lambda k: x["m"].rlike(GAZETTEER[k]))).alias("gazetteer"),
        F.when(per_kind(lambda k: before.rlike(CONTEXT[k])), 1).when(per_kind(lambda k: before.rlike(AGAINST[k])), -1).otherwise(0).alias("context"),
        yes(~(glued(left) | glued(right))).alias("around"),
        yes(per_kind(lambda k: x["m"].rlike(FORM[k]))).alias("form"),
        F.when(left.rlike(r"\s"), 0).when(glued(left), 1).otherwise(2).alias("left"),
        F.when((right == "") | right.rlike(r"\s"), 0).when(glued(right), 1).otherwise(2).alias("right"),
        F.when(digits < 8, 0).when(digits < 12, 1).when(digits < 16, 2).otherwise(3).alias("size"),
    )


def em(patterns: dict[tuple[int, ...], int], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Probability that a span with these votes is personal data, from counts of vote patterns of one kind.

    A two-class model in which each labeler has its own distribution of votes (-1, 0, 1) in each class.
    The start is the majority of votes, the strict expression's twice, so classes keep their meaning.
    """
    p = {v: min(0.95, max(0.05, 0.5 + 0.2 * (v[0] + sum(v)))) for v in patterns}
    for _ in range(rounds):
        mass = [1.0 + sum(n * (1 - p[v]) for v, n in patterns.items()), 1.0 + sum(n * p[v] for v, n in patterns.items())]
        tables = []
        for j in range(len(LABELERS)):
            by = [{-1: 1.5, 0: 1.0, 1: 0.5}, {-1: 0.5, 0: 1.0, 1: 1.5}]
            for v, n in patterns.items():
                by[0][v[j]] += n * (1 - p[v])
                by[1][v[j]] += n * p[v]
            tables.append([{k: x / sum(c.values()) for k, x in c.items()} for c in by])
        for v in patterns:
            odds = math.log(mass[1] / mass[0]) + sum(math.log(t[1][x] / t[0][x]) for t, x in zip(tables, v, strict=True))
            p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return p


def train_classifier(rows: list[tuple[tuple[int, ...], float, int]], rounds: int = 300) -> dict[tuple[str, int], float]:
    """Logistic regression of soft labels on one-hot votes and shapes: rows of (values, label, count); weights by (feature, value)."""
    names = (*LABELERS, *SHAPES)
    weights: dict[tuple[str, int], float] = {("bias", 0): 0.0}
    total = sum(n for *_, n in rows) + 1.0
    for _ in range(rounds):
        slope: dict[tuple[str, int], float] = {}
        for values, label, n in rows:
            keys = [("bias", 0), *zip(names, values, strict=True)]
            z = sum(weights.get(k, 0.0) for k in keys)
            error = n * (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / total
            for k in keys:
                slope[k] = slope.get(k, 0.0) + error
        for k, x in slope.items():
            weights[k] = weights.get(k, 0.0) + 1.0 * (x - 0.001 * weights.get(k, 0.0))
    return weights


def fit(docs: DataFrame) -> list[dict[tuple[str, int], float]]:
    """The span classifier of each kind, from all candidates of all documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(text.alias("text")).where(F.col("text").rlike(r"[@+0-9(\[{:=]|\x20at\x20"))
    docs = docs.withColumn("raw", raw_spans(F.col("text"))).withColumn("base", base_spans(F.col("raw")))
    found = docs.select("text", F.explode(F.concat("base", proposals(F.col("text"), F.col("raw"), F.col("base")))).alias("x")).select(votes(F.col("text"), F.col("x")).alias("v"))
    names = (*LABELERS, *SHAPES)
    rows = found.groupBy(*[F.col(f"v.{c}").alias(c) for c in ("k", *names)]).agg(F.count("*").alias("n")).collect()  # bounded: at most 5 * 3**5 * 36 rows
    models = []
    for k in range(len(ALL_KINDS)):
        own = sorted((tuple(r[c] for c in names), r["n"]) for r in rows if r["k"] == k)
        counts: dict[tuple[int, ...], int] = {}
        for v, n in own:
            counts[v[: len(LABELERS)]] = counts.get(v[: len(LABELERS)], 0) + n
        p = em(counts)
        models.append(train_classifier([(v, p[v[: len(LABELERS)]], n) for v, n in own]))
    return models


def classifier(models: list[dict[tuple[str, int], float]], v: Column) -> Column:
    """The log odds of a span's votes and shape, as an expression."""

    def score(weights: dict[tuple[str, int], float]) -> Column:
        z = F.lit(weights[("bias", 0)])
        for (name, value), w in sorted(weights.items()):
            if name != "bias":
                z = z + F.when(v[name] == value, w).otherwise(0.0)
        return z

    return F.coalesce(*[F.when(v["k"] == k, score(m)) for k, m in enumerate(models)])


def _written(found: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Finds personal data in every whole text.

    docs: doc_id and text. Returns doc_id, found (array of kind number, start, end, match: base spans and
    those that the classifier adds, by start and kind), base (base spans alone), and the columns named
    in ``keep``, whatever their names (one named like a column of the result comes as ``name_in``).
    Starts and ends count code points; ends are exclusive.

    Null and empty texts have no spans. Rows with null or repeated doc_id are searched like others. An
    empty table gives no rows.
    """
    models = fit(docs)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry(keep))
    docs = docs.withColumn("raw", raw_spans(F.col("text"))).withColumn("base", base_spans(F.col("raw")))
    good = lambda x: _let(votes(F.col("text"), x), lambda v: classifier(models, v) >= math.log(SURE / (1 - SURE)))
    added = F.filter(proposals(F.col("text"), F.col("raw"), F.col("base")), good)
    found = _let(added, lambda a: F.when(F.size(a) > 0, F.array_sort(F.concat(F.col("base"), a), _order)).otherwise(F.col("base")))
    return docs.withColumn("found", found).select("doc_id", "found", "base", *carried(keep, ("doc_id", "found", "base")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: n_secret, n_added (spans that the method adds) and n_spans (all)."""
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda c, k: F.size(F.filter(c, lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id", *[count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"),
        count("found", len(KINDS)).alias("n_secret"), (F.size("found") - F.size("base")).cast("long").alias("n_added"), F.size("found").cast("long").alias("n_spans"),
    )


ORACLE_SQL = None
