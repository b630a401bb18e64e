"""Scalar functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoflow.functions import vocab

#: Unicode white space, which is taken off at both ends.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACE))


def any_of(x: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is a substring."""
    words = list(words)
    return x.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def is_key_term(x: Column, terms: Iterable[str] = vocab.KEY_TERMS) -> Column:
    return any_of(F.lower(x), terms)


def keeps_length(x: Column, min_length: int = 8, terms: Iterable[str] = vocab.KEY_TERMS) -> Column:
    """The length filter: long enough, or with a key term."""
    return (x != "") & ((F.length(x) >= min_length) | is_key_term(x, terms))


def extract_project(x: Column, label: str = "项目", generic: Iterable[str] = vocab.GENERIC_HEADINGS) -> Column:
    """The first name after a label, else the first capitalised token of four letters or more; generic headings do not count."""
    named = F.regexp_extract(x, re.escape(label) + r"(?U:[:：\s]+)([A-Za-z0-9\-_一-龥]{2,20})", 1)
    token = F.regexp_extract(x, r"(?U)\b([A-Z][A-Za-z0-9]{3,15}(?:\.[a-z]+)?)\b", 1)
    bad = list(generic)
    fine = lambda c: F.when((c != "") & ~c.isin(bad), c)
    return F.coalesce(fine(named), fine(token))


def extract_entities(x: Column, terms: Iterable[str] = vocab.ENTITY_TERMS, most: int = 10) -> Column:
    """The terms that are substrings, sorted, ten at most."""
    known = F.array(*map(F.lit, sorted(set(terms)))).cast("array<string>")
    found = F.transform(F.array(F.lower(x)), lambda low: F.filter(known, lambda t: F.contains(low, t)))  # lower case once, not for each term
    return F.slice(F.element_at(found, 1), 1, most)


def detect_source(text: Column, path: Column | None = None, log_folder: str = "/memory/") -> Column:
    """Source by path (a main note, a folder of logs, a conversation), else by the text's beginning."""
    by_text = F.when(text.startswith("#"), "user-memory").otherwise("unknown")
    if path is None:
        return by_text
    path = F.coalesce(path, F.lit(""))
    return F.when(F.contains(path, F.lit("MEMORY.md")), "user-memory").when(F.contains(path, F.lit(log_folder)), "workspace-log").when(F.contains(F.lower(path), F.lit("conversation")), "conversation").otherwise(by_text)


def confidence(x: Column, words: Iterable[str] = vocab.DECISION_WORDS) -> Column:
    """A half, and more for length, decision words, an ISO date and a camel-case name; 1 at most. Added in a fixed order."""
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    score = F.lit(0.5) + one(F.length(x) > 50, 0.1) + one(any_of(F.lower(x), words), 0.2)
    score = score + one(x.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), 0.1) + one(x.rlike("[A-Z][a-z]+(?:[A-Z][a-z]+)+"), 0.1)
    return F.least(score, F.lit(1.0))


def parse_ts(x: Column) -> Column:
    """ISO timestamps with a T, or bare dates; anything else is null."""
    fine = x.rlike(r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$")
    return F.when(fine, F.try_to_timestamp(F.when(F.contains(x, F.lit("T")), x).otherwise(F.concat(x, F.lit("T00:00:00")))))


def relabel(x: Column, decisions: Iterable[str] = vocab.RELABEL_DECISION_WORDS, tests: Iterable[str] = vocab.RELABEL_TEST_WORDS) -> tuple[Column, Column]:
    """(new source, rule) of a chunk without a source, by the first rule that holds."""
    left = F.regexp_replace(x, r"(?U)^\s+", "")
    decided, dated = any_of(x, decisions), x.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
    rules = [
        (F.contains(x, F.lit("<!-- RAW_JSON_START")) | left.startswith("RAW_JSON_END"), "cloud-profile-legacy", "block marker"),
        (F.substring(left, 1, 200).rlike(r"^\*\*[^*]+\*\*"), "user-memory", "bold head"),
        (dated & decided, "workspace-log", "date and decision"),
        (decided, "user-memory", "decision"),
        (any_of(x, tests), "test-result", "test"),
    ]
    source, why = F, F
    for cond, s, w in rules:
        source, why = source.when(cond, s), why.when(cond, w)
    return source.otherwise("user-memory"), why.otherwise("fallback")


def normalise(x: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def text_hash(x: Column) -> Column:
    return F.substring(F.md5(normalise(x).cast("binary")), 1, 16)


def truncate(x: Column, n: int = 80) -> Column:
    """One line of at most n characters; literal escapes count as white space."""
    flat = normalise(F.regexp_replace(x, r"\\[nrt]", " "))
    return F.when(F.length(flat) > n, F.concat(F.regexp_replace(F.substring(flat, 1, n), r"(?U)\s+$", ""), F.lit("…"))).otherwise(flat)


def needs_history(x: Column, words: Iterable[str] = vocab.HISTORY_WORDS, pronouns: Iterable[str] = vocab.HISTORY_PRONOUNS) -> Column:
    return any_of(x, words) | ((F.length(x) <= 12) & any_of(x, pronouns))


def rerank_cut(x: Column, max_length: int = 512) -> Column:
    """Documents for the reranker: whole up to a length in characters, else its first part."""
    limit = int(int(max_length * 0.8 + 1) / 1.5 - 1e-9)  # an estimate of 1.5 tokens a character against four fifths of the room
    return F.when(F.length(x) <= limit, x).otherwise(F.substring(x, 1, int(max_length * 0.7 / 1.5)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rewrite(x: Column, templates: Iterable[str] = vocab.REWRITE_TEMPLATES) -> Column:
    """A query's stand-in answer: a template chosen by the sum of its code points, and the query; blank queries stay."""
    templates = list(templates)
    total = F.aggregate(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    text = F.element_at(F.array(*[F.concat(F.lit(t.split("{query}")[0]), x, F.lit(t.split("{query}")[1])) for t in templates]), (total % len(templates) + 1).cast("int"))
    return F.when(strip(x) == "", x).otherwise(F.concat(text, F.lit(" "), x))


def hash_embed(x: Column, dim: int = 64) -> Column:
    """A unit vector from hashes of the text and the position; carries no meaning, needs no model."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(F.md5(F.concat(x, F.lit(":"), i.cast("string")).cast("binary")), 1, 2), 16, 10).cast("double") / 255 - 0.5)
    sized = F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("norm")))  # the norm is taken once
    return F.element_at(F.transform(sized, lambda s: F.transform(s["v"], lambda a: a / s["norm"])), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def age_days(ts: Column, now: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, now) / 86400e6


def decay(ts: Column, access_count: Column, now: Column, tau_days: float = 90.0, missing: float = 1.0) -> Column:
    """exp(-age / tau) * ln(2 + accesses); ``missing`` where there is no timestamp."""
    return F.when(ts.isNull(), F.lit(missing)).otherwise(F.exp(-age_days(ts, now) / tau_days) * F.log(2 + F.coalesce(access_count, F.lit(0))))


def distill_score(conf: Column, ts: Column, access_count: Column, now: Column, tau_days: float = 90.0) -> Column:
    """Confidence by decay by popularity, where a missing timestamp has a decay of a half."""
    fade = F.when(ts.isNull(), 0.5).otherwise(F.exp(-age_days(ts, now) / tau_days))
    return F.coalesce(conf, F.lit(0.5)) * fade * F.log(2 + F.coalesce(access_count, F.lit(0)))


def level_of(source: Column, levels: dict[str, str] = vocab.SOURCE_LEVELS) -> Column:
    out = F
    for s, level in levels.items():
        out = out.when(source == s, level)
    return out.otherwise("full")


def format_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f}{unit}"
        n /= 1024
    return f"{n:.1f}TB"
