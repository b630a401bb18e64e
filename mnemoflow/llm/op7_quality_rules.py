"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import carried, carry

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "und", "von", "zu",
    "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "al", "con", "del", "el", "es", "las", "los", "no", "para", "por", "se", "su", "y",
)


@dataclass(frozen=True)
class Rule:
    """A document of at least ``from_words`` words fails if the metric is below ``least`` or above ``most``."""

    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: Production thresholds. Metrics are the columns of ``measures`` and ratios of them (``RATIOS``).
RULES = (
    Rule("mean_word_chars", least=2, most=20, from_words=10),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_word_ratio", least=0.02, from_words=50),
    Rule("dup_line_ratio", most=0.5),
)
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
}
WIDTH = 5


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once although body may use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of five words that are found twice or more in the text.

    64-bit hashes of the windows show whether any can be equal. Only then the windows themselves are
    sorted, so that neighbours which are equal are repeats; the sorted starts of repeats give the
    covered words.
    """
    at = lambda w: F.sequence(F.lit(1), F.size(w) - WIDTH + 1)

    def covered(w: Column) -> Column:
        windows = F.array_sort(F.transform(at(w), lambda i: F.struct(F.array_join(F.slice(w, i, WIDTH), " ").alias("s"), i.alias("i"))))

        def starts(x: Column) -> Column:
            same = lambda a, b: F.get(x, a)["s"].eqNullSafe(F.get(x, b)["s"])
            return F.array_sort(F.transform(F.filter(x, lambda e, k: same(k, k - 1) | same(k, k + 1)), lambda e: e["i"]))

        add = lambda acc, i: F.struct((acc["n"] + WIDTH - F.greatest(F.lit(0), acc["upto"] - i)).alias("n"), (i + WIDTH).alias("upto"))
        return F.aggregate(_let(windows, starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), add)["n"]

    def counted(w: Column) -> Column:
        hashes = F.transform(at(w), lambda i: F.xxhash64(F.slice(w, i, WIDTH)))
        some = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(some, covered(w)).otherwise(0)

    return F.when(F.size(words) > WIDTH, counted(words)).otherwise(0).cast("long")


def measures(text: Column) -> Column:
    """One struct of all counts of a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = lambda w: F.lower(F.regexp_replace(w, r"[.,]+$", ""))
    stops = F.create_map(*[F.lit(x) for w in dict.fromkeys(STOP_WORDS) for x in (w, True)])

    def both(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda x: stops[plain(x)])).cast("long").alias("n_stop_words"),
        )

    return _let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), both)


def compile_rules(m: Column, rules: tuple[Rule, ...]) -> Column:
    """True where no rule fails; a ratio over nothing fails no rule."""
    failed = F.lit(False)
    for r in rules:
        top, bottom = RATIOS.get(r.metric, (r.metric, None))
        value = m[top] / F.nullif(m[bottom], F.lit(0).cast("long")) if bottom else m[top]
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (value < r.least)
        if r.most is not None:
            bad = bad | (value > r.most)
        failed = failed | ((m["n_words"] >= r.from_words) & F.coalesce(bad, F.lit(False)))
    return ~failed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Measures every whole text and judges it by the rules.

    docs: doc_id and text. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines and n_stop_words, and the columns named in ``keep``, whatever their names
    (one named like a column of the result comes as ``name_in``). base_failed: fewer than ten words, or
    over a fifth of the words in repeated five-word windows.

    Null and empty texts count zero everywhere and fail. Rows with null or repeated doc_id are judged
    like others; an empty table gives no rows.
    """
    m = F.col("m")
    base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    out = docs.select("doc_id", measures(F.col("text")).alias("m"), *carry(keep))
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = ("doc_id", *counted, "base_failed", "kept", "n_lines", "n_stop_words")
    return out.select(
        "doc_id", *[m[x].alias(x) for x in counted], base.alias("base_failed"), (~base & compile_rules(m, rules)).alias("kept"),
        m["n_lines"].alias("n_lines"), m["n_stop_words"].alias("n_stop_words"), *carried(keep, own),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r
  FROM documents
), s AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) > 5)
), again AS (
  SELECT r, list_distinct(flatten(list(range(i, i + 5)))) AS pos FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM s) WHERE n > 1 GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(len(pos), 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: lower(regexp_replace(x, '[.,]+$', '')) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words
  FROM t LEFT JOIN again USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_stop_words,
  NOT base_failed AND NOT (
    n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)
    OR n_symbols / nullif(word_chars, 0)::DOUBLE > 0.1
    OR n_words >= 50 AND n_stop_words / n_words::DOUBLE < 0.02
    OR coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) > 0.5
  ) AS kept
FROM b
"""
