"""Batch jobs over the chunk table: distillation and purge, noise removal, relabelling, health, the digest block."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoflow.functions import scalar, vocab

PURGE_BELOW, TOP = 0.005, 10
#: Characters of the digest block and of one project in it, rows of a project, characters of a row.
BLOCK_CHARS, PROJECT_CHARS, PROJECT_ROWS, ROW_CHARS = 2200, 500, 5, 80
FULL = "- _… (budget of the block is used up)_"
DIGEST_START, DIGEST_END = "<!-- AUTO_DIGEST_START -->", "<!-- AUTO_DIGEST_END -->"


def project_or_none(name: str = "project", label: str = vocab.NO_PROJECT) -> Column:
    return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(label))


def distill(chunks: DataFrame, now: Column, project: str | None = None, top: int = TOP, purge_below: float = PURGE_BELOW, tau_days: float = 90.0) -> DataFrame:
    """Every chunk with its project, score, rank in the project (from 1; null beyond the first rows) and verdict: keep, purge or stay.

    The first ``top`` of a project are kept; of the others those with a score below ``purge_below`` are
    purged. Only the first rows of a project are ranked, so each task drops the others before the
    shuffle, and a project may hold any share of the chunks. A chunk without an id has no rank.
    """
    rows = chunks.withColumn("project", project_or_none())
    if project is not None:
        rows = rows.where(F.col("project") == project)
    rows = rows.withColumn("score", scalar.distill_score(F.col("confidence"), F.col("ts"), F.col("access_count"), now, tau_days))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(*by_score()))
    first = rows.where(F.col("id").isNotNull()).select("project", "id", "score").withColumn("rank", rank).where(F.col("rank") <= max(top, PROJECT_ROWS))
    verdict = F.when(F.col("rank") <= top, "keep").when(F.col("score") < purge_below, "purge").otherwise("stay")
    return rows.join(first.select("project", "id", "rank"), ["project", "id"], "left").withColumn("verdict", verdict)


def by_score() -> list[Column]:
    return [F.desc(F.round("score", 12)), F.col("id")]


def distill_report(distilled: DataFrame) -> DataFrame:
    """A row for each project: total, kept_count, purge_count, kept_score (sum over the kept), the hottest project first."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return distilled.groupBy("project").agg(F.count("*").alias("total"), n("keep").alias("kept_count"), n("purge").alias("purge_count"), F.sum(F.when(F.col("verdict") == "keep", F.col("score"))).alias("kept_score")).orderBy(F.desc("kept_score"), "project")


def kept_rows(distilled: DataFrame) -> DataFrame:
    """What the report lists of kept chunks: text cut to 120 characters, score to 4 digits."""
    return distilled.where("verdict = 'keep'").select("project", "rank", "id", F.substring("text", 1, 120).alias("text"), F.round("score", 4).alias("score"), F.col("access_count").alias("access"), "ts")


def purge_rows(distilled: DataFrame, most: int = 20) -> DataFrame:
    """What the report lists of chunks to purge: the best ``most`` of each project, text cut to 80 characters."""
    n = F.row_number().over(Window.partitionBy("project").orderBy(*by_score()))
    return distilled.where("verdict = 'purge'").withColumn("n", n).where(F.col("n") <= most).select("project", "n", "id", F.substring("text", 1, 80).alias("text"), F.round("score", 4).alias("score"), F.col("access_count").alias("access"), "ts")


def purge(chunks: DataFrame, distilled: DataFrame) -> DataFrame:
    """The chunks without those to purge, of all projects."""
    return chunks.join(distilled.where("verdict = 'purge'").select("id"), "id", "left_anti")


def keep_first(chunks: DataFrame) -> DataFrame:
    """One chunk for each text (white space aside): the oldest, those without a time first, then the smallest id."""
    order = Window.partitionBy("text_hash").orderBy(F.coalesce(F.col("ts").cast("string"), F.lit("")), "id")
    return chunks.withColumn("text_hash", scalar.text_hash(F.col("text"))).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def noise_dedup(chunks: DataFrame, keep_projects: Iterable[str]) -> DataFrame:
    """The chunks to keep: of the projects named, and the first of each text."""
    return keep_first(chunks).where(F.col("project").isin(list(keep_projects)))


def relabel_unknown(chunks: DataFrame, decisions: Iterable[str] = vocab.RELABEL_DECISION_WORDS, tests: Iterable[str] = vocab.RELABEL_TEST_WORDS) -> DataFrame:
    """Chunks with source unknown get one by their text; adds the rule."""
    source, rule = scalar.relabel(F.col("text"), decisions, tests)
    unknown = F.col("source") == "unknown"
    return chunks.withColumn("rule", F.when(unknown, rule)).withColumn("source", F.when(unknown, source).otherwise(F.col("source")))


def unknown_listing(chunks: DataFrame) -> DataFrame:
    return chunks.where("source = 'unknown'").orderBy(F.desc("access_count"), F.desc("length"), "id")


def counts_by(chunks: DataFrame, column: str) -> DataFrame:
    """Chunks by a column, without those that have none."""
    return chunks.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("n"))


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total"), F.count_distinct(F.nullif("project", F.lit(""))).alias("projects"))


def project_groups(chunks: DataFrame) -> DataFrame:
    """A row for each project: its chunks, their first and last id, their characters."""
    return chunks.groupBy("project").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("length").cast("long").alias("chars"))


def stats(chunks: DataFrame) -> dict:
    """Rows in all, by source and by project (those that have one), and how many projects."""
    by = lambda c: {r[0]: r[1] for r in counts_by(chunks, c).orderBy(F.desc("n"), c).collect()}
    return {**totals(chunks).first().asDict(), "by_source": by("source"), "by_project": by("project")}


def access_counts(log: DataFrame) -> DataFrame:
    """(chunk_id, access_count, last_access) of a log (chunk_id, accessed_at)."""
    return log.groupBy("chunk_id").agg(F.count("*").alias("access_count"), F.max("accessed_at").alias("last_access"))


def health_row(chunks: DataFrame) -> DataFrame:
    """total, avg_length (1 digit), avg_confidence (3 digits), never_accessed, in one pass."""
    return chunks.agg(
        F.count("*").alias("total"), F.round(F.coalesce(F.avg("length"), F.lit(0.0)), 1).alias("avg_length"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"),
        F.count_if(F.coalesce("access_count", F.lit(0)) == 0).alias("never_accessed"),
    )


def health(chunks: DataFrame, large: int = 1000, storage: DataFrame | None = None) -> dict:
    """Status, figures and notes; a missing index is red, an empty one yellow."""
    row = health_row(chunks).first().asDict()
    found = stats(chunks)
    notes = []
    if row["total"] == 0:
        notes.append("the index is empty")
    if row["total"] > large:
        notes.append(f"large index (> {large})")
    if row["total"] > 10 and row["never_accessed"] / row["total"] > 0.9:
        notes.append("over 90 % of the chunks were never accessed")
    index = row | {"status": "yellow" if row["total"] == 0 else "green", "by_source": found["by_source"], "by_project": dict(list(found["by_project"].items())[:10]), "notes": notes}
    checks = {"index": index}
    if storage is not None:
        total = storage.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        top = storage.orderBy(F.desc("length"), "path").limit(10).collect()
        checks["storage"] = {"status": "green" if total else "yellow", "total_bytes": total, "total_size": scalar.format_size(total), "files": {r["path"]: scalar.format_size(r["length"]) for r in top}}
    states = {c["status"] for c in checks.values()}
    return {"overall": "red" if "red" in states else "yellow" if "yellow" in states else "green", "checks": checks}


def exit_code(report: dict) -> int:
    return {"red": 2, "yellow": 1, "green": 0}[report["overall"]]


def should_distill(last_ts: float | None, now: float, interval_hours: float = 24.0) -> bool:
    """Never run, or longer ago than the interval; the index's size does not matter."""
    return not last_ts or now - last_ts >= interval_hours * 3600


def digest_rows(distilled: DataFrame) -> DataFrame:
    """The candidates of the digest: the first rows of each project with their line and its running cost, hottest projects first.

    The prefix of a project that fits its own budget is cut in Spark; the budget of the whole block
    depends on what came before and is applied by ``render_digest`` on these few rows.
    """
    top = distilled.where(F.col("rank") <= PROJECT_ROWS)
    line = F.concat(F.lit("- `"), F.format_string("%.3f", "score"), F.lit("` acc="), F.coalesce("access_count", F.lit(0)).cast("string"), F.lit("  "), scalar.truncate(F.substring("text", 1, 120), ROW_CHARS))
    w = Window.partitionBy("project")
    top = top.withColumn("line", line).withColumn("rows", F.count("*").over(w)).withColumn("heat", F.sum(F.round("score", 4)).over(w))
    header = F.concat(F.lit("### "), F.col("project"), F.lit(" ("), F.col("rows").cast("string"), F.lit(" chunks)"))
    run = F.sum(F.length("line") + 1).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    top = top.withColumn("header", header).withColumn("cost", run + F.length("header") + 1)
    return top.select("project", "heat", "header", "rank", "line", (F.col("cost") <= PROJECT_CHARS).alias("fits"))


def render_digest(rows: Iterable[dict], projects: int, total: int, stamp: str) -> str:
    """The block's text from ``digest_rows``, within its budget of characters."""
    if not projects:
        return f"_(no projects to distill among {total} chunks)_"
    out = [f"_Last update: {stamp} · {projects} projects · {total} chunks total_", ""]
    used = len(out[0]) + 1
    by: dict[tuple[float, str], list[dict]] = {}
    for r in rows:
        by.setdefault((-r["heat"], r["project"]), []).append(r)
    for key in sorted(by):
        own = sorted(by[key], key=lambda r: r["rank"])
        if used + len(own[0]["header"]) + 1 > BLOCK_CHARS:
            break
        out.append(own[0]["header"])
        used += len(own[0]["header"]) + 1
        for r in own:
            if used + len(r["line"]) + 1 > BLOCK_CHARS:
                if FULL not in out:
                    out.append(FULL)
                break
            if not r["fits"]:
                break
            out.append(r["line"])
            used += len(r["line"]) + 1
        out.append("")
    return "\n".join(out).rstrip()


def put_digest(text: str | None, body: str, title: str = "# Memory") -> str:
    """The note with the digest between its markers; without (proper) markers it is added at the end. Repeating changes nothing."""
    at, end = (text or "").find(DIGEST_START), (text or "").find(DIGEST_END)
    if text is not None and -1 < at < end:
        return f"{text[: at + len(DIGEST_START)]}\n{body}\n{text[end:]}"
    block = f"\n{DIGEST_START}\n{body}\n{DIGEST_END}\n"
    return f"{title}\n{block}" if text is None else f"{text.rstrip()}\n{block}"
