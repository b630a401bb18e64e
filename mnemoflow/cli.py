"""Command line: python -m mnemoflow.cli COMMAND --index-dir DIR ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from mnemoflow.memory import Memory
from mnemoflow.operators import evaluation, maintenance
from mnemoflow.sources import config, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mnemoflow")
    p.add_argument("--index-dir")
    p.add_argument("--settings", help="a TOML file with a table tool.mnemoflow")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, **values: object) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for f in flags:
            c.add_argument(f"--{f}", action="store_true")
        for k, default in values.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return c

    command("ingest", project=None).add_argument("file")
    command("scan", "full", "dry-run", project=None).add_argument("folders", nargs="*")
    command("query", "rerank", "no-hyde", top_k=5, project=None, source=None).add_argument("text")
    command("distill", "dry-run", project=None)
    command("inject", "dry-run").add_argument("file")
    command("health")
    command("stats")
    command("eval", "rerank", "use-hyde", top_k=10).add_argument("gold")
    command("dedup-noise", "apply").add_argument("projects", nargs="*")
    command("reclassify")
    command("rebuild")
    command("oneshot", digest=None).add_argument("folders", nargs="*")
    command("serve", port=8765)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    settings = config.load(a.settings)
    spark = SparkSession.builder.appName("mnemoflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    memory = Memory(spark, a.index_dir or settings["index_dir"], settings=settings)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str, indent=2))
    if a.command == "ingest":
        show({"written": memory.add_file(a.file, a.project)})
    elif a.command == "scan":
        show(memory.scan(a.folders or None, project=a.project, incremental=not a.full, dry_run=a.dry_run))
    elif a.command == "query":
        show(memory.ask(a.text, a.top_k, project=a.project, source=a.source, rerank=a.rerank, use_hyde=not a.no_hyde))
    elif a.command == "distill":
        show({k: v for k, v in memory.distill(a.project, dry_run=a.dry_run).items() if k != "rows"})
    elif a.command == "inject":
        show(memory.inject(a.file, a.dry_run))
    elif a.command == "health":
        report = memory.health()
        show(report)
        return maintenance.exit_code(report)
    elif a.command == "stats":
        show(memory.stats())
    elif a.command == "eval":
        print(evaluation.report(memory.evaluate(files.gold_set(spark, a.gold), a.top_k, rerank=a.rerank, use_hyde=a.use_hyde)))
    elif a.command == "dedup-noise":
        show(memory.noise_dedup(a.projects, dry_run=not a.apply))
    elif a.command == "reclassify":
        memory.store.relabel_unknown()
        show(memory.stats())
    elif a.command == "rebuild":
        show({"postings": memory.store.rebuild_postings()})
    elif a.command == "oneshot":
        show(memory.run_once(a.folders or settings["memory_dirs"], a.digest))
    elif a.command == "serve":
        from mnemoflow.server import serve

        serve(memory, a.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
