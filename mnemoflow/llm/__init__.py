"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

OPERATORS = (
    "op1_pii", "op2_topk", "op3_substring_dedup", "op4_quality_classifier", "op5_minhash_forest",
    "op6_bpe_tree", "op7_quality_rules", "op8_line_dedup", "op9_warc", "op10_mixing",
    "op11_periodic_runs", "op12_sharding",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"mnemoflow.llm.{name}").query for name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = {name: importlib.import_module(f"mnemoflow.llm.{name}").ORACLE_SQL for name in OPERATORS}
    return {name: sql for name, sql in found.items() if sql}
