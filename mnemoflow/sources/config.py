"""Settings: environment over a TOML table over defaults, coerced to the default's type."""

from __future__ import annotations

import os
import tomllib
import warnings
from pathlib import Path
from typing import Any

from mnemoflow.functions import vocab

PREFIX = "MNEMOFLOW_"
DEFAULTS: dict[str, Any] = {
    "index_dir": "./.index", "memory_dirs": ["./memory"], "memory_patterns": list(vocab.NOTE_PATTERNS), "ignore_patterns": list(vocab.IGNORE_PATTERNS),
    "embedding_dim": 64, "embedding_model": "hash", "reranker_model": "overlap", "device": "cpu",
    "dedup_threshold": 0.92, "dedup_skip_low": 0.85, "max_search_k": 200, "large_index_threshold": 1000, "tau_days": 90.0, "rrf_k": 30,
    "distill_top_per_group": 10, "distill_purge_threshold": 0.005, "distill_cron_time": "03:00",
}
#: Older names of the environment that still count, with a warning.
LEGACY = {"MAX_SEARCH_K": "max_search_k", "LARGE_INDEX_THRESHOLD": "large_index_threshold"}


def coerce(value: Any, default: Any) -> Any:
    """The value in the default's type; a bad number gives the default and a warning."""
    if isinstance(default, list):
        return [x.strip() for x in value.split(",") if x.strip()] if isinstance(value, str) else list(value)
    if isinstance(default, bool):
        return str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, (int, float)):
        try:
            return type(default)(value)
        except (TypeError, ValueError):
            warnings.warn(f"{value!r} is no {type(default).__name__}; {default!r} is used", stacklevel=2)
            return default
    return str(value)


def load(toml: str | Path | None = None, env: dict[str, str] | None = None) -> dict[str, Any]:
    """All settings. toml: a file with a table ``tool.mnemoflow`` (a missing or broken file counts as empty)."""
    env = dict(os.environ) if env is None else env
    table: dict[str, Any] = {}
    if toml is not None:
        try:
            table = tomllib.loads(Path(toml).read_text(encoding="utf-8")).get("tool", {}).get("mnemoflow", {})
        except (OSError, tomllib.TOMLDecodeError):
            table = {}
    out = {}
    for key, default in DEFAULTS.items():
        old = next((o for o, k in LEGACY.items() if k == key and o in env), None)
        if PREFIX + key.upper() in env:
            out[key] = coerce(env[PREFIX + key.upper()], default)
        elif old:
            warnings.warn(f"{old} is an old name of {PREFIX}{key.upper()}", DeprecationWarning, stacklevel=2)
            out[key] = coerce(env[old], default)
        else:
            out[key] = coerce(table[key], default) if key in table else default
    return out
