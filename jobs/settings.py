"""Settings of a job: the TOML file beside it, or one that the caller names, over which keywords win."""

from __future__ import annotations

import logging
import tomllib
from pathlib import Path


def load(job: str, path: str | None = None, **own) -> dict:
    """Settings by name; a name that the job's own file does not have is an error."""
    known = tomllib.loads((Path(__file__).parent / f"{job}.toml").read_text(encoding="utf-8"))
    given = (tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}) | {k: v for k, v in own.items() if v is not None}
    strange = sorted(set(given) - set(known))
    if strange:
        raise ValueError(f"unknown settings of {job}: {', '.join(strange)}")
    return known | given


def to_stderr() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
