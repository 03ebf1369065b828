"""A run log: one JSON line for each stage, and JSON reports. Logging never stops a run."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path


def params_hash(params: dict) -> str:
    """Twelve hex digits that stand for a set of parameters in the paths of its results."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]


def log_stage(folder: str, stage: str, params: dict, metrics: dict, extra: dict | None = None) -> bool:
    """Append a stage's entry to runs.jsonl; False if that was not possible."""
    try:
        path = Path(folder)
        path.mkdir(parents=True, exist_ok=True)
        entry = {"time": time.time(), "stage": stage, "params": params, "metrics": metrics, **(extra or {})}
        with (path / "runs.jsonl").open("a", encoding="utf-8") as file:
            file.write(json.dumps(entry, default=str) + "\n")
        return True
    except (OSError, TypeError, ValueError):
        return False


def write_report(path: str, report: dict) -> None:
    Path(path).write_text(json.dumps(report, indent=1, sort_keys=True, default=str), encoding="utf-8")
