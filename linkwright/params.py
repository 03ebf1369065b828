"""Defaults of the linkage operators, and reading them from a YAML file and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

#: A pool record's number is its source times this, plus its row number.
PID_BASE = 10_000_000
TYPES = ("n", "a", "p", "c", "m", "d", "h")


@dataclass(frozen=True)
class BlockParams:
    k: int = 30
    cap_df: int = 800
    per_type: dict[str, int] = field(default_factory=lambda: {"n": 4, "a": 4, "p": 3, "c": 6, "m": 3, "d": 3, "h": 3})
    prefix_len: int = 5
    min_prefix_len: int = 7
    comp_name: int = 2
    comp_addr: int = 3
    comp_m: int = 3
    comp_d: int = 3
    comp_h: int = 3
    #: Inverse document frequencies are whole multiples of 1 / scale, so that no order of sums matters.
    scale: int = 1_000_000
    types: tuple[str, ...] = TYPES


@dataclass(frozen=True)
class DecisionParams:
    beta2: float = 0.25
    hi: float = 0.5
    shortlist_k: int = 10
    shortlist_pmin: float = 0.005
    caps: dict[int, int] = field(default_factory=lambda: {2: 5, 3: 6})


def load(path: str | None = None) -> dict[str, dict]:
    """The parameter sections of a YAML file; the path defaults to LINKWRIGHT_PARAMS."""
    path = path or os.environ.get("LINKWRIGHT_PARAMS")
    if not path:
        return {}
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def block_params(section: dict | None = None) -> BlockParams:
    known = BlockParams()
    return replace(known, **{k: v for k, v in (section or {}).items() if hasattr(known, k)})


def paths() -> dict[str, str]:
    """Where data and results lie, from the environment."""
    return {"data": os.environ.get("LINKWRIGHT_DATA", "data"), "work": os.environ.get("LINKWRIGHT_WORK", "work")}
