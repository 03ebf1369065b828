"""The registered record-linkage queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from .plans import blocking, names, outputs, rules, scored_pairs, vectors

_PLANS = (blocking, scored_pairs, names, rules, vectors, outputs)


def queries() -> dict[str, Callable]:
    return {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
