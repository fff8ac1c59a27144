"""All registered queries: key → (Spark callable, SQL text or None)."""

from __future__ import annotations

import importlib

from .views import Query

MODULES = [
    "source_queries",
    "store_queries",
    "rollup_queries",
    "sport_queries",
    "power_queries",
    "route_queries",
    "load_queries",
    "model_queries",
    "sleep_queries",
    "strength_queries",
]


def _load() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        module = importlib.import_module(f"{__package__}.{name}")
        clash = found.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        found.update(module.QUERIES)
    return found


def queries() -> dict[str, Query]:
    return {k: fn for k, (fn, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _load().items() if sql is not None}
