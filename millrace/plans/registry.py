"""All queries of the library, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules of this package that have QUERIES and ORACLE.
MODULES: tuple[str, ...] = ("search", "retrieval", "listing", "aggregates", "texts", "graphs", "ingest", "more")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"millrace.plans.{module}"), name)
    return found


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
