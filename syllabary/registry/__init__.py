"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("lists", "merges", "scalars", "quality", "programmes", "pagescans", "calendars")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"syllabary.registry.{name}")


def all_queries() -> dict:
    from syllabary.registry.base import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from syllabary.registry.base import ORACLE

    _load()
    return dict(ORACLE)
