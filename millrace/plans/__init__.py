"""The registered queries, grouped by theme."""

from __future__ import annotations

from importlib import import_module

from millrace.plans.registry import Query

THEMES = ("sales", "joins", "aggregates", "windows", "scalars", "streams")


def all_queries() -> list[Query]:
    found = [
        query
        for theme in THEMES
        for query in import_module(f"millrace.plans.{theme}").registry.queries
    ]
    names = [query.name for query in found]
    if len(set(names)) != len(names):
        raise ValueError(f"two queries share a name: {sorted(names)}")
    return found
