"""The registered queries of this package with their SQL."""

from __future__ import annotations

from importlib import import_module

from millrace.plans.registry import Query

MODULES = ("tokens", "repeats", "classifiers", "quality", "pages", "conversations", "phrases")


def llm_queries() -> list[Query]:
    return [
        query
        for name in MODULES
        for query in import_module(f"millrace.llm.queries.{name}").registry.queries
    ]
