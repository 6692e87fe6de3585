"""A query: its name, how to build it in Spark, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    oracle: str | None


class Registry:
    def __init__(self) -> None:
        self.queries: list[Query] = []

    def query(self, oracle: str | None) -> Callable[[Build], Build]:
        """Register the decorated builder under its own name."""

        def register(build: Build) -> Build:
            self.queries.append(Query(build.__name__, build, oracle))
            return build

        return register
