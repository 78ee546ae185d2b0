"""Where queries register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import ctes, view

TODAY = "2026-03-17"
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def over(name: str, f: Callable[..., DataFrame], views: str, sql: str) -> None:
    """Registers f over views, by name and in order. sql is blank where SQL can't express the query."""
    wanted = views.split()
    QUERIES[name] = (lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in wanted)), ctes(sql) if sql else "")
