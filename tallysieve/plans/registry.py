"""Query register: name -> (Spark builder, optional oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql.strip()
        return build

    return add


def load() -> tuple[dict[str, Builder], dict[str, str]]:
    from tallysieve.plans import (  # noqa: F401  (import registers the queries)
        queries_evidence,
        queries_pairs,
        queries_metrics,
        queries_ranking,
        queries_sources,
    )

    return dict(QUERIES), dict(ORACLE)
