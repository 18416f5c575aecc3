"""Where queries are collected: a name, a Spark plan and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(plan: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def load() -> None:
    from versespan.plans import (  # noqa: F401 - importing registers the queries
        cleaning, documents_out, ingest, lookups, ordering, references, searching, sheets, texts,
    )
