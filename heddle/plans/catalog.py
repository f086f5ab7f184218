"""All registered queries of the core library with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _load() -> None:
    from heddle.plans import assembly_queries, draft_queries, evidence_queries, health_queries, io_queries, judge_queries, pipeline_queries, report_queries, text_queries, url_queries  # noqa: F401


_load()
