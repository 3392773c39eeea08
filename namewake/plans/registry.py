"""Registered queries and the DuckDB SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
GROUPS = ("zone_queries", "trend_queries", "listing_queries", "score_queries", "site_queries", "coverage_queries", "name_queries", "ledger_queries", "theme_queries", "stream_queries", "insight_queries", "miner_queries", "assessment_queries", "trending_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL if SQL can express it."""

    def add(function: Query) -> Query:
        _queries[name] = function
        if sql:
            _sql[name] = sql
        return function

    return add


def _load() -> None:
    for group in GROUPS:
        import_module(f"{__package__}.{group}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movement summary: what two snapshots of the name universe differ in."""
    _load()
    return _queries["d2_movement_summary"](spark, sf_dir)
