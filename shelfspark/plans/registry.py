"""Registry of named queries: a Spark plan ``(spark, sf_dir) -> DataFrame`` and, where one can
be written, the DuckDB SQL that computes the same rows from the same driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def R(expr: str, digits: int) -> str:
    """SQL twin of ``functions.numeric.round_half_up``."""
    m = f"{10 ** digits}.0"
    return f"(FLOOR(({expr}) * {m} + 0.5) / {m})"


def load_all() -> None:
    """Import the modules that register queries."""
    from . import panel_queries, catalog_queries, crawl_queries, extra_queries  # noqa: F401
