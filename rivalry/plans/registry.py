"""Query registry: key → Spark builder, plus the equivalent DuckDB SQL.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the given
tables.  The SQL twin (when the operator is expressible in SQL) runs in DuckDB
on the same parquet files and serves as the correctness oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers on import)."""
    import importlib
    for name in ("q_prepare", "corpus", "q_text", "q_eval", "q_retrieval", "q_requests",
                 "q_ordered", "q_io", "q_ml", "q_stream"):
        importlib.import_module(f"rivalry.plans.{name}")
