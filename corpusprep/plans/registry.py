"""Query registry: one Spark query per inventory operator, each with an
optional independent SQL oracle (DuckDB dialect) over the same tables.

A query is ``fn(spark, sf_dir) -> DataFrame``. Computed columns carry the
same aliases in both forms; doubles are rounded to 6 places and integers
are BIGINT so results compare value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: add ``fn`` under ``key`` (and its SQL oracle if given)."""

    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import queries_text, queries_chat, queries_logits, queries_mol, queries_prompts  # noqa: F401
    from . import queries_metric, queries_io, queries_stream, queries_udf, queries_tar  # noqa: F401
    from . import queries_eval  # noqa: F401
