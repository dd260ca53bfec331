"""Named queries and, where SQL can say the same, the text another engine runs to check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (q_calibration, q_catalog, q_guidance, q_lattice, q_motion, q_ordered, q_pairs, q_reliability,  # noqa: F401
                   q_scalars, q_streaming, q_telemetry)
