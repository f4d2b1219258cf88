"""Query registry shared by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans.fixtures import P_ORDER, view

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}

P_ORD_SQL = ", ".join(P_ORDER)
C_ORD_SQL = "kind_rank, seq"


def register(name: str, sql: str | None):
    """Register a Spark query under ``name`` with its DuckDB oracle (None → rows-only)."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def P(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    return view(spark, sf, "P", dealt)


def C(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "C")


def E(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "E")
