"""Registered queries: one Spark builder per operator id, with its DuckDB oracle SQL.

Each builder takes ``(spark, sf_dir)`` and reads the driver's tables from
``sf_dir``; each oracle is ANSI SQL over the same tables registered as views.
Array outputs are reported as ``md5`` digests plus sizes so that the two
engines can be compared value for value; doubles are rounded to 6 digits on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    from . import io, matrix, metrics, prepare, sampling, scans  # noqa: F401
