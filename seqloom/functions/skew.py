"""Joins that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys at most that count as heavy; a heavy key holds more than 1/HEAVY_KEYS of the rows.
HEAVY_KEYS = 512


def heavy_keys(counts: DataFrame, key: str, n: str = "n", limit: int = HEAVY_KEYS) -> list:
    """Keys with more than ``1/limit`` of the rows, from ``counts(key, n)``; there are fewer than ``limit`` of them."""
    total = counts.agg(F.sum(n).alias("total")).first()["total"] or 0
    return [r[0] for r in counts.where((F.col(n) * limit > total) & F.col(key).isNotNull()).select(key).collect()]


def heavy_hitter_join(rows: DataFrame, table: DataFrame, key: str, heavy: list) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per key) on ``key``.

    Rows of the ``heavy`` keys meet their part of the table by a broadcast (as many rows as ``heavy`` has keys), so they
    are not shuffled by the key; all others by a join whose strategy the planner chooses. Rows with a null key are left out.
    """
    if not heavy:
        return rows.join(table, key)
    is_heavy = F.col(key).isin(heavy)
    often = rows.where(is_heavy).join(F.broadcast(table.where(is_heavy)), key)
    return often.unionByName(rows.where(~is_heavy).join(table.where(~is_heavy), key))
