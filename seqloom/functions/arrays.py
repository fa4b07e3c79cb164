"""Array helpers shared by operators and by the checkable query outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(col: str | Column) -> Column:
    """md5 of the elements joined by '|' (DuckDB: ``md5(array_to_string(x, '|'))``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), "|"))


def digest_sql(expr: str) -> str:
    return f"md5(array_to_string({expr}, '|'))"


def count_eq(col: str | Column, value) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.size(F.filter(c, lambda x: x == F.lit(value))).cast("bigint")
