"""Retention and version selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_newest(df: DataFrame, group: list[str], order: list[str], k: int = 2, out: str = "keep") -> DataFrame:
    """Flag the ``k`` newest rows per group by ``order`` (descending); the rest
    is the removal set. Returns a table; deletes nothing. ``order`` should end
    with a unique tiebreak (rows tied on the whole order tuple share a flag).

    The k newest per group come from ``row_number() <= k``, which runs as
    ``WindowGroupLimit`` before the shuffle (a hot group ships at most k rows
    per map task); their oldest order tuple is the group's threshold (one row
    per group), joined back to flag every row. No group is sorted in one task.
    """
    tup = F.struct(*[F.col(c) for c in order])
    # the group as one struct column: joining on it keeps null group values together
    g = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(1).alias("all"))
    keyed = df.withColumn("__grp", g)
    w = Window.partitionBy("__grp").orderBy(*[F.col(c).desc() for c in order])
    top = keyed.select("__grp", *order).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    thr = top.groupBy("__grp").agg(F.min(F.struct(*[F.col(c) for c in order])).alias("__thr"))
    joined = keyed.join(thr, "__grp", "left")
    return joined.withColumn(out, F.coalesce(tup >= F.col("__thr"), F.lit(False))).drop("__thr", "__grp")


def latest_version(df: DataFrame, name: str, pattern: str = r"model_step_(\d+)\.pt", group: list[str] | None = None) -> DataFrame:
    """R2: the numerically largest version parsed from ``name`` (not the newest
    by time); names that do not match are ignored."""
    v = F.regexp_extract(F.col(name), pattern, 1)
    matched = df.where(F.col(name).rlike(pattern)).withColumn("version", v.cast("bigint"))
    keys = group or []
    return matched.groupBy(*keys).agg(
        F.max("version").alias("version"), F.max_by(F.col(name), F.col("version")).alias(name)
    )
