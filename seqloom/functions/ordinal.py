"""Dense global ordinals and prefix sums without a single-partition window.

A global ``row_number()`` with no ``PARTITION BY`` pulls every row into one
task. Instead the rows carry a *bucket* that is monotone in the sort order:

1. count rows per bucket (a tiny table: one row per bucket);
2. exclusive prefix sum over the bucket counts (bounded table);
3. ``row_number()`` inside each bucket plus the bucket's offset.

The data is exchanged once, by bucket; the counts are computed from the same
exchange output (Spark reuses the exchange), so the input is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .portable import uniform


def _bucket_offsets(counts: DataFrame, bucket: str, value: str, out: str) -> DataFrame:
    # one row per bucket: small and bounded by the number of buckets
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn(out, F.sum(value).over(w) - F.col(value)).drop(value)


def global_ordinal(
    df: DataFrame,
    bucket: Column,
    order: list,
    name: str = "ordinal",
    partitions: int | None = None,
) -> DataFrame:
    """Add a dense 0-based ``name`` column in the order ``(bucket, *order)``.

    ``bucket`` must be monotone in ``order`` (rows in a lower bucket sort first).
    """
    b = "__bucket"
    keyed = df.withColumn(b, bucket)
    shuffled = keyed.repartition(partitions, b) if partitions else keyed.repartition(b)
    counts = shuffled.groupBy(b).agg(F.count(F.lit(1)).alias("__n"))
    offsets = _bucket_offsets(counts, b, "__n", "__off")
    w = Window.partitionBy(b).orderBy(*order)
    return (
        shuffled.join(F.broadcast(offsets), b)
        .withColumn(name, (F.row_number().over(w) - 1 + F.col("__off")).cast("bigint"))
        .drop(b, "__off")
    )


def default_buckets(df: DataFrame) -> int:
    """Buckets for an ordinal: several per shuffle partition, at least 1024.

    The per-bucket count table (one row per bucket) is what gets broadcast,
    so its size is bounded by this number.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1024, 8 * parts)


def shuffled_ordinal(df: DataFrame, key: str, seed: int, name: str = "ordinal", buckets: int | None = None) -> DataFrame:
    """Dense ordinal of a seeded full permutation: order by (uniform(seed, key), key).

    ``uniform`` is monotone-bucketable: bucket = floor(u * buckets) keeps the
    permutation order, and because u is uniform, buckets are balanced even when
    the key values are clustered.
    """
    buckets = buckets or default_buckets(df)
    u = "__u"
    keyed = df.withColumn(u, uniform(seed, F.col(key)))
    out = global_ordinal(keyed, F.floor(F.col(u) * buckets).cast("int"), [F.col(u), F.col(key)], name)
    return out.drop(u)


def natural_ordinal(df: DataFrame, order: list[str], name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Dense ordinal in the natural order of the ``order`` tuple, robust to hot values.

    ``repartitionByRange`` samples the whole tuple, so a first-column value that
    holds a large share of the rows is still spread over many partitions;
    rows are sorted within partitions and the result is checkpointed to the
    shared folder, which fixes the partitioning. The ordinal is then the
    partition's offset (a count per partition, one row each) plus the row's
    index inside its partition, read from ``monotonically_increasing_id``
    (partition id in the upper bits, index in the lower 33): no window at all.
    """
    from ..session import checkpoint_dir

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    checkpoint_dir(spark)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumn("__mid", mid).withColumn("__pid", F.shiftright("__mid", 33))
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = _bucket_offsets(counts, "__pid", "__n", "__off")  # one row per partition
    return (
        tagged.join(F.broadcast(offsets), "__pid")
        .withColumn(name, (F.col("__off") + F.col("__mid") - F.shiftleft(F.col("__pid"), 33)).cast("bigint"))
        .drop("__mid", "__pid", "__off")
    )


def exclusive_prefix_sum(
    df: DataFrame, key: str, value: str, name: str, block: int = 4096
) -> DataFrame:
    """Per-row exclusive prefix sum of ``value`` over an integer ``key`` (unique per row).

    Two-level: totals per block of ``block`` consecutive keys, a window over the
    block totals, then a window inside each block. No global single-task window.
    """
    blk = "__blk"
    keyed = df.withColumn(blk, F.floor(F.col(key) / F.lit(block)).cast("bigint"))
    totals = keyed.groupBy(blk).agg(F.sum(value).alias("__t"))
    offsets = _bucket_offsets(totals, blk, "__t", "__boff")
    w = Window.partitionBy(blk).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        keyed.join(offsets, blk)
        .withColumn(name, (F.sum(value).over(w) - F.col(value) + F.col("__boff")).cast("bigint"))
        .drop(blk, "__boff")
    )
