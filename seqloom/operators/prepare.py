"""The corpus preparation chain fused for the fewest exchanges (T1 + M2 + M3 + T3 + T4).

Same result as ``take(shuffle(docs)) -> encode -> pack -> mask_pairs``, with the
documents exchanged once:

1. take-N as a filter on the unshuffled input (``take_unordered``), vocabulary
   pass and encode in place: documents are int arrays before anything moves;
2. one exchange by shuffle bucket ``floor(u * B)`` numbers the documents
   (``row_number`` inside the bucket + the bucket's offset);
3. a pack group (``group_docs`` consecutive ordinals) that lies inside one
   bucket is packed where it is: its windows and chunk regroup are keyed by
   ``(bucket, group)``, which the bucket partitioning already satisfies;
4. only groups that straddle a bucket boundary (at most one per bucket) are
   exchanged by group and packed there;
5. sequence ids (dense in ``(group, chunk)`` order): inside a bucket, a running
   window over one flagged row per group gives each group's base; buckets add
   an offset from a one-row-per-bucket table (broadcast), so chunk rows are
   never joined or moved again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import default_buckets
from ..functions.portable import uniform
from .mixing import take_unordered
from .sequences import MASK_ID, build_vocab, encode, mask_pairs


def _chunks(d: DataFrame, C: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pack documents ``(keys..., group_id, __ord, __ids)`` whose groups are whole
    within ``keys + [group_id]``; returns (chunk rows, per-group chunk counts)."""
    part = keys + ["group_id"]
    d = d.withColumn("__n", F.size("__ids").cast("bigint"))
    run = Window.partitionBy(*part).orderBy("__ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)
    d = d.withColumn("__start", F.sum("__n").over(run) - F.col("__n")).withColumn(
        "__chunks", F.floor(F.sum("__n").over(whole) / F.lit(C)).cast("bigint")
    )
    groups = d.groupBy(*part).agg(F.first("__chunks").alias("__chunks"))
    live = d.where((F.col("__n") > 0) & (F.col("__start") < F.col("__chunks") * C))
    first = F.floor(F.col("__start") / F.lit(C))
    last = F.least(F.floor((F.col("__start") + F.col("__n") - 1) / F.lit(C)), F.col("__chunks") - 1)
    pieces = live.select(*part, "__start", "__n", "__ids", F.explode(F.sequence(first, last)).alias("chunk"))
    lo = F.greatest(F.col("chunk") * C, F.col("__start"))
    hi = F.least((F.col("chunk") + 1) * C, F.col("__start") + F.col("__n"))
    pieces = pieces.select(
        *part,
        "chunk",
        F.struct(lo.alias("o"), F.slice("__ids", (lo - F.col("__start") + 1).cast("int"), (hi - lo).cast("int")).alias("p")).alias("__pc"),
    )
    seqs = pieces.groupBy(*part, "chunk").agg(F.sort_array(F.collect_list("__pc")).alias("__pcs"))
    seqs = seqs.select(*part, F.col("chunk").cast("bigint").alias("chunk"), F.flatten(F.col("__pcs.p")).alias("input_ids"))
    return seqs, groups


def prepare_pairs(
    docs: DataFrame,
    key: str,
    text: str = "text",
    n: int | None = None,
    seq_len: int = 4096,
    group_docs: int = 1000,
    vocab_size: int = 32_000,
    p: float = 0.15,
    mask_id: int = MASK_ID,
    seed: int = 42,
    vocab: DataFrame | None = None,
    buckets: int | None = None,
    max_sequences: int | None = None,
) -> DataFrame:
    """``(seq_id, context_ids, target_ids)`` for the documents in the seeded permutation
    of ``docs``, all or the first ``n`` (see the module docstring for the plan)."""
    C = int(seq_len) + 1
    G = int(group_docs)
    spark = docs.sparkSession
    u = uniform(seed, F.col(key))
    base = docs.select(key, text)
    # one counting pass at a fine bucket count F (rows per fine bucket, at most F rows
    # to the driver); coarser buckets are integer divisions of it: floor(u*F) div m = floor(u*F/m)
    Fb = default_buckets(docs)
    fine_of = lambda frame: dict(
        (r[0], r[1]) for r in frame.groupBy(F.floor(u * Fb).cast("int").alias("b")).count().collect()
    )
    fine = fine_of(base)
    if n is None or n >= sum(fine.values()):
        selected = base
    else:
        selected = take_unordered(base, key, n, seed=seed, buckets=Fb)
        fine = fine_of(selected)
    total = sum(fine.values())
    if buckets:
        m = max(1, Fb // int(buckets))
    else:
        # buckets much larger than groups keep most groups inside one bucket; never
        # fewer buckets than the cluster's parallelism
        target = max(spark.sparkContext.defaultParallelism, total // (4 * G))
        m = max(1, Fb // max(1, target))
    counts: dict[int, int] = {}
    for fb, c in fine.items():
        counts[fb // m] = counts.get(fb // m, 0) + c
    vocab = vocab if vocab is not None else build_vocab(selected, size=vocab_size, text=text)
    enc = encode(selected, vocab, keys=[key], text=text, out="__ids")
    enc = enc.withColumn("__u", u).withColumn(
        "bucket", F.floor(F.floor(F.col("__u") * F.lit(Fb)) / F.lit(m)).cast("int")
    )

    off_rows, acc = [], 0
    for b in sorted(counts):
        off_rows.append((b, acc))
        acc += counts[b]
    offsets = spark.createDataFrame(off_rows, "bucket int, __off bigint")  # at most B rows
    # groups crossing a bucket boundary: the group holding a bucket's first ordinal
    # when that ordinal is not a multiple of G (at most one per bucket)
    split_groups = sorted({off // G for _, off in off_rows if off % G})
    split_df = spark.createDataFrame([(g,) for g in split_groups], "group_id bigint")

    shuffled = enc.repartition("bucket")
    w = Window.partitionBy("bucket").orderBy("__u", key)
    numbered = (
        shuffled.join(F.broadcast(offsets), "bucket")
        .withColumn("__ord", (F.row_number().over(w) - 1 + F.col("__off")).cast("bigint"))
        .withColumn("group_id", F.floor(F.col("__ord") / F.lit(G)).cast("bigint"))
        .join(F.broadcast(split_df.withColumn("__split", F.lit(True))), "group_id", "left")
        .select("bucket", "group_id", "__ord", "__ids", F.coalesce("__split", F.lit(False)).alias("__split"))
    )

    # groups that straddle buckets: exchanged by group and packed there (few rows)
    remote_seqs, remote_groups = _chunks(numbered.where(F.col("__split")).drop("__split", "bucket"), C, [])
    # home bucket of a split group = the bucket holding its first ordinal; it is the
    # last group that starts in that bucket (bounded table: one row per bucket at most)
    starts = sorted(off for _, off in off_rows)
    bucket_of_start = {off: b for b, off in off_rows}
    import bisect

    homes = []
    for g in split_groups:
        i = bisect.bisect_right(starts, g * G) - 1
        homes.append((g, bucket_of_start[starts[i]]))
    home_df = spark.createDataFrame(homes, "group_id bigint, bucket int")
    split_chunks = remote_groups.join(F.broadcast(home_df), "group_id").groupBy("bucket").agg(
        F.sum("__chunks").alias("__split_chunks")
    )

    # groups inside one bucket: packed in place. Their sequence base is computed
    # inside the bucket partition (a running window over one flagged row per group)
    # plus a per-bucket offset from a bounded broadcast table, so the chunk rows
    # never move again.
    d = numbered.where(~F.col("__split")).drop("__split").withColumn("__n", F.size("__ids").cast("bigint"))
    part = ["bucket", "group_id"]
    run = Window.partitionBy(*part).orderBy("__ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)
    d = (
        d.withColumn("__start", F.sum("__n").over(run) - F.col("__n"))
        .withColumn("__chunks", F.floor(F.sum("__n").over(whole) / F.lit(C)).cast("bigint"))
        .withColumn("__head", F.col("__ord") == F.min("__ord").over(whole))
    )
    flagged = F.when(F.col("__head"), F.col("__chunks")).otherwise(F.lit(0).cast("bigint"))
    in_bucket = Window.partitionBy("bucket").orderBy("group_id", "__ord").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    d = d.withColumn("__prefix", F.sum(flagged).over(in_bucket) - F.col("__chunks"))
    local_totals = d.where("__head").groupBy("bucket").agg(F.sum("__chunks").alias("__local_chunks"))
    per_bucket = (
        spark.createDataFrame([(b,) for b, _ in off_rows], "bucket int")
        .join(local_totals, "bucket", "left")
        .join(split_chunks, "bucket", "left")
        .select(
            "bucket",
            F.coalesce("__local_chunks", F.lit(0)).cast("bigint").alias("__local_chunks"),
            F.coalesce("__split_chunks", F.lit(0)).cast("bigint").alias("__split_chunks"),
        )
    )
    # one row per bucket: a single ordered window over it is bounded
    wb = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total_b = F.col("__local_chunks") + F.col("__split_chunks")
    per_bucket = per_bucket.withColumn("__bucket_base", F.sum(total_b).over(wb) - total_b)
    d = d.join(F.broadcast(per_bucket.select("bucket", "__bucket_base")), "bucket").withColumn(
        "__seq_base", F.col("__bucket_base") + F.col("__prefix")
    )
    live = d.where((F.col("__n") > 0) & (F.col("__start") < F.col("__chunks") * C))
    first = F.floor(F.col("__start") / F.lit(C))
    last = F.least(F.floor((F.col("__start") + F.col("__n") - 1) / F.lit(C)), F.col("__chunks") - 1)
    pieces = live.select(*part, "__seq_base", "__start", "__n", "__ids", F.explode(F.sequence(first, last)).alias("chunk"))
    lo = F.greatest(F.col("chunk") * C, F.col("__start"))
    hi = F.least((F.col("chunk") + 1) * C, F.col("__start") + F.col("__n"))
    pieces = pieces.select(
        *part,
        "__seq_base",
        "chunk",
        F.struct(lo.alias("o"), F.slice("__ids", (lo - F.col("__start") + 1).cast("int"), (hi - lo).cast("int")).alias("p")).alias("__pc"),
    )
    local = pieces.groupBy(*part, "chunk").agg(
        F.first("__seq_base").alias("__seq_off"), F.sort_array(F.collect_list("__pc")).alias("__pcs")
    ).select(*part, "__seq_off", F.col("chunk").cast("bigint").alias("chunk"), F.flatten(F.col("__pcs.p")).alias("input_ids"))

    # a split group's base: its home bucket's base plus that bucket's local chunks
    split_base = home_df.join(F.broadcast(per_bucket), "bucket").select(
        "group_id", (F.col("__bucket_base") + F.col("__local_chunks")).alias("__seq_off")
    )
    remote = remote_seqs.join(F.broadcast(split_base), "group_id")
    cols = [(F.col("__seq_off") + F.col("chunk")).cast("bigint").alias("seq_id"), "group_id", "chunk", "input_ids"]
    seqs = local.select(*cols).unionByName(remote.select(*cols))
    if max_sequences is not None:
        seqs = seqs.where(F.col("seq_id") < F.lit(int(max_sequences)))
    return mask_pairs(seqs, p=p, mask_id=mask_id, seed=seed)
