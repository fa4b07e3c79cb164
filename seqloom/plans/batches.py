"""Loader plans: shard assignment, batch plan, step annotation, accumulation (L1-L4)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import exclusive_prefix_sum, natural_ordinal


def assign_shards(files: DataFrame, workers: int | None, path: str = "path") -> DataFrame:
    """L1: contiguous shards. ``per = ceil(files / workers)``; worker ``w`` owns
    ranks ``[w*per, min((w+1)*per, files))``; trailing workers may own nothing;
    no worker count -> worker 0 owns everything.

    ``files`` is a listing (one row per file, e.g. ``scan_artifacts``). Its ranks come from ranges of
    paths with a count per range, so a long listing is not sorted in one task.
    """
    ranked = natural_ordinal(files, [path], name="file_rank")
    if not workers:
        return ranked.withColumn("worker", F.lit(0).cast("bigint"))
    per = max(1, math.ceil(ranked.count() / float(workers)))
    return ranked.withColumn("worker", F.floor(F.col("file_rank") / F.lit(per)).cast("bigint"))


def plan_batches(
    rows: DataFrame,
    shards: DataFrame,
    batch_size: int,
    file: str = "file",
    row: str = "row",
    path: str = "path",
) -> DataFrame:
    """L2: batches of ``batch_size`` rows formed inside each worker's shard, rows in
    file order, short last batch kept, one pass.

    ``row`` is the row's index in its file (Spark's ``_metadata.row_index``): from 0 without gaps, else the plan raises.
    A row's place in its worker is the count of rows in the files before plus ``row``; only the counts
    (one row per file) are summed up, the rows are not sorted. Files without rows take no place.

    The global ``step`` follows the loader's round-robin over workers: the
    b-th batch of worker w comes after every worker's batches < b and after
    the b-th batch of each lower worker that has one, i.e. the batches (one row each: their
    first) are numbered in the order (batch, worker).
    """
    per_file = rows.groupBy(F.col(file).alias("__f")).agg(F.count(F.lit(1)).alias("__n"), F.max(row).alias("__last"))
    dense = F.when(F.col("__last") + 1 != F.col("__n"), F.raise_error(F.lit("row indices of a file have gaps"))).otherwise(F.col("__n"))
    counted = shards.select(F.col(path).alias("__f"), "file_rank", "worker").join(per_file, "__f").withColumn("__n", dense)
    placed = exclusive_prefix_sum(counted.select("__f", "file_rank", "worker", "__n"), "file_rank", "__n", "__start")
    firsts = placed.groupBy("worker").agg(F.min("__start").alias("__w0"))  # one row per worker
    places = placed.join(firsts, "worker").select(
        F.col("__f").alias(file), "file_rank", "worker", (F.col("__start") - F.col("__w0")).alias("__before")
    )
    j = rows.join(places, file)
    j = j.withColumn("ordinal_in_worker", (F.col("__before") + F.col(row)).cast("bigint")).drop("__before")
    j = j.withColumn("batch", F.floor(F.col("ordinal_in_worker") / F.lit(int(batch_size))).cast("bigint"))
    heads = j.where(F.col("ordinal_in_worker") % F.lit(int(batch_size)) == 0).select("batch", "worker")
    return j.join(natural_ordinal(heads, ["batch", "worker"], name="step"), ["batch", "worker"])


def lr_multiplier(step, warmup: int, max_steps: int):
    """Warm-up then cosine multiplier (unclamped past ``max_steps``, as in the reference)."""
    s = F.col(step).cast("double") if isinstance(step, str) else step.cast("double")
    warm = s / F.lit(float(max(1, warmup)))
    progress = (s - F.lit(float(warmup))) / F.lit(float(max(1, max_steps - warmup)))
    cosine = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress))
    return F.when(s < F.lit(float(warmup)), warm).otherwise(cosine)


def annotate_steps(
    batches: DataFrame,
    start: int = 0,
    max_steps: int = 100_000,
    warmup: int = 1000,
    accum: int = 1,
    every: int = 1000,
    step: str = "step",
    base_rates: dict[str, float] | None = None,
    skip_rows: int = 0,
) -> DataFrame:
    """L3: the batch table with each batch's global step and run flags.

    ``global_step = start + step``; rows with ``global_step >= max_steps`` are
    dropped; rate multiplier per ``lr_multiplier`` times each base rate
    (matrix 0.01, vector 0.001 by default); accumulation opens at
    ``global_step % accum == 0`` and closes at ``(global_step + 1) % accum == 0``;
    log at ``global_step % 10 == 0``; checkpoint when ``global_step > start`` and
    ``global_step % every == 0``. ``skip_rows`` > 0 resumes the data after that many steps
    instead of restarting it (the reference restarts): the first step kept is numbered ``start``.
    """
    rates = base_rates or {"lr_matrix": 0.01, "lr_vector": 0.001}
    df = batches
    if skip_rows:
        df = df.where(F.col(step) >= F.lit(int(skip_rows)))
    g = (F.col(step) - F.lit(int(skip_rows)) + F.lit(int(start))).cast("bigint")
    df = df.withColumn("global_step", g).where(F.col("global_step") < F.lit(int(max_steps)))
    mult = lr_multiplier("global_step", warmup, max_steps)
    df = df.withColumn("lr_mult", mult)
    for name, base in rates.items():
        df = df.withColumn(name, F.lit(float(base)) * F.col("lr_mult"))
    gs = F.col("global_step")
    return df.withColumns(
        {
            "accum_open": gs % F.lit(int(accum)) == 0,
            "accum_close": (gs + 1) % F.lit(int(accum)) == 0,
            "log": gs % F.lit(10) == 0,
            "checkpoint": (gs > F.lit(int(start))) & (gs % F.lit(int(every)) == 0),
        }
    )


def steps_report(batches: DataFrame, start: int = 0, max_steps: int = 100_000, step: str = "step") -> DataFrame:
    """How many of the configured steps one pass over the data can reach (one row).

    A pass yields ``batches`` steps; the run stops at ``max_steps``, so the
    reachable count is ``min(batches, max_steps - start)``; the schedule's
    tail beyond it is never visited.
    """
    n = batches.agg(F.countDistinct(step).cast("bigint").alias("batches"))
    return n.select(
        "batches",
        F.least(F.col("batches"), F.lit(int(max(0, max_steps - start)))).cast("bigint").alias("reachable_steps"),
        F.lit(int(max_steps)).cast("bigint").alias("max_steps"),
        (F.col("batches") < F.lit(int(max(0, max_steps - start)))).alias("schedule_truncated"),
    )


def accumulate(df: DataFrame, step: str, vec: str, k: int) -> DataFrame:
    """L4: un-averaged element-wise sum of the per-step vectors in each window of
    ``k`` steps (``step div k``); a trailing window without its closing step
    (``step % k == k - 1``) is never emitted."""
    w = F.floor(F.col(step) / F.lit(int(k))).cast("bigint")
    exploded = df.select(w.alias("window"), F.col(step).alias("__s"), F.posexplode(F.col(vec)).alias("__d", "__v"))
    sums = exploded.groupBy("window", "__d").agg(
        F.sum(F.col("__v").cast("double")).alias("__v"), F.max(F.col("__s") % F.lit(int(k)) == F.lit(int(k) - 1)).alias("__closed")
    )
    return (
        sums.where("__closed")
        .groupBy("window")
        .agg(F.array_sort(F.collect_list(F.struct("__d", "__v"))).alias("__dv"))
        .select("window", F.transform("__dv", lambda x: x["__v"]).alias(vec))
    )
