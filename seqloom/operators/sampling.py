"""Top-k softmax per key, categorical draw, iterated sampling (K1-K3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.portable import uniform
from ..functions.skew import heavy_keys
from ..session import checkpoint_dir


def topk_softmax(df: DataFrame, key: str, item: str, score: str, k: int = 50, temperature: float = 0.8) -> DataFrame:
    """K1: divide by ``temperature`` first, keep the ``k`` largest per key, softmax
    over the survivors only. Ties rank by ``(score desc, item)``; fewer than ``k``
    candidates keep all.

    ``row_number() <= k`` over the key window becomes ``WindowGroupLimit``,
    applied before the shuffle as well: a hot key ships at most ``k`` rows per
    map task.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    s = F.col(score).cast("double") / F.lit(float(temperature))
    w = Window.partitionBy(key).orderBy(F.col("__s").desc(), F.col(item))
    ranked = df.select(key, item, s.alias("__s")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    g = Window.partitionBy(key)
    m = F.max("__s").over(g)
    e = F.exp(F.col("__s") - m)
    return ranked.withColumn("prob", e / F.sum(e).over(g)).select(
        key, item, F.col("rank").cast("bigint").alias("rank"), F.col("__s").alias("logit"), "prob"
    )


def draw(df: DataFrame, key: str, item: str, seed: int = 42, rank: str = "rank", prob: str = "prob",
         draw_key=None) -> DataFrame:
    """K2: one categorical draw per key from K1's output.

    ``u = uniform(seed, key)``; the first rank whose cumulative probability
    exceeds ``u`` wins, the last rank is the fallback for float rounding.
    """
    w = Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = uniform(seed, draw_key if draw_key is not None else F.col(key))
    c = df.withColumn("__cum", F.sum(prob).over(w)).withColumn("__u", u)
    hit = F.when(F.col("__cum") > F.col("__u"), F.col(rank))
    return c.groupBy(key).agg(
        F.coalesce(F.min_by(item, hit), F.max_by(item, rank)).alias(item),
        F.coalesce(F.min(hit), F.max(rank)).cast("bigint").alias(rank),
    )


#: Size of the sampling table (rows, bytes of keys and items) up to which every task holds it; beyond, walkers meet it by joins.
HELD_ROWS, HELD_BYTES = 2_000_000, 64 << 20


def sampling_table(probs: DataFrame) -> DataFrame:
    """One row per key from K1's output: ``key, items, cums`` in order of rank, ``cums`` the cumulative probabilities.

    Ordered as K1 ranks, so its exchange and its sort by key serve here as well.
    """
    w = Window.partitionBy("key").orderBy(F.col("logit").desc(), "item")
    cum = F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    every = F.collect_list(F.struct("item", "cum")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = probs.withColumn("cum", cum).withColumn("r", every).where(F.col("rank") == 1)
    return rows.select("key", F.col("r.item").alias("items"), F.col("r.cum").alias("cums"))


def _draw_from(u: Column) -> Column:
    """The first item whose cumulative probability exceeds ``u``; the last item as the fallback."""
    upto = F.size(F.filter("cums", lambda c: c <= u))  # cums do not fall
    return F.element_at("items", F.least(upto + 1, F.size("items")))


def sample_walk(
    prompts: DataFrame,
    table: DataFrame,
    walker: str,
    start: str,
    steps: int,
    eos: str | None = None,
    seed: int = 42,
    k: int = 50,
    temperature: float = 0.8,
    held_rows: int = HELD_ROWS,
) -> DataFrame:
    """K3: for many walkers at once, repeatedly draw the next item from a
    ``(key, item, score)`` table with K1 + K2 until ``eos`` or ``steps`` draws.

    Exactly one first draw and up to ``steps - 1`` more; the end item is
    emitted and then the walker stops; it is not checked before the first
    draw. A walker whose item is no key of the table stops as well.

    K1 gives a table of at most k rows per key. Up to ``held_rows`` rows (and HELD_BYTES), every task holds it and walks all
    steps of its walkers by binary search: walkers never move. Beyond, there is one join per step, of one row
    per walker with one row per key: items on which more than one of 512 walkers stand get their row by a broadcast,
    the others by a shuffle, and each step's walkers are checkpointed to the shared folder.

    Output: ``(walker, step, item)`` with ``step`` 0 for the prompt's last item.
    """
    checkpoint_dir(prompts.sparkSession)
    probs = topk_softmax(table.where(F.col("key").isNotNull()), "key", "item", "score", k=k, temperature=temperature)
    rows = sampling_table(probs).checkpoint()  # written once; both ways read it more than once
    active = prompts.select(F.col(walker).alias("walker"), F.col(start).alias("cur"))
    width = F.size("items").cast("bigint")
    text = width * F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)) + F.octet_length(
        F.concat_ws("", F.col("items").cast("array<string>"))
    )
    size = rows.agg(F.sum(width).alias("rows"), F.sum(text).alias("bytes")).first()
    if (size["rows"] or 0) <= held_rows and (size["bytes"] or 0) <= HELD_BYTES:
        return _walk_held(active, rows, int(steps), eos, seed)
    return _walk_joined(active, rows, int(steps), eos, seed)


def _walk_joined(active: DataFrame, rows: DataFrame, steps: int, eos: str | None, seed: int) -> DataFrame:
    active = active.checkpoint()  # walkers are few columns of a wide table, and each step reads them again
    out = active.select("walker", F.lit(0).cast("bigint").alias("step"), F.col("cur").alias("item"))
    spark = active.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tasks = min(parts, 2 * spark.sparkContext.defaultParallelism)  # of a step; else each step's union would add partitions
    rows = rows.withColumnRenamed("key", "cur").repartition(parts, "cur").sortWithinPartitions("cur").persist(StorageLevel.DISK_ONLY)
    often, known = None, {}  # rows of the items that were heavy in a step, each fetched once
    for t in range(1, steps + 1):
        heavy = heavy_keys(active.groupBy("cur").agg(F.count(F.lit(1)).alias("n")), "cur")
        if new := {repr(x): x for x in heavy if repr(x) not in known}:
            more = rows.where(F.col("cur").isin(list(new.values()))).checkpoint()
            often, known = more if often is None else often.unionByName(more), known | new
        if known:
            is_heavy = F.col("cur").isin(list(known.values()))
            met = active.where(is_heavy).join(F.broadcast(often), "cur").unionByName(active.where(~is_heavy).join(rows, "cur"))
        else:
            met = active.join(rows, "cur")
        drawn = met.select("walker", _draw_from(uniform(seed, F.col("walker"), F.lit(t))).alias("item")).coalesce(tasks).checkpoint()
        out = out.unionByName(drawn.select("walker", F.lit(t).cast("bigint").alias("step"), "item"))
        active = drawn.select("walker", F.col("item").alias("cur"))
        if eos is not None:
            active = active.where(F.col("cur") != F.lit(eos))
    rows.unpersist()
    return out


def _walk_held(active: DataFrame, rows: DataFrame, steps: int, eos: str | None, seed: int) -> DataFrame:
    spark = active.sparkSession
    entries = rows.select("key", F.posexplode(F.arrays_zip("items", "cums")).alias("rank", "r"))
    flat = entries.select("key", F.col("r.items").alias("item"), "rank", F.col("r.cums").alias("cum")).toArrow().sort_by(
        [("key", "ascending"), ("rank", "ascending")]
    )
    keys = flat.column("key").combine_chunks()
    first = np.flatnonzero(np.append(True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))) if len(keys) else np.zeros(0, int)
    names, items = keys.take(pa.array(first)), flat.column("item").combine_chunks()
    follows = pc.fill_null(pc.index_in(items, value_set=names), -1).to_numpy(zero_copy_only=False)  # key that an item is
    ends = pc.fill_null(pc.equal(items, pa.scalar(eos, items.type)), False).to_numpy(zero_copy_only=False) if eos is not None else np.zeros(len(items), bool)
    shared = spark.sparkContext.broadcast(
        {"names": names, "items": items, "first": np.append(first, len(keys)), "cum": flat.column("cum").to_numpy(),
         "follows": np.where(ends, -1, follows)}
    )
    draws = F.array(*[uniform(seed, F.col("walker"), F.lit(t)) for t in range(1, steps + 1)]) if steps else F.array().cast("array<double>")
    kinds = active.schema
    result = T.StructType().add("walker", kinds["walker"].dataType).add("step", "long").add("item", kinds["cur"].dataType)

    def run(batches):
        held = shared.value
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            walker, cur = b.column("walker"), b.column("cur")
            u = b.column("u").flatten().to_numpy(zero_copy_only=False).reshape(n, steps)
            yield pa.RecordBatch.from_arrays([walker, pa.array(np.zeros(n, np.int64)), cur], names=["walker", "step", "item"])
            key = pc.fill_null(pc.index_in(cur, value_set=held["names"]), -1).to_numpy(zero_copy_only=False)
            who = np.flatnonzero(key >= 0)
            key = key[who]
            for t in range(steps):
                if not len(who):
                    break
                at = first_above(held["cum"], held["first"][key], held["first"][key + 1], u[who, t])
                rows = [walker.take(pa.array(who)), pa.array(np.full(len(who), t + 1, np.int64)), held["items"].take(pa.array(at))]
                yield pa.RecordBatch.from_arrays(rows, names=["walker", "step", "item"])
                key = held["follows"][at]
                who, key = who[key >= 0], key[key >= 0]

    return active.withColumn("u", draws).mapInArrow(run, result)


def first_above(cum: np.ndarray, start: np.ndarray, stop: np.ndarray, u: np.ndarray) -> np.ndarray:
    """By binary search, the first place in ``cum[start:stop]`` above ``u``, else the last one; one search per row."""
    low, high = start.copy(), stop - 1
    while (low < high).any():
        middle = (low + high) // 2
        above = cum[middle] > u
        high = np.where(above, middle, high)
        low = np.where(above, low, np.minimum(middle + 1, high))
    return low
