"""Matrix and vector-table operators.

Matrices are coordinate tables ``(i, j, w)`` of any size; vectors are
``array<double>`` columns. Reductions over a matrix axis are map-side
aggregates by that axis; join strategies are left to the planner.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.portable import normal
from ..functions.skew import heavy_hitter_join, heavy_keys


#: Labels at most for which a potential vector is broadcast (one label and one double each).
BROADCAST_LABELS = 500_000

#: Width of the exponent classes of a log-sum-exp; sums of ``exp(x - class * width)`` stay within doubles.
EXP_WIDTH = 64.0


def _log_sum_exp(df: DataFrame, axis: str, x: str, out: str) -> DataFrame:
    """``log(sum(exp(x)))`` per ``axis`` value, without a window and without a first pass for the maximum.

    Terms are summed map-side per (axis, exponent class), scaled by the class, so a dense row costs each task a few partial
    sums; the classes of one axis value (a handful) are then put together relative to the highest.
    """
    cls = F.floor(F.col(x) / F.lit(EXP_WIDTH))
    sums = df.groupBy(axis, cls.alias("__c")).agg(F.sum(F.exp(F.col(x) - cls * F.lit(EXP_WIDTH))).alias("__s"))
    parts = sums.groupBy(axis).agg(F.max("__c").alias("__top"), F.collect_list(F.struct("__c", "__s")).alias("__parts"))
    scaled = F.aggregate(
        "__parts", F.lit(0.0), lambda a, p: a + p["__s"] * F.exp((p["__c"] - F.col("__top")) * F.lit(EXP_WIDTH))
    )
    return parts.select(axis, (F.col("__top") * F.lit(EXP_WIDTH) + F.log(scaled)).alias(out))


def potentials(
    cells: DataFrame, iters: int = 5, tol: float | None = None, checkpoint_every: int = 10
) -> tuple[DataFrame, DataFrame, int, float | None]:
    """Row and column potentials of ``cells(i, j, w)``: ``exp(w + u + v)`` is balanced.

    Returns ``(rows(i, u), columns(j, v), rounds, residual)``. The cells are read, never rewritten: a round aggregates
    ``w + v`` to one number per row and ``w + u`` to one per column. With ``tol`` the iteration ends at the first round that
    after which every row sum is within ``tol`` of 1, or after ``iters`` rounds; ``residual`` is the largest deviation then. The
    row step of the next round yields it, so only the last test is an extra pass. Without ``tol`` there are ``iters`` rounds and it is None.

    A potential vector of at most ``BROADCAST_LABELS`` labels is broadcast. A longer one is joined, and rows or columns
    that hold more than their share of the cells meet their few potentials by a broadcast of their own.
    """
    from ..session import checkpoint_dir

    checkpoint_dir(cells.sparkSession)
    heavy = _heavy_labels(cells)
    cut = tol is not None or heavy is not None

    def sums(vector: DataFrame | None, by: str, axis: str, value: str) -> DataFrame:
        if vector is None:
            return _log_sum_exp(cells, axis, "w", "l")
        met = _meet(cells, vector, by, heavy)
        return _log_sum_exp(met.withColumn("__x", F.col("w") + F.col(value)), axis, "__x", "l")

    u = v = row_sums = residual = None
    rounds = 0
    for _ in range(int(iters)):
        row_sums = sums(v, "j", "i", "v") if row_sums is None else row_sums
        u = row_sums.select("i", (-F.col("l")).alias("u"))
        u = u.checkpoint(eager=True) if cut else u
        v = sums(u, "i", "j", "u").select("j", (-F.col("l")).alias("v"))
        rounds += 1
        if cut or (checkpoint_every and rounds % checkpoint_every == 0):
            v = v.checkpoint(eager=True)
        row_sums = None
        if tol is not None:
            # the row step of the next round also tells how far the rows are from 1 now
            row_sums = sums(v, "j", "i", "v").checkpoint(eager=True)
            residual = row_sums.join(u, "i").agg(F.max(F.abs(F.exp(F.col("l") + F.col("u")) - 1))).first()[0]
            if residual <= tol:
                break
    return u, v, rounds, residual


def _heavy_labels(cells: DataFrame) -> dict | None:
    """None where a vector of all labels may be broadcast; else the labels of each axis with a large share of the cells."""
    labels = cells.agg(F.approx_count_distinct("i").alias("n")).first()["n"]
    if labels <= BROADCAST_LABELS // 2:  # the estimate is within a few percent
        return None
    return {axis: heavy_keys(cells.groupBy(axis).agg(F.count(F.lit(1)).alias("n")), axis) for axis in ("i", "j")}


def _meet(cells: DataFrame, vector: DataFrame, axis: str, heavy: dict | None) -> DataFrame:
    if heavy is None:
        return cells.join(F.broadcast(vector), axis)
    return heavy_hitter_join(cells, vector, axis, heavy[axis])


def balance(
    df: DataFrame,
    i: str = "i",
    j: str = "j",
    logw: str = "w",
    iters: int = 5,
    out: str = "p",
    checkpoint_every: int = 10,
    tol: float | None = None,
) -> DataFrame:
    """Log-domain Sinkhorn balancing; ``iters`` rounds of (row log-sum-exp
    subtraction, then column log-sum-exp subtraction), kept as one potential per row and
    column (``potentials``); ``exp`` at the end. With ``tol`` it may end earlier.

    Columns sum to 1 (the column step is last), rows approximately. A null or ``-inf`` weight is a
    cell of weight zero and stays zero. The index set of the other cells must be square (same row and
    column labels), else the targets conflict; null labels, NaN and ``+inf`` raise. The
    lineage is cut with a reliable checkpoint in the shared checkpoint folder
    every ``checkpoint_every`` rounds (0 = never), which bounds the plan depth
    of long runs; the default 5 rounds need none.
    """
    from ..session import checkpoint_dir

    base = df.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(logw).cast("double").alias("w"))
    # the cell table is usually an aggregate of a much larger input: write it once
    # to the shared checkpoint folder so validation and the iterations reuse it
    checkpoint_dir(df.sparkSession)
    base = base.checkpoint(eager=True)
    zero = F.col("w").isNull() | (F.col("w") == F.lit(float("-inf")))
    filled = base.where(~zero)
    labels = filled.select(F.explode(F.array(
        F.struct(F.col("i").alias("label"), F.lit(1).alias("r"), F.lit(0).alias("c")),
        F.struct(F.col("j").alias("label"), F.lit(0).alias("r"), F.lit(1).alias("c")),
    )).alias("l"), "w").select("l.*", (F.isnan("w") | (F.col("w") == F.lit(float("inf")))).alias("bad"))
    per_label = labels.groupBy("label").agg(F.max("r").alias("r"), F.max("c").alias("c"), F.max("bad").alias("bad"))
    stats = per_label.agg(
        F.count(F.lit(1)).alias("labels"),
        F.sum(F.when((F.col("r") == 1) & (F.col("c") == 1), 1).otherwise(0)).alias("both"),
        F.max(F.col("bad") | F.col("label").isNull()).alias("bad"),
    ).first()
    if not stats["labels"]:
        raise ValueError("empty matrix")
    if stats["bad"]:
        raise ValueError("labels must not be null, weights neither NaN nor infinite")
    if stats["both"] != stats["labels"]:
        raise ValueError("balancing needs a square index set: every row label must also be a column label")
    zeros = base.where(zero).select(F.col("i").alias(i), F.col("j").alias(j), F.lit(0.0).alias(out))
    total = F.col("w")
    if int(iters) > 0:
        u, v, _, _ = potentials(filled, iters, tol, checkpoint_every)
        heavy = _heavy_labels(filled)
        filled = _meet(_meet(filled, u, "i", heavy), v, "j", heavy)
        total = total + F.col("u") + F.col("v")
    return filled.select(F.col("i").alias(i), F.col("j").alias(j), F.exp(total).alias(out)).unionByName(zeros)


def residuals(p: DataFrame, i: str = "i", j: str = "j", val: str = "p") -> DataFrame:
    """Largest |row sum - 1| and |column sum - 1| of a balanced table (one row)."""
    r = p.groupBy(i).agg(F.sum(val).alias("s")).agg(F.max(F.abs(F.col("s") - 1)).alias("row_residual"))
    c = p.groupBy(j).agg(F.sum(val).alias("s")).agg(F.max(F.abs(F.col("s") - 1)).alias("col_residual"))
    return r.withColumn("__k", F.lit(1)).join(c.withColumn("__k", F.lit(1)), "__k").drop("__k")


def mix(x: DataFrame, p: DataFrame, keys: list[str], lane: str = "lane", val: str = "x",
        o: str = "o", i: str = "i", pval: str = "p") -> DataFrame:
    """``y[key, o] = sum_i P[o, i] * x[key, i]`` for scalar or ``array<double>`` values.

    The mixing matrix is N x N with N the lane count. Arrays are summed element-wise over the N lanes of one
    output lane (a bounded group). A lane of ``x`` that is absent from ``P`` raises.
    """
    pm = p.select(F.col(o).alias("__o"), F.col(i).alias(lane), F.col(pval).cast("double").alias("__p"))
    joined = x.join(pm, lane, "left").withColumn(
        "__p", F.coalesce("__p", F.raise_error(F.lit("a lane is absent from the mixing matrix")).cast("double"))
    )
    is_array = isinstance(x.schema[val].dataType, T.ArrayType)
    if not is_array:
        return joined.groupBy(*keys, "__o").agg(F.sum(F.col("__p") * F.col(val)).alias("y")).withColumnRenamed("__o", lane)
    scaled = joined.select(*keys, "__o", F.transform(val, lambda v: v * F.col("__p")).alias("__v"))
    summed = scaled.groupBy(*keys, "__o").agg(F.collect_list("__v").alias("__vs"))
    first = F.col("__vs")[0]
    total = F.aggregate(
        F.slice("__vs", 2, F.size("__vs")), first, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)
    )
    return summed.select(*keys, F.col("__o").alias(lane), total.alias("y"))


def fan_out(df: DataFrame, key: str, vec: str, n: int = 4, sigma: float = 0.02, seed: int = 42, lane: str = "lane") -> DataFrame:
    """Copy each row to ``n`` lanes, each element plus ``sigma`` x a portable normal
    keyed by (seed, key, lane, element) — reproducible, partition-independent."""
    out = df.withColumn(lane, F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1))))
    k = F.col(key)
    ln = F.col(lane)
    return out.withColumn(
        vec, F.transform(F.col(vec), lambda v, d: v.cast("double") + F.lit(float(sigma)) * normal(seed, k, ln, d))
    )


def add_delta(df: DataFrame, vec: str, delta: str) -> DataFrame:
    """X3 (second half): add one delta vector to every lane."""
    return df.withColumn(vec, F.zip_with(F.col(vec), F.col(delta), lambda a, b: a + b))


def lane_mean(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Element-wise mean over the lanes of each key (lane groups are bounded by N)."""
    g = df.groupBy(*keys).agg(F.collect_list(F.col(vec).cast("array<double>")).alias("__vs"))
    first = F.col("__vs")[0]
    total = F.aggregate(
        F.slice("__vs", 2, F.size("__vs")), first, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)
    )
    n = F.size("__vs")
    return g.select(*keys, F.transform(total, lambda t: t / n).alias(vec))


def _sumsq(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def global_norm(df: DataFrame, vec: str) -> DataFrame:
    """Sqrt of the sum of squares over every element of every vector (one row)."""
    return df.agg(F.sqrt(F.sum(_sumsq(F.col(vec)))).alias("norm"))


def clip(df: DataFrame, vec: str, max_norm: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Scale every vector by ``min(1, max_norm / (norm + eps))``."""
    n = global_norm(df, vec).withColumn("__k", F.lit(1))
    scale = F.least(F.lit(1.0), F.lit(float(max_norm)) / (F.col("norm") + F.lit(eps)))
    # the norm is a one-row aggregate: a broadcast equi-join on a constant key
    return (
        df.withColumn("__k", F.lit(1))
        .join(F.broadcast(n), "__k")
        .withColumn(vec, F.transform(F.col(vec), lambda x: x.cast("double") * scale))
        .drop("__k", "norm")
    )


def layer_norm(
    df: DataFrame, vec: str, out: str | None = None, eps: float = 1e-5,
    gamma: list[float] | None = None, beta: list[float] | None = None,
) -> DataFrame:
    """``(v - mean) / sqrt(var + eps) * gamma + beta`` per vector, population variance.

    One pass over the vector gives count, mean and squared deviations; they are bound as a one-element array, so
    the element function reads them instead of computing them again. Linear in the vector's length.
    """
    v = F.col(vec).cast("array<double>")

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1.0
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + (x - acc["mean"]) * (x - mean)).alias("m2"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    stats = F.aggregate(
        v, zero, add, lambda acc: F.struct(acc["mean"].alias("mean"), F.sqrt(acc["m2"] / acc["n"] + F.lit(eps)).alias("sd"))
    )
    y = F.element_at(F.transform(F.array(stats), lambda s: F.transform(v, lambda x: (x - s["mean"]) / s["sd"])), 1)
    if gamma is not None:
        y = F.zip_with(y, F.array(*[F.lit(float(g)) for g in gamma]), lambda a, g: a * g)
    if beta is not None:
        y = F.zip_with(y, F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a + b)
    return df.withColumn(out or vec, y)


NS_COEFFS = (3.4445, -4.7750, 2.0315)  # fixed values: quintic Newton-Schulz coefficients (a, b, c)


def gram(df: DataFrame, vec: str) -> np.ndarray:
    """Column Gram matrix ``G^T G`` of a tall vector table.

    Each task multiplies its Arrow batch in numpy and emits one partial d x d
    block (flattened); Spark sums the partials. The driver receives d x d
    numbers, independent of the row count.
    """
    first = df.select(F.size(vec)).first()
    if first is None:
        raise ValueError("empty vector table")
    d = int(first[0])

    def partial(it):
        acc = np.zeros((d, d))
        for pdf in it:
            if len(pdf):
                m = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                acc += m.T @ m
        yield pd.DataFrame({"r": np.repeat(np.arange(d), d), "c": np.tile(np.arange(d), d), "g": acc.ravel()})

    parts = df.select(vec).mapInPandas(partial, "r int, c int, g double")
    rows = parts.groupBy("r", "c").agg(F.sum("g").alias("g")).collect()
    out = np.zeros((d, d))
    for r in rows:
        out[r["r"], r["c"]] = r["g"]
    return out


def orthogonalize(df: DataFrame, vec: str, steps: int = 5, eps: float = 1e-7, out: str | None = None) -> DataFrame:
    """Approximate orthogonalisation of a tall vector table (rows > dim).

    The reference normalises by the Frobenius norm, works on the wide
    transpose, and runs ``X <- aX + (bA + cA^2) X`` with ``A = X X^T``. Every
    step is a left multiplication by a d x d polynomial ``K`` of ``A``, so the
    whole iteration is one matrix ``M = K_s ... K_1`` built from the Gram matrix
    alone (``A <- K A K``), and each row becomes ``v / (||G|| + eps) . M^T``.
    One Spark aggregation (Gram), d x d work on the driver, one map pass.
    """
    n = df.count()
    g = gram(df, vec)
    d = g.shape[0]
    if n <= d:
        raise ValueError("orthogonalize needs more rows than dimensions (a tall table)")
    a, b, c = NS_COEFFS
    norm = math.sqrt(max(np.trace(g), 0.0))
    scale = 1.0 / (norm + eps)
    A = g * scale * scale
    M = np.eye(d)
    for _ in range(int(steps)):
        K = a * np.eye(d) + b * A + c * (A @ A)
        M = K @ M
        A = K @ A @ K
    W = (M.T * scale).astype(np.float64)  # row . W

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        m = np.stack(s.to_numpy()).astype(np.float64) @ W
        return pd.Series(list(m))

    return df.withColumn(out or vec, apply(F.col(vec)))
