"""Aggregated losses, checks and reports."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import next_token_pairs

IGNORE_INDEX = -100


LOWEST = -1.7976931348623157e308


def _lse(scores: Column) -> Column:
    """Log-sum-exp in one pass over the array: the largest value so far and the sum scaled by it."""

    def add(acc: Column, s: Column) -> Column:
        top = F.greatest(acc["top"], s)
        return F.struct(top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(s - top)).alias("sum"))

    zero = F.struct(F.lit(LOWEST).alias("top"), F.lit(0.0).alias("sum"))
    return F.aggregate(scores, zero, add, lambda acc: acc["top"] + F.log(acc["sum"]))


def row_cross_entropy(scores: Column, label: Column) -> Column:
    """``logsumexp(scores) - scores[label]`` for one row (label is 0-based); linear in the array's length."""
    s = scores.cast("array<double>")
    return _lse(s) - F.element_at(s, (label + 1).cast("int"))


def cross_entropy(df: DataFrame, scores: str, label: str, ignore: int = IGNORE_INDEX, where: Column | None = None) -> DataFrame:
    """G1: mean over rows of ``logsumexp(scores) - scores[label]``; rows with the
    ignore label leave both the sum and the count. All ignored -> null."""
    keep = F.col(label) != F.lit(ignore)
    if where is not None:
        keep = keep & where
    loss = F.when(keep, row_cross_entropy(F.col(scores), F.col(label)))
    return df.agg(F.avg(loss).alias("loss"), F.count(loss).cast("bigint").alias("rows"))


def shifted_cross_entropy(df: DataFrame, key: str, scores: str, labels: str, ignore: int = IGNORE_INDEX) -> DataFrame:
    """The scores at position ``t`` of a sequence against the label at ``t + 1``; mean over all such pairs.

    ``scores`` is an array of score vectors, ``labels`` an array of the same length (else it raises). Pairs whose label is
    ``ignore`` or null leave the sum and the count; sequences of fewer than two positions have no pair.
    """
    paired = F.when(F.size(scores) == F.size(labels), F.arrays_zip(F.col(scores).alias("s"), F.col(labels).alias("l"))).otherwise(
        F.raise_error(F.lit("scores and labels of a sequence differ in length"))
    )
    steps = next_token_pairs(df.select(key, paired.alias("__steps")), key, "__steps", score="now", label="next")
    return cross_entropy(steps.select(F.col("now.s").alias("s"), F.col("next.l").alias("l")), "s", "l", ignore)


def cross_entropy_long(
    scores: DataFrame, labels: DataFrame, key: str, item: str, score: str, label: str, ignore=IGNORE_INDEX
) -> DataFrame:
    """G1, long form: scores as rows ``(key, item, score)``, labels as ``(key, label)``.

    Per key, ``logsumexp`` over its items minus the score of the label item; mean over keys whose label is not
    ``ignore``. One exchange by key: the largest score is a window over it, then one aggregate. A key whose
    label has no score, or that has no scores at all, raises.
    """
    lab = labels.where(F.col(label) != F.lit(ignore)).select(key, F.col(label).alias("__label"))
    s = lab.join(scores.select(key, F.col(item).alias("__item"), F.col(score).cast("double").alias("__s")), key, "left")
    top = F.max("__s").over(Window.partitionBy(key))
    per_key = s.withColumn("__m", top).groupBy(key).agg(
        (F.first("__m") + F.log(F.sum(F.exp(F.col("__s") - F.col("__m"))))).alias("__lse"),
        F.max(F.when(F.col("__item") == F.col("__label"), F.col("__s"))).alias("__own"),
    )
    loss = F.when(F.col("__own").isNull(), F.raise_error(F.lit("a label has no score"))).otherwise(F.col("__lse") - F.col("__own"))
    return per_key.agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).cast("bigint").alias("rows"))


def paired_mse(a: DataFrame, b: DataFrame, key: str, va: str, vb: str) -> DataFrame:
    """Mean over all elements of ``(a - b)^2`` between two vector tables joined on key (one-row frame, evaluated now).

    Every position counts. The tables must pair up one to one, else it raises ``ValueError``.
    """
    try:
        res = paired_mse_frame(a, b, key, va, vb).first()
    except PySparkException as e:
        if MISPAIRED in str(e):
            raise ValueError(MISPAIRED) from e
        raise
    return a.sparkSession.createDataFrame([(res["mse"], res["pairs"])], "mse double, pairs bigint")


MISPAIRED = "paired tables differ in size or shape"


def paired_mse_frame(a: DataFrame, b: DataFrame, key: str, va: str, vb: str) -> DataFrame:
    """G2, lazy: one-row frame with ``mse`` and ``pairs``.

    One full outer join counts what does not pair up: keys of one table only, vectors of different lengths and
    keys that occur more than once; the result raises if there is any.
    """
    left = a.groupBy(key).agg(F.first(va).alias("__a"), F.count(F.lit(1)).alias("__na"))
    right = b.groupBy(key).agg(F.first(vb).alias("__b"), F.count(F.lit(1)).alias("__nb"))
    j = left.withColumn("__k", F.struct(key)).drop(key).join(right.withColumn("__k", F.struct(key)).drop(key), "__k", "full_outer")
    bad = (
        F.col("__a").isNull() | F.col("__b").isNull() | (F.coalesce("__na", F.lit(0)) != 1) | (F.coalesce("__nb", F.lit(0)) != 1)
        | (F.size("__a") != F.size("__b"))
    )
    sq = F.aggregate(
        F.zip_with("__a", "__b", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    res = j.agg(
        (F.sum(sq) / F.sum(F.size("__a"))).alias("mse"),
        F.count(F.lit(1)).cast("bigint").alias("pairs"),
        F.sum(F.when(bad, 1).otherwise(0)).alias("__bad"),
    )
    return res.select(
        F.when(F.col("__bad") > 0, F.raise_error(F.lit(MISPAIRED))).otherwise(F.col("mse")).alias("mse"), "pairs"
    )


def combine(losses: dict[str, DataFrame], weights: dict[str, float], out: str = "total") -> DataFrame:
    """Weighted objective over one-row loss frames, e.g. ``gen + 0.5 * latent``.

    Each input is a one-row aggregate with a ``loss`` column; they are joined on a
    constant key (one row each) and summed with the weights.
    """
    names = list(losses)
    cur = None
    for n in names:
        f = losses[n].select(F.lit(1).alias("__k"), F.col("loss").alias(n))
        cur = f if cur is None else cur.join(f, "__k")
    total = None
    for n in names:
        term = F.lit(float(weights.get(n, 1.0))) * F.col(n)
        total = term if total is None else total + term
    return cur.select(*names, total.alias(out))


def trend(df: DataFrame, step: str, loss: str, every: int = 10) -> DataFrame:
    """V1: does the loss decrease over the logged steps (``step % every == 0``)?

    Least-squares slope of loss on step; ``decreasing`` when it is negative.
    """
    logged = df.where(F.col(step) % F.lit(int(every)) == 0)
    return logged.agg(
        F.regr_slope(F.col(loss).cast("double"), F.col(step).cast("double")).alias("slope"),
        F.count(F.lit(1)).cast("bigint").alias("points"),
    ).withColumn("decreasing", F.col("slope") < 0)


def check_rectangular(df: DataFrame, cols: list[str], file_col: str = "file") -> DataFrame:
    """V2: per file, min and max array length of each column; ``ok`` when all are one length."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.size(c)).alias(f"{c}_min"), F.max(F.size(c)).alias(f"{c}_max")]
    g = df.groupBy(file_col).agg(*aggs, F.count(F.lit(1)).cast("bigint").alias("rows"))
    lens = [F.col(f"{c}_{s}") for c in cols for s in ("min", "max")]
    ok = F.lit(True)
    for x in lens[1:]:
        ok = ok & (x == lens[0])
    return g.withColumn("ok", ok)


def non_finite(vec: Column) -> Column:
    return F.exists(vec, lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))


def check_finite(df: DataFrame, vec: str) -> DataFrame:
    """V2: count of rows holding a NaN or infinite element (0 means clean)."""
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.sum(F.when(non_finite(F.col(vec)), 1).otherwise(0)).cast("bigint").alias("non_finite_rows"),
    )
