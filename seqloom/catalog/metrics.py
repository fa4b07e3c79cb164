"""Loss, check and report queries: G1-G3, V1, V2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import r6, r6_sql
from ..operators.matrix import layer_norm
from ..operators.metrics import (
    check_finite, check_rectangular, combine, cross_entropy, cross_entropy_long, paired_mse_frame, shifted_cross_entropy,
    trend,
)
from ..operators.scans import surprise
from . import register, table
from .scans import _SQL_VEC, scanned_vectors

LATENT_WEIGHT = 0.5  # reference: gen + 0.5 * latent
MEMORY_WEIGHT = 0.01  # reference: gen + 0.01 * memory
SEQUENCE = 50  # consecutive vectors that make one sequence of scores and labels


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


_SQL_CE = """
ce AS (
  SELECT avg(list_max(v) + ln(list_sum(list_transform(v, lambda s: exp(s - list_max(v))))) - v[label + 1]) AS loss,
         count(*) AS rows
  FROM (SELECT CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE label <> -100) t)"""

_SQL_MSE = """
lnorm AS (
  SELECT vec_id, v, list_transform(v, lambda x: (x - mean) / sqrt(var + 1e-5)) AS y
  FROM (SELECT vec_id, v, mean, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / len(v) AS var
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_avg(CAST(embedding AS DOUBLE[])) AS mean FROM embeddings) a) b),
mse AS (
  SELECT sum(list_sum(list_transform(list_zip(v, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / sum(len(v)) AS loss,
         count(*) AS pairs
  FROM lnorm)"""


@register("g1_cross_entropy", "WITH " + _SQL_CE + f"\nSELECT {r6_sql('loss')} AS loss, CAST(rows AS BIGINT) AS rows FROM ce")
def g1_cross_entropy(spark, sf_dir):
    return cross_entropy(_emb(spark, sf_dir), "embedding", "label").select(r6("loss").alias("loss"), "rows")


@register("g1_cross_entropy_long", "WITH " + _SQL_CE + f"\nSELECT {r6_sql('loss')} AS loss, CAST(rows AS BIGINT) AS rows FROM ce")
def g1_cross_entropy_long(spark, sf_dir):
    e = _emb(spark, sf_dir)
    long = e.select("vec_id", F.posexplode("embedding").alias("item", "score"))
    ce = cross_entropy_long(long, e.select("vec_id", "label"), "vec_id", "item", "score", "label")
    return ce.select(r6("loss").alias("loss"), "rows")


def _mse(spark, sf_dir):
    e = _emb(spark, sf_dir)
    ln = layer_norm(e, "embedding", out="y").select("vec_id", "y")
    return paired_mse_frame(e, ln, "vec_id", "embedding", "y")


@register("g2_paired_mse", "WITH " + _SQL_MSE + f"\nSELECT {r6_sql('loss')} AS mse, CAST(pairs AS BIGINT) AS pairs FROM mse")
def g2_paired_mse(spark, sf_dir):
    return _mse(spark, sf_dir).select(r6("mse").alias("mse"), "pairs")


@register(
    "g3_combine",
    "WITH " + _SQL_CE + "," + _SQL_MSE
    + f"""
SELECT {r6_sql('ce.loss')} AS gen, {r6_sql('mse.loss')} AS latent, {r6_sql(f'ce.loss + {LATENT_WEIGHT} * mse.loss')} AS total
FROM ce, mse""",
)
def g3_combine(spark, sf_dir):
    gen = cross_entropy(_emb(spark, sf_dir), "embedding", "label").select("loss")
    lat = _mse(spark, sf_dir).select(F.col("mse").alias("loss"))
    c = combine({"gen": gen, "latent": lat}, {"gen": 1.0, "latent": LATENT_WEIGHT})
    return c.select(r6("gen").alias("gen"), r6("latent").alias("latent"), r6("total").alias("total"))


_SQL_SHIFTED = f"""
seqs AS (SELECT CAST(embedding AS DOUBLE[]) AS v,
                lead(label) OVER (PARTITION BY vec_id // {SEQUENCE} ORDER BY vec_id) AS nxt FROM embeddings),
shifted AS (
  SELECT avg(list_max(v) + ln(list_sum(list_transform(v, lambda s: exp(s - list_max(v))))) - v[nxt + 1]) AS loss,
         count(*) AS rows
  FROM seqs WHERE nxt IS NOT NULL AND nxt <> -100)"""


def _shifted(spark, sf_dir):
    # sequences of consecutive vectors: a score vector and a label per position
    steps = _emb(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / F.lit(SEQUENCE)).alias("seq")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "embedding", "label"))).alias("steps")
    )
    seqs = steps.select("seq", F.col("steps.embedding").alias("scores"), F.col("steps.label").alias("labels"))
    return shifted_cross_entropy(seqs, "seq", "scores", "labels")


@register("g1_shifted_loss", "WITH " + _SQL_SHIFTED + f"\nSELECT {r6_sql('loss')} AS loss, CAST(rows AS BIGINT) AS rows FROM shifted")
def g1_shifted_loss(spark, sf_dir):
    return _shifted(spark, sf_dir).select(r6("loss").alias("loss"), "rows")


@register(
    "g3_memory_objective",
    f"""WITH {_SQL_SHIFTED.strip()},
mem AS ({_SQL_VEC} SELECT sum(list_sum(list_transform(list_zip(prev, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / sum(len(x)) AS loss
        FROM r)
SELECT {r6_sql('shifted.loss')} AS gen, {r6_sql('mem.loss')} AS memory, {r6_sql(f'shifted.loss + {MEMORY_WEIGHT} * mem.loss')} AS total
FROM shifted, mem""",
)
def g3_memory_objective(spark, sf_dir):
    """Loss over shifted pairs plus the weighted surprise of the memory scan."""
    gen = _shifted(spark, sf_dir).select("loss")
    memory = surprise(scanned_vectors(spark, sf_dir), "prev", "x").select(F.col("surprise").alias("loss"))
    c = combine({"gen": gen, "memory": memory}, {"gen": 1.0, "memory": MEMORY_WEIGHT})
    return c.select(r6("gen").alias("gen"), r6("memory").alias("memory"), r6("total").alias("total"))


@register(
    "v1_trend",
    f"""
SELECT {r6_sql('regr_slope(value, CAST(event_id AS DOUBLE))')} AS slope, CAST(count(*) AS BIGINT) AS points,
       regr_slope(value, CAST(event_id AS DOUBLE)) < 0 AS decreasing
FROM events WHERE event_id % 10 = 0""",
)
def v1_trend(spark, sf_dir):
    t = trend(table(spark, sf_dir, "events"), "event_id", "value", every=10)
    return t.select(r6("slope").alias("slope"), "points", "decreasing")


@register(
    "v2_rectangular",
    """
SELECT label, CAST(min(len(embedding)) AS INTEGER) AS embedding_min, CAST(max(len(embedding)) AS INTEGER) AS embedding_max,
       CAST(count(*) AS BIGINT) AS rows, min(len(embedding)) = max(len(embedding)) AS ok
FROM embeddings GROUP BY label""",
)
def v2_rectangular(spark, sf_dir):
    return check_rectangular(table(spark, sf_dir, "embeddings"), ["embedding"], file_col="label")


@register(
    "v2_finite",
    """
SELECT CAST(count(*) AS BIGINT) AS rows,
       CAST(sum(CASE WHEN list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x))) THEN 1 ELSE 0 END) AS BIGINT)
         AS non_finite_rows
FROM embeddings""",
)
def v2_finite(spark, sf_dir):
    return check_finite(table(spark, sf_dir, "embeddings"), "embedding")
