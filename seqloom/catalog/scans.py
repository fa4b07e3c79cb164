"""Scan-with-memory queries on ``events(user_id; ts, event_id; value)``: E1-E6.

Oracles are recursive CTEs: the literal one-row-at-a-time recurrence, an
independent check of the blocked closed form used on Spark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import r6, r6_sql
from ..operators.scans import (
    DEFAULT_DECAY,
    DEFAULT_MOMENTUM,
    decay_scan,
    final_state,
    mlp_readout,
    momentum_scan,
    surprise,
)
from . import register, table

D = DEFAULT_DECAY
G = 1.0 - D
M = DEFAULT_MOMENTUM
# Fixed readout weights for E6 (width 4, dim 1); values are ours.
W1 = [[0.5], [-0.25], [1.0], [0.75]]
W2 = [[0.1, 0.2, -0.3, 0.4]]


def _lit(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")


def scanned(spark, sf_dir):
    return decay_scan(
        _events(spark, sf_dir), "user_id", ["ts", "event_id"], "value", decay=D, emit_previous="prev",
    )


_SQL_REC = f"""
WITH RECURSIVE ev AS (
  SELECT user_id, event_id, CAST(value AS DOUBLE) AS x,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS k
  FROM events),
r AS (
  SELECT user_id, k, event_id, x, {_lit(G)} * x AS h, CAST(0.0 AS DOUBLE) AS prev, x AS buf FROM ev WHERE k = 0
  UNION ALL
  SELECT ev.user_id, ev.k, ev.event_id, ev.x, {_lit(D)} * r.h + {_lit(G)} * ev.x, r.h, {_lit(M)} * r.buf + ev.x
  FROM r JOIN ev ON ev.user_id = r.user_id AND ev.k = r.k + 1)
"""


@register("e1_decay_scan", _SQL_REC + "SELECT event_id, user_id, k, " + r6_sql("h") + " AS h FROM r")
def e1_decay_scan(spark, sf_dir):
    return scanned(spark, sf_dir).select("event_id", "user_id", "k", r6("h").alias("h"))


@register("e2_read_before_write", _SQL_REC + "SELECT event_id, " + r6_sql("prev") + " AS prev FROM r")
def e2_read_before_write(spark, sf_dir):
    return scanned(spark, sf_dir).select("event_id", r6("prev").alias("prev"))


@register(
    "e3_surprise",
    _SQL_REC + "SELECT " + r6_sql("avg(power(prev - x, 2))") + " AS surprise, CAST(count(*) AS BIGINT) AS rows FROM r",
)
def e3_surprise(spark, sf_dir):
    s = surprise(scanned(spark, sf_dir), "prev", "value")
    return s.select(r6("surprise").alias("surprise"), "rows")


@register(
    "e4_final_state",
    _SQL_REC
    + "SELECT user_id, " + r6_sql("arg_max(h, k)") + " AS h, CAST(max(k) + 1 AS BIGINT) AS rows FROM r GROUP BY user_id",
)
def e4_final_state(spark, sf_dir):
    return final_state(scanned(spark, sf_dir), "user_id").select("user_id", r6("h").alias("h"), "rows")


@register(
    "e5_momentum",
    _SQL_REC + f"SELECT event_id, {r6_sql('buf')} AS buf, {r6_sql('x + ' + _lit(M) + ' * buf')} AS update FROM r",
)
def e5_momentum(spark, sf_dir):
    res = momentum_scan(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value", momentum=M, lookahead=True)
    return res.select("event_id", r6("buf").alias("buf"), r6("update").alias("update"))


def _readout_sql(h: str) -> str:
    terms = []
    for w2, w1 in zip(W2[0], [r[0] for r in W1]):
        z = f"({_lit(w1)} * {h})"
        terms.append(f"{_lit(w2)} * ({z} / (1.0 + exp(-{z})))")
    return "(" + " + ".join(terms) + ")"


@register(
    "e6_readout",
    _SQL_REC
    + f"""SELECT event_id, {r6_sql(_readout_sql('prev'))} AS readout,
       {r6_sql('power(' + _readout_sql('prev') + ' - x, 2)')} AS surprise FROM r""",
)
def e6_readout(spark, sf_dir):
    df = scanned(spark, sf_dir)
    r = mlp_readout(F.array(F.col("prev")), W1, W2)[0]
    return df.select(
        "event_id",
        r6(r).alias("readout"),
        r6(F.pow(r - F.col("value"), 2)).alias("surprise"),
    )


# ---- vector states: key label, order vec_id, value embedding

WIDTH_V, DIM_V = 4, 64
W1V = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(DIM_V)] for i in range(WIDTH_V)]
W2V = [[(o + 1) * (i - 1.5) / 10 for i in range(WIDTH_V)] for o in range(2)]


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("x")
    )


def scanned_vectors(spark, sf_dir):
    return decay_scan(_vectors(spark, sf_dir), "label", ["vec_id"], "x", decay=D, emit_previous="prev")


_SQL_VEC = f"""
WITH RECURSIVE ev AS (
  SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS k
  FROM embeddings),
r AS (
  SELECT label, k, vec_id, x, list_transform(x, lambda v: {_lit(G)} * v) AS h,
         list_transform(x, lambda v: CAST(0.0 AS DOUBLE)) AS prev
  FROM ev WHERE k = 0
  UNION ALL
  SELECT ev.label, ev.k, ev.vec_id, ev.x,
         list_transform(list_zip(r.h, ev.x), lambda z: {_lit(D)} * z[1] + {_lit(G)} * z[2]), r.h
  FROM r JOIN ev ON ev.label = r.label AND ev.k = r.k + 1)
"""


@register(
    "e1_decay_scan_vector",
    _SQL_VEC
    + f"""SELECT vec_id, label, k, {r6_sql('h[1]')} AS first, {r6_sql('h[64]')} AS last,
       {r6_sql('list_sum(list_transform(h, lambda v: v * v))')} AS ss FROM r""",
)
def e1_decay_scan_vector(spark, sf_dir):
    ss = F.aggregate("h", F.lit(0.0), lambda a, v: a + v * v)
    return scanned_vectors(spark, sf_dir).select(
        "vec_id", "label", "k", r6(F.col("h")[0]).alias("first"), r6(F.col("h")[63]).alias("last"), r6(ss).alias("ss")
    )


@register(
    "e3_surprise_vector",
    _SQL_VEC
    + f"""SELECT {r6_sql('sum(list_sum(list_transform(list_zip(prev, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / sum(len(x))')} AS surprise,
       CAST(count(*) AS BIGINT) AS rows FROM r""",
)
def e3_surprise_vector(spark, sf_dir):
    s = surprise(scanned_vectors(spark, sf_dir), "prev", "x")
    return s.select(r6("surprise").alias("surprise"), "rows")


def _readout_vector_sql(o: int) -> str:
    dot = lambda w, v: f"list_dot_product(CAST([{', '.join(repr(x) for x in w)}] AS DOUBLE[]), {v})"
    z = [dot(w, "prev") for w in W1V]
    return " + ".join(f"{_lit(w)} * (({v}) / (1.0 + exp(-({v}))))" for w, v in zip(W2V[o], z, strict=True))


@register(
    "e6_readout_vector",
    _SQL_VEC + f"SELECT vec_id, {r6_sql(_readout_vector_sql(0))} AS r0, {r6_sql(_readout_vector_sql(1))} AS r1 FROM r",
)
def e6_readout_vector(spark, sf_dir):
    r = mlp_readout(F.col("prev"), W1V, W2V, spark)
    out = scanned_vectors(spark, sf_dir).select("vec_id", r.alias("r"))
    return out.select("vec_id", r6(F.col("r")[0]).alias("r0"), r6(F.col("r")[1]).alias("r1"))
