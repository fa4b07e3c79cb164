"""Matrix/vector queries: X1-X7 on the revenue matrix and on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import normal_sql, r6, r6_sql, rnd, rnd_sql
from ..operators.matrix import (
    NS_COEFFS, add_delta, balance, clip, fan_out, global_norm, lane_mean, layer_norm, mix, orthogonalize,
    potentials,
)
from ..session import checkpoint_dir
from . import register, table

SEED = 42
LANES = 4
SIGMA = 0.02
ITERS = 5
TOL = 1e-4  # x1_residual: largest deviation of a row sum from 1


def revenue_matrix(spark, sf_dir):
    """Supplier-region x customer-region revenue.

    Declarative joins; only ``nation`` (25 rows, fixed) is hinted for
    broadcast. Supplier, customer and orders grow with the scale factor, so
    their join strategy is left to the planner and AQE (broadcast at run time
    when small, sort-merge otherwise). The final ``groupBy(i, j)`` combines
    map-side, so the last exchange carries at most regions^2 rows per task.
    """
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    supp = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_regionkey").alias("i")
    )
    cust = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_regionkey").alias("j")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev")
    )
    joined = (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.groupBy("i", "j").agg(F.sum("rev").alias("revenue")).select(
        F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "revenue"
    )


def balanced(spark, sf_dir):
    m = revenue_matrix(spark, sf_dir).select("i", "j", F.log("revenue").alias("w"))
    return balance(m, "i", "j", "w", iters=ITERS)


_SQL_REV = """
rev AS (
  SELECT CAST(ns.n_regionkey AS BIGINT) AS i, CAST(nc.n_regionkey AS BIGINT) AS j,
         sum(l_extendedprice * (1 - l_discount)) AS revenue
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey
  GROUP BY 1, 2)"""


def _sql_balance(iters: int = ITERS) -> str:
    parts = [_SQL_REV, "\nw0 AS (SELECT i, j, ln(revenue) AS w FROM rev)"]
    prev = "w0"
    for t in range(1, iters + 1):
        for ax, tag in (("i", "r"), ("j", "c")):
            a = f"{tag}{t}a"
            b = f"{tag}{t}"
            parts.append(f"\n{a} AS (SELECT i, j, w, max(w) OVER (PARTITION BY {ax}) AS m FROM {prev})")
            parts.append(
                f"\n{b} AS (SELECT i, j, w - (m + ln(sum(exp(w - m)) OVER (PARTITION BY {ax}))) AS w FROM {a})"
            )
            prev = b
    parts.append(f"\nbalanced AS (SELECT i, j, exp(w) AS p FROM {prev})")
    return "WITH " + ",".join(parts)


@register("x1_balance", _sql_balance() + f"\nSELECT i, j, {r6_sql('p')} AS p FROM balanced")
def x1_balance(spark, sf_dir):
    return balanced(spark, sf_dir).select("i", "j", r6("p").alias("p"))


def _sql_residual(iters: int = ITERS) -> str:
    after = " UNION ALL ".join(
        f"SELECT {t} AS rounds, max(abs(s - 1)) AS residual FROM (SELECT i, sum(exp(w)) AS s FROM c{t} GROUP BY i) q{t}"
        for t in range(1, iters + 1)
    )
    return f""",
after AS ({after}),
stop AS (SELECT coalesce(min(CASE WHEN residual <= {TOL} THEN rounds END), {iters}) AS rounds FROM after)
SELECT CAST(rounds AS BIGINT) AS rounds, {r6_sql('residual')} AS residual FROM after JOIN stop USING (rounds)"""


@register("x1_residual", _sql_balance() + _sql_residual())
def x1_residual(spark, sf_dir):
    """Rounds until every row sum is within TOL of 1, and the largest deviation then."""
    m = revenue_matrix(spark, sf_dir).select("i", "j", F.log("revenue").alias("w"))
    checkpoint_dir(spark)
    _, _, rounds, residual = potentials(m.checkpoint(), iters=ITERS, tol=TOL)
    return spark.range(1).select(F.lit(rounds).cast("bigint").alias("rounds"), r6(F.lit(residual)).alias("residual"))


_SQL_X2 = f""",
x AS (
  SELECT l_suppkey AS supp, CAST(nc.n_regionkey AS BIGINT) AS lane, sum(l_extendedprice * (1 - l_discount)) AS x
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey
  GROUP BY 1, 2)
SELECT x.supp, b.i AS lane, {rnd_sql('sum(b.p * x.x)', 2)} AS y
FROM x JOIN balanced b ON b.j = x.lane
GROUP BY x.supp, b.i"""


@register("x2_mix", _sql_balance() + _SQL_X2)
def x2_mix(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    cust = table(spark, sf_dir, "customer").join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("n_regionkey").cast("bigint").alias("lane"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        cust, F.col("o_custkey") == F.col("c_custkey")
    )
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("supp"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev")
    )
    x = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("supp", "lane").agg(F.sum("rev").alias("x"))
    p = balanced(spark, sf_dir)
    y = mix(x, p, keys=["supp"], lane="lane", val="x", o="i", i="j", pval="p")
    return y.select("supp", "lane", rnd("y", 2).alias("y"))  # money scale: cents


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def _sql_fanout() -> str:
    z = normal_sql(SEED, "vec_id", "lane", "d - 1")
    return f"""
WITH lanes AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(lane AS BIGINT) AS lane
               FROM embeddings, range(0, {LANES}) r(lane)),
fan AS (SELECT vec_id, lane, list_transform(e, lambda v, d: v + {SIGMA!r} * {z}) AS vec FROM lanes)"""


@register(
    "x3_fan_out",
    _sql_fanout()
    + f"""
SELECT vec_id, lane, {r6_sql('list_sum(vec)')} AS s, {r6_sql('vec[1]')} AS first,
       CAST(len(vec) AS BIGINT) AS dim FROM fan""",
)
def x3_fan_out(spark, sf_dir):
    f = fan_out(_emb(spark, sf_dir), "vec_id", "embedding", n=LANES, sigma=SIGMA, seed=SEED)
    s = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return f.select(
        "vec_id", F.col("lane").cast("bigint").alias("lane"), r6(s).alias("s"), r6(F.col("embedding")[0]).alias("first"),
        F.size("embedding").cast("bigint").alias("dim"),
    )


@register(
    "x3_add_delta",
    _sql_fanout()
    + f"""
SELECT vec_id, lane, {r6_sql('list_sum(list_transform(list_zip(vec, e2), lambda z: z[1] + z[2]))')} AS s
FROM fan JOIN (SELECT vec_id AS v2, CAST(embedding AS DOUBLE[]) AS e2 FROM embeddings) d ON d.v2 = fan.vec_id""",
)
def x3_add_delta(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    f = fan_out(emb, "vec_id", "embedding", n=LANES, sigma=SIGMA, seed=SEED)
    f = f.join(emb.select("vec_id", F.col("embedding").alias("delta")), "vec_id")
    out = add_delta(f, "embedding", "delta")
    return out.select(
        "vec_id", F.col("lane").cast("bigint").alias("lane"),
        r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("s"),
    )


@register(
    "x4_lane_mean",
    _sql_fanout()
    + f""",
el AS (SELECT vec_id, lane, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM fan),
m AS (SELECT vec_id, d, avg(v) AS v FROM el GROUP BY vec_id, d)
SELECT vec_id, {r6_sql('sum(v)')} AS s, {r6_sql('sum(v * v)')} AS ss, CAST(count(*) AS BIGINT) AS dim FROM m GROUP BY vec_id""",
)
def x4_lane_mean(spark, sf_dir):
    f = fan_out(_emb(spark, sf_dir), "vec_id", "embedding", n=LANES, sigma=SIGMA, seed=SEED)
    m = lane_mean(f, ["vec_id"], "embedding")
    return m.select(
        "vec_id",
        r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("s"),
        r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("ss"),
        F.size("embedding").cast("bigint").alias("dim"),
    )


def _sql_orthogonalize(steps: int = 5) -> str:
    a, b, c = NS_COEFFS

    def mm(x, y):
        return f"SELECT x.r, y.c, sum(x.v * y.v) AS v FROM {x} x JOIN {y} y ON x.c = y.r GROUP BY x.r, y.c"

    parts = [
        "e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)",
        "g AS (SELECT a.d AS r, b.d AS c, sum(a.v * b.v) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2)",
        "sc AS (SELECT 1.0 / (sqrt(sum(v)) + 1e-7) AS s FROM g WHERE r = c)",
        "A0 AS (SELECT r, c, v * (SELECT s FROM sc) * (SELECT s FROM sc) AS v FROM g)",
        "M0 AS (SELECT r, c, CASE WHEN r = c THEN 1.0 ELSE 0.0 END AS v FROM g)",
    ]
    for t in range(1, steps + 1):
        p_, q = t - 1, t
        parts.append(f"SQ{q} AS ({mm(f'A{p_}', f'A{p_}')})")
        parts.append(
            f"K{q} AS (SELECT A.r, A.c, {a!r} * (CASE WHEN A.r = A.c THEN 1.0 ELSE 0.0 END) + ({b!r}) * A.v + {c!r} * S.v AS v "
            f"FROM A{p_} A JOIN SQ{q} S USING (r, c))"
        )
        parts.append(f"M{q} AS ({mm(f'K{q}', f'M{p_}')})")
        parts.append(f"KA{q} AS ({mm(f'K{q}', f'A{p_}')})")
        parts.append(f"A{q} AS ({mm(f'KA{q}', f'K{q}')})")
    parts.append(
        f"o AS (SELECT e.vec_id, m.r AS j, (SELECT s FROM sc) * sum(e.v * m.v) AS v FROM e JOIN M{steps} m ON m.c = e.d GROUP BY e.vec_id, m.r)"
    )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, {r6_sql('sqrt(sum(v * v))')} AS row_norm, CAST(count(*) AS BIGINT) AS dim FROM o GROUP BY vec_id"""


@register("x5_orthogonalize", _sql_orthogonalize())
def x5_orthogonalize(spark, sf_dir):
    o = orthogonalize(_emb(spark, sf_dir), "embedding", out="ortho")
    return o.select(
        "vec_id",
        r6(F.sqrt(F.aggregate("ortho", F.lit(0.0), lambda a, x: a + x * x))).alias("row_norm"),
        F.size("ortho").cast("bigint").alias("dim"),
    )


@register(
    "x6_global_norm",
    f"""SELECT {r6_sql('sqrt(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))))')} AS norm
FROM embeddings""",
)
def x6_global_norm(spark, sf_dir):
    return global_norm(_emb(spark, sf_dir), "embedding").select(r6("norm").alias("norm"))


@register(
    "x6_clip",
    f"""
WITH n AS (SELECT sqrt(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))) AS norm FROM embeddings)
SELECT vec_id, {r6_sql('list_sum(CAST(embedding AS DOUBLE[])) * least(1.0, 1.0 / (n.norm + 1e-6))')} AS s
FROM embeddings, n""",
)
def x6_clip(spark, sf_dir):
    c = clip(_emb(spark, sf_dir), "embedding", max_norm=1.0)
    return c.select("vec_id", r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("s"))


_SQL_LN = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
st AS (SELECT vec_id, v, list_avg(v) AS mean FROM e),
st2 AS (SELECT vec_id, v, mean, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / len(v) AS var FROM st),
ln AS (SELECT vec_id, list_transform(v, lambda x: (x - mean) / sqrt(var + 1e-5)) AS y FROM st2)"""


@register(
    "x7_layer_norm",
    _SQL_LN
    + f"""
SELECT vec_id, {r6_sql('y[1]')} AS first, {r6_sql('list_sum(list_transform(y, lambda x: x * x))')} AS ss FROM ln""",
)
def x7_layer_norm(spark, sf_dir):
    y = layer_norm(_emb(spark, sf_dir), "embedding", out="y")
    return y.select(
        "vec_id", r6(F.col("y")[0]).alias("first"), r6(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x)).alias("ss")
    )
