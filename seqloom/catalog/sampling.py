"""Ranking, sampling and retention queries: T6, K1-K3, R1, R2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import r6, r6_sql, uniform_sql
from ..operators.sampling import draw, sample_walk, topk_softmax
from ..operators.sequences import next_token_pairs, words
from ..operators.versions import keep_newest, latest_version
from . import register, table

SEED = 42
TOPK = 50
TEMP = 0.8
WALK_STEPS = 8
WALK_EOS = "the"


def bigrams(spark, sf_dir):
    """T6 over words: (key = word t, item = word t+1, count, score = ln count)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    pairs = next_token_pairs(docs, "doc_id", "w", score="key", label="item")
    return pairs.groupBy("key", "item").agg(F.count(F.lit(1)).cast("bigint").alias("count")).withColumn(
        "score", F.log(F.col("count").cast("double"))
    )


_SQL_BIGRAMS = """
words AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS l FROM documents),
pairs AS (SELECT doc_id, unnest(l[1:len(l) - 1]) AS key, unnest(l[2:len(l)]) AS item,
                 generate_subscripts(l[1:len(l) - 1], 1) - 1 AS pos
          FROM words WHERE len(l) >= 2),
bigrams AS (SELECT key, item, count(*) AS cnt, ln(count(*)) AS score FROM pairs GROUP BY key, item)"""

_SQL_TOPK = f""",
ranked AS (
  SELECT key, item, score / {TEMP} AS logit,
         row_number() OVER (PARTITION BY key ORDER BY score / {TEMP} DESC, item) AS rank
  FROM bigrams),
kept AS (SELECT *, max(logit) OVER (PARTITION BY key) AS m FROM ranked WHERE rank <= {TOPK}),
probs AS (
  SELECT key, item, rank, logit, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY key) AS prob
  FROM kept)"""


@register(
    "t6_next_token_pairs",
    "WITH " + _SQL_BIGRAMS + "\nSELECT doc_id, CAST(pos AS BIGINT) AS pos, key AS score, item AS label FROM pairs",
)
def t6_next_token_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return next_token_pairs(docs, "doc_id", "w")


def _topk(spark, sf_dir):
    return topk_softmax(bigrams(spark, sf_dir), "key", "item", "score", k=TOPK, temperature=TEMP)


@register(
    "k1_topk_softmax",
    "WITH " + _SQL_BIGRAMS + _SQL_TOPK + f"\nSELECT key, item, CAST(rank AS BIGINT) AS rank, {r6_sql('prob')} AS prob FROM probs",
)
def k1_topk_softmax(spark, sf_dir):
    return _topk(spark, sf_dir).select("key", "item", "rank", r6("prob").alias("prob"))


@register(
    "k2_draw",
    "WITH " + _SQL_BIGRAMS + _SQL_TOPK
    + f""",
cum AS (SELECT key, item, rank, sum(prob) OVER (PARTITION BY key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
               {uniform_sql(SEED, 'key')} AS u FROM probs)
SELECT key, coalesce(arg_min(item, CASE WHEN c > u THEN rank END), arg_max(item, rank)) AS item,
       CAST(coalesce(min(CASE WHEN c > u THEN rank END), max(rank)) AS BIGINT) AS rank
FROM cum GROUP BY key""",
)
def k2_draw(spark, sf_dir):
    return draw(_topk(spark, sf_dir), "key", "item", seed=SEED)


def _sql_walk() -> str:
    parts = [
        _SQL_BIGRAMS + _SQL_TOPK,
        """cumt AS (SELECT key, item, rank, sum(prob) OVER (PARTITION BY key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM probs)""",
        """a0 AS (SELECT doc_id AS walker, l[1] AS cur FROM words WHERE len(l) >= 1)""",
    ]
    for t in range(1, WALK_STEPS + 1):
        u = uniform_sql(SEED, "a.walker", str(t))
        parts.append(
            f"""d{t} AS (SELECT a.walker, coalesce(arg_min(p.item, CASE WHEN p.cum > {u} THEN p.rank END), arg_max(p.item, p.rank)) AS item
        FROM a{t - 1} a JOIN cumt p ON p.key = a.cur GROUP BY a.walker)"""
        )
        parts.append(f"a{t} AS (SELECT walker, item AS cur FROM d{t} WHERE item <> '{WALK_EOS}')")
    union = "SELECT walker, CAST(0 AS BIGINT) AS step, cur AS item FROM a0"
    for t in range(1, WALK_STEPS + 1):
        union += f"\nUNION ALL SELECT walker, CAST({t} AS BIGINT), item FROM d{t}"
    return "WITH " + ",\n".join(parts) + "\n" + union


@register("k3_sample_walk", _sql_walk())
def k3_sample_walk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.ltrim("text"), " ", 2)[0].alias("first"))
    prompts = docs.where(F.col("first") != "")  # the first of the words, without splitting the text
    return sample_walk(prompts, bigrams(spark, sf_dir), "doc_id", "first", steps=WALK_STEPS, eos=WALK_EOS, seed=SEED,
                       k=TOPK, temperature=TEMP)


@register(
    "r1_keep_newest",
    """
SELECT o_orderkey, o_custkey,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2 AS keep
FROM orders""",
)
def r1_keep_newest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return keep_newest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], k=2).select("o_orderkey", "o_custkey", "keep")


_NAME_SQL = "CASE WHEN o_orderstatus = 'P' THEN 'model_step_x' || CAST(o_orderkey AS VARCHAR) || '.pt' ELSE 'model_step_' || CAST(o_orderkey AS VARCHAR) || '.pt' END"


@register(
    "r2_latest_version",
    f"""
WITH n AS (SELECT o_custkey, {_NAME_SQL} AS name FROM orders),
m AS (SELECT o_custkey, name, CAST(regexp_extract(name, 'model_step_(\\d+).pt', 1) AS BIGINT) AS version
      FROM n WHERE regexp_matches(name, 'model_step_(\\d+).pt'))
SELECT o_custkey, max(version) AS version, arg_max(name, version) AS name FROM m GROUP BY o_custkey""",
)
def r2_latest_version(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("model_step_x"), F.col("o_orderkey").cast("string"), F.lit(".pt"))).otherwise(
        F.concat(F.lit("model_step_"), F.col("o_orderkey").cast("string"), F.lit(".pt"))
    )
    named = o.select("o_custkey", name.alias("name"))
    return latest_version(named, "name", r"model_step_(\d+).pt", group=["o_custkey"])
