"""Corpus preparation queries: C1, M2, M3, T1, T3, T4, T5, M4 (slice 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import count_eq, digest
from ..functions.portable import r6, r6_sql, uniform_int_sql, uniform_sql
from ..operators.mixing import cap, shuffle, standardize, take, take_unordered, truncate
from ..operators.sequences import (
    BOS_ID,
    MASK_ID,
    SPECIALS,
    UNK_ID,
    build_vocab,
    encode,
    mask_pairs,
    pack,
    pack_groups,
    pack_report,
)
from ..operators.prepare import prepare_pairs
from . import register, table

SEED = 42
TAKE = 150  # M3 only: cuts at every given scale; all other queries use every document
SEQ_LEN = 512  # the reference's smoke-run length
GROUP_DOCS = 100  # documents per pack group; small, so that every query works on many groups
VOCAB = 32_000
MASK_P = 0.15
CAP = 50  # M4: the reference's hard stop, scaled down


# ---------------------------------------------------------------- Spark side

def prepared_docs(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """The documents numbered in shuffled order; all of them, or the first ``n``."""
    docs = standardize(table(spark, sf_dir, "documents"), keep=("doc_id",))
    shuffled = shuffle(docs, "doc_id", seed=SEED)
    return shuffled if n is None else take(shuffled, n)


def selected_docs(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """The same documents as ``prepared_docs``, unnumbered and unshuffled (for counting passes)."""
    docs = standardize(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return docs if n is None else take_unordered(docs, "doc_id", n, seed=SEED)


def encoded_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # the vocabulary pass reads the selected documents in place (no exchange);
    # only the encode/pack pass needs them numbered in shuffled order
    vocab = build_vocab(selected_docs(spark, sf_dir), size=VOCAB)
    return encode(prepared_docs(spark, sf_dir), vocab, keys=["ordinal"]), vocab


def pairs(spark: SparkSession, sf_dir: str, seq_len: int = SEQ_LEN, group_docs: int = GROUP_DOCS,
          max_sequences: int | None = None) -> DataFrame:
    """The flagship chain, fused so that the documents are exchanged once
    (``operators/prepare.py``); equal to ``pairs_chain``."""
    docs = standardize(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return prepare_pairs(
        docs, "doc_id", seq_len=seq_len, group_docs=group_docs, vocab_size=VOCAB, p=MASK_P,
        mask_id=MASK_ID, seed=SEED, max_sequences=max_sequences,
    )


def pairs_chain(spark: SparkSession, sf_dir: str, seq_len: int = SEQ_LEN, group_docs: int = GROUP_DOCS,
                max_sequences: int | None = None) -> DataFrame:
    """The same chain operator by operator: shuffle, take, vocabulary, encode, pack, mask."""
    enc, _ = encoded_docs(spark, sf_dir)
    seqs = pack(enc, seq_len=seq_len, group_docs=group_docs, max_sequences=max_sequences)
    return mask_pairs(seqs, p=MASK_P, mask_id=MASK_ID, seed=SEED)


def pair_digest(df: DataFrame) -> DataFrame:
    return df.select(
        "seq_id",
        F.size("target_ids").cast("bigint").alias("n_tokens"),
        count_eq("context_ids", MASK_ID).alias("n_masked"),
        digest("context_ids").alias("context_md5"),
        digest("target_ids").alias("target_md5"),
    )


# ---------------------------------------------------------------- SQL side

def _sql_taken(n: int | None = None) -> str:
    cut = "" if n is None else f" WHERE ordinal < {n}"
    u = uniform_sql(SEED, "doc_id")
    return f"""
shuffled AS (
  SELECT doc_id, text, CAST(row_number() OVER (ORDER BY u, doc_id) - 1 AS BIGINT) AS ordinal
  FROM (SELECT doc_id, text, {u} AS u FROM documents) s),
taken AS (SELECT doc_id, text, ordinal FROM shuffled{cut})"""


def _sql_encoded() -> str:
    k = VOCAB - len(SPECIALS)
    return f"""
toks AS (
  SELECT ordinal, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT ordinal, list_filter(string_split(text, ' '), lambda w: w <> '') AS l FROM taken) t),
vocab AS (
  SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 + {len(SPECIALS)} AS INTEGER) AS token_id
  FROM (SELECT token, count(*) AS cnt FROM toks GROUP BY token ORDER BY cnt DESC, token LIMIT {k}) c),
enc_tok AS (
  SELECT toks.ordinal, toks.pos, coalesce(vocab.token_id, {UNK_ID}) AS tid FROM toks LEFT JOIN vocab USING (token)),
encoded AS (
  SELECT taken.ordinal,
         list_concat([{BOS_ID}], coalesce(list(e.tid ORDER BY e.pos) FILTER (WHERE e.pos IS NOT NULL), []::INTEGER[])) AS ids
  FROM taken LEFT JOIN enc_tok e USING (ordinal) GROUP BY taken.ordinal)"""


def _sql_packed(seq_len: int, group_docs: int) -> str:
    C = seq_len + 1
    return f"""
docs_n AS (SELECT ordinal, ids, ordinal // {group_docs} AS group_id, CAST(len(ids) AS BIGINT) AS n FROM encoded),
docs_s AS (
  SELECT *, sum(n) OVER (PARTITION BY group_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS start,
         sum(n) OVER (PARTITION BY group_id) // {C} AS chunks
  FROM docs_n),
ptok AS (
  SELECT group_id, chunks, start + generate_subscripts(ids, 1) - 1 AS gpos, unnest(ids) AS tok FROM docs_s),
seqs AS (
  SELECT group_id, gpos // {C} AS chunk, list(tok ORDER BY gpos) AS input_ids
  FROM ptok WHERE gpos // {C} < chunks GROUP BY group_id, gpos // {C}),
packed AS (
  SELECT CAST(row_number() OVER (ORDER BY group_id, chunk) - 1 AS BIGINT) AS seq_id,
         CAST(group_id AS BIGINT) AS group_id, CAST(chunk AS BIGINT) AS chunk, input_ids FROM seqs)"""


def _sql_masked() -> str:
    # per-token rows so that the integer mixer is written once per token
    u = uniform_int_sql(SEED, "seq_id", "pos")
    return f"""
mtok AS (SELECT seq_id, unnest(input_ids) AS t, generate_subscripts(input_ids, 1) - 1 AS pos FROM packed),
mdraw AS (SELECT seq_id, pos, t, {u} AS u FROM mtok),
masked AS (
  SELECT seq_id, list(CASE WHEN u < {MASK_P} THEN {MASK_ID} ELSE t END ORDER BY pos) AS context_ids,
         list(t ORDER BY pos) AS target_ids
  FROM mdraw GROUP BY seq_id)"""


def _sql_pair_digest(src: str = "masked") -> str:
    return f"""
SELECT seq_id, CAST(len(target_ids) AS BIGINT) AS n_tokens,
       CAST(len(list_filter(context_ids, lambda x: x = {MASK_ID})) AS BIGINT) AS n_masked,
       md5(array_to_string(context_ids, '|')) AS context_md5,
       md5(array_to_string(target_ids, '|')) AS target_md5
FROM {src}"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


# ---------------------------------------------------------------- registry

@register(
    "c1_standardize",
    """
SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM documents""",
)
def c1_standardize(spark, sf_dir):
    docs = standardize(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return docs.select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars"))


@register("m2_shuffle", _with(_sql_taken()) + "\nSELECT doc_id, ordinal FROM shuffled")
def m2_shuffle(spark, sf_dir):
    docs = standardize(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return shuffle(docs, "doc_id", seed=SEED).select("doc_id", "ordinal")


@register("m3_take_unordered", _with(_sql_taken(TAKE)) + "\nSELECT doc_id FROM taken")
def m3_take_unordered(spark, sf_dir):
    # the first rows of the permutation as a filter (no numbering)
    docs = standardize(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return take_unordered(docs, "doc_id", TAKE, seed=SEED).select("doc_id")


@register("m3_take", _with(_sql_taken(TAKE)) + "\nSELECT doc_id, ordinal FROM taken")
def m3_take(spark, sf_dir):
    return prepared_docs(spark, sf_dir, TAKE).select("doc_id", "ordinal")


@register(
    "t1_vocab",
    _with(_sql_taken(), _sql_encoded())
    + f"""
SELECT token, token_id, CAST(cnt AS BIGINT) AS count FROM vocab
UNION ALL
SELECT * FROM (VALUES {", ".join(f"('{t}', {i}, CAST(0 AS BIGINT))" for i, t in enumerate(SPECIALS))}) v(token, token_id, count)""",
)
def t1_vocab(spark, sf_dir):
    return build_vocab(selected_docs(spark, sf_dir), size=VOCAB)


@register(
    "t1_encode",
    _with(_sql_taken(), _sql_encoded())
    + """
SELECT ordinal, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, '|')) AS ids_md5 FROM encoded""",
)
def t1_encode(spark, sf_dir):
    enc, _ = encoded_docs(spark, sf_dir)
    return enc.select("ordinal", F.size("ids").cast("bigint").alias("n_ids"), digest("ids").alias("ids_md5"))


@register(
    "t3_pack",
    _with(_sql_taken(), _sql_encoded(), _sql_packed(SEQ_LEN, GROUP_DOCS))
    + """
SELECT seq_id, group_id, chunk, CAST(len(input_ids) AS BIGINT) AS n_tokens, md5(array_to_string(input_ids, '|')) AS ids_md5
FROM packed""",
)
def t3_pack(spark, sf_dir):
    enc, _ = encoded_docs(spark, sf_dir)
    seqs = pack(enc, seq_len=SEQ_LEN, group_docs=GROUP_DOCS)
    return seqs.select(
        "seq_id", "group_id", "chunk", F.size("input_ids").cast("bigint").alias("n_tokens"), digest("input_ids").alias("ids_md5")
    )


@register(
    "t4_mask",
    _with(_sql_taken(), _sql_encoded(), _sql_packed(SEQ_LEN, GROUP_DOCS), _sql_masked()) + _sql_pair_digest(),
)
def t4_mask(spark, sf_dir):
    return pair_digest(pairs(spark, sf_dir))


@register(
    "m4_cap",
    _with(_sql_taken(), _sql_encoded(), _sql_packed(SEQ_LEN, GROUP_DOCS), _sql_masked())
    + _sql_pair_digest()
    + f" WHERE seq_id < {CAP}",
)
def m4_cap(spark, sf_dir):
    return pair_digest(pairs(spark, sf_dir, group_docs=GROUP_DOCS, max_sequences=CAP))


@register(
    "t5_report",
    _with(_sql_taken(), _sql_encoded(), _sql_packed(SEQ_LEN, GROUP_DOCS), _sql_masked())
    + f"""
, g AS (SELECT group_id, sum(n) AS tokens_in, max(chunks) AS chunks FROM docs_s GROUP BY group_id),
s AS (SELECT count(*) AS sequences, coalesce(sum(len(list_filter(context_ids, lambda x: x = {MASK_ID}))), 0) AS masked FROM masked)
SELECT CAST(s.sequences AS BIGINT) AS sequences,
       CAST(s.sequences * {SEQ_LEN + 1} AS BIGINT) AS total_tokens,
       CAST({SEQ_LEN} AS BIGINT) AS seq_len,
       {r6_sql(f"CASE WHEN s.sequences > 0 THEN s.masked / (s.sequences * {SEQ_LEN + 1}) END")} AS mask_rate,
       CAST((SELECT sum(tokens_in) FROM g) AS BIGINT) AS tokens_in,
       CAST((SELECT sum(tokens_in - chunks * {SEQ_LEN + 1}) FROM g) AS BIGINT) AS tokens_dropped,
       CAST((SELECT count(*) FROM g) AS BIGINT) AS groups,
       CAST((SELECT count(*) FROM g WHERE chunks = 0) AS BIGINT) AS groups_dropped
FROM s""",
)
def t5_report(spark, sf_dir):
    enc, _ = encoded_docs(spark, sf_dir)
    seqs = pack(enc, seq_len=SEQ_LEN, group_docs=GROUP_DOCS)
    prs = mask_pairs(seqs, p=MASK_P, mask_id=MASK_ID, seed=SEED)
    rep = pack_report(pack_groups(enc, SEQ_LEN, group_docs=GROUP_DOCS), prs, SEQ_LEN, mask_id=MASK_ID)
    return rep.withColumn("mask_rate", r6("mask_rate"))


@register(
    "c2_truncate",
    _with(_sql_taken(), _sql_encoded(), _sql_packed(SEQ_LEN, GROUP_DOCS), _sql_masked())
    + f""",
cut AS (SELECT seq_id, context_ids[1:{SEQ_LEN}] AS context_ids, target_ids[1:{SEQ_LEN}] AS target_ids FROM masked)"""
    + _sql_pair_digest("cut"),
)
def c2_truncate(spark, sf_dir):
    # the loader cuts the packed seq_len + 1 tokens to the model length seq_len
    return pair_digest(truncate(pairs(spark, sf_dir), ["context_ids", "target_ids"], SEQ_LEN))
