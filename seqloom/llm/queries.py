"""Registered queries of the thirteen operators (thin: operator output -> contract columns) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_freed, small_batches
from .bpe_automaton import decode_documents, encode_documents
from .chat_format import format_conversations, read_back
from .conversation_repair import repair_conversations, repair_digests
from .hilbert_packing import pack_documents
from .language_id import identify_languages, learn_profiles
from .ngram_jaccard import jaccard_components
from .pivot_search import build_index, integer_vectors, top_k
from .quality_compression import learn_quality, score_quality
from .ranked_search import ranked_search
from .repetition_rules import (
    BASE_MIN_WORDS, BASE_REPEAT_PERCENT, DUP_LINE_SHARE, DUP_NGRAM_SHARE, SYMBOLS_PER_WORD, repetition_rules,
)
from .suffix_tree_lm import learn, score_texts
from .toxicity import learn_toxicity, score_toxicity
from .url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SAID = "\\### Assistant: </turn> ok"


@register(
    r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), x AS (
  SELECT *, length(role) + length(role) - length(translate(role, '\<>', '')) AS role_len,
         length(text) + length(text) - length(translate(text, '\<>', '')) AS text_len
  FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(6 + role_len + 2 + text_len + 8) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted by the default template and read back."""
    planted = spark.createDataFrame(
        [(-7, 0, "user", _SAID), (-7, 1, "assistant", _SAID)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(format_conversations(rows))


_RULES = "('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')"


@register(
    rf"""
WITH rules(h, p, v) AS (VALUES {_RULES}),
pages_ AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM pages_
), judged AS (
  SELECT page_id, host, path,
    (SELECT max(struct_pack(a := length(h), b := length(p), r := h || p, v := v)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM parts
)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM judged
"""
)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the five rules of the contract; urls without a rule are allowed."""
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES} AS rules(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def _covered_sql(width: int, name: str) -> str:
    """Words inside windows of ``width`` words that occur at least twice in their text."""
    return f"""
{name} AS (
  SELECT DISTINCT doc_id, s + k AS i
  FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, key) AS c
        FROM (SELECT doc_id, s, array_to_string(ws[s:s + {width - 1}], ' ') AS key
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {width - 2})) AS s FROM d))),
       range({width}) AS r(k)
  WHERE c >= 2
)"""


def _op10_sql() -> str:
    widths = list(DUP_NGRAM_SHARE)
    shares = " AND ".join(f"coalesce(g{n}.chars, 0) <= {DUP_NGRAM_SHARE[n]} * greatest(word_chars, 1)" for n in widths)
    chars = ",".join(
        f"g{n} AS (SELECT doc_id, sum(length(w)) AS chars FROM c{n} JOIN words USING (doc_id, i) GROUP BY doc_id)" for n in widths
    )
    joins = " ".join(f"LEFT JOIN g{n} USING (doc_id)" for n in widths)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d
), {_covered_sql(3, 'c3')}, {",".join(_covered_sql(n, f"c{n}") for n in widths)}, {chars},
r3 AS (SELECT doc_id, count(*) AS n FROM c3 GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) - 1 AS n, (count(*) - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
), ls AS (SELECT doc_id, sum(n) AS n, sum(chars) AS chars FROM l GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ls.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r3.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(ls.chars, 0) AS line_chars
  FROM d LEFT JOIN ls USING (doc_id) LEFT JOIN r3 USING (doc_id)
), b AS (SELECT *, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND line_chars <= {DUP_LINE_SHARE} * greatest(word_chars, 1)
       AND n_symbols <= {SYMBOLS_PER_WORD} * n_words AND {shares} AS kept
FROM b {joins}
"""


@register(_op10_sql())
def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    out = repetition_rules(table(spark, sf_dir, "documents"))
    return out.drop("dup_line_chars", "dup_ngram_chars")


def tokenizer_path() -> str:
    """Vocabulary file of the contract's queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register()
def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the automaton and decoded again."""
    path = tokenizer_path()
    encoded = encode_documents(table(spark, sf_dir, "documents"), path)
    decoded = decode_documents(
        encoded.select("doc_id", "ids", F.sha2("ids", 256).alias("ids_sha256")), path, ("doc_id", "ids", "ids_sha256")
    )
    return decoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def crc_remainder(n: int):
    """crc32 of doc_id as text modulo ``n`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@register()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by profiles learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(crc_remainder(4) != 2))
    rows = docs.select("doc_id", "text", (crc_remainder(4) == 2).alias("held_out"))
    return identify_languages(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


@register()
def op3_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of four fifths of the documents teach."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_remainder(5) != 0)
    state = learn_quality(docs, labels)
    rows = docs.select("doc_id", "text", (crc_remainder(5) == 0).alias("held_out"))
    scored = score_quality(rows, state)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


@register()
def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed along the curve."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@register(
    """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
"""
)
def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth one, among all others."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    index = build_index(vectors)
    return top_k(index, index.rows.where(F.pmod("vec_id", F.lit(100)) == 0).select("vec_id"), 10)


@register()
def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and suffix-tree scores of every document; six sevenths of them teach."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", (crc_remainder(7) == 2).alias("held_out"))
    with small_batches(spark):
        model = learn(docs.where(crc_remainder(7) != 2).select("text"))
        with shuffles_freed(spark):  # scored in here, where batches are small; a row per text is kept
            scored = score_texts(rows, model, ("doc_id", "held_out")).checkpoint()
    model.release()
    return scored


@register(
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y USING (sh) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM m LEFT JOIN n USING (doc_id)
"""
)
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: crc32 of a short ASCII text, by its bits.
_CRC = """xor(list_reduce(
  list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i]))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _op11_sql() -> str:
    """Cheapest edits from the last row to the first: ``f0``..``f3`` hold cost, audit and repaired text of each state's rest."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    made, after = ("user", "user", "assistant", "user"), (2, 2, 3, 2)

    def struct(cost: str, audit: str, text: str) -> str:
        return f"struct_pack(c := CAST({cost} AS BIGINT), a := {audit}, t := {text})"

    own, best = [], []
    for s in range(4):
        keep = [
            f"CASE WHEN fault IN (0, 3) AND role[1] = '{i}' THEN "
            + struct(f"x + w.f{n}.c", f"'K' || w.f{n}.a", f"chr(10) || role || ':' || text || w.f{n}.t") + " END"
            for i, n in follow[s].items()
        ]
        n = after[s]
        rerole = "CASE WHEN fault IN (0, 3) THEN " + struct(
            f"2 + x + w.f{n}.c", f"'R' || w.f{n}.a", f"chr(10) || '{made[s]}:' || text || w.f{n}.t") + " END"
        delete = struct(f"3 + w.f{s}.c", f"'D' || w.f{s}.a", f"w.f{s}.t")
        own.append(f"list_sort(list_filter([{', '.join([delete, rerole, *keep])}], lambda z: z IS NOT NULL))[1] AS o{s}")
        insert = struct(f"2 + o{n}.c", f"'I' || o{n}.a", f"chr(10) || '{made[s]}:' || o{n}.t")
        best.append(f"list_sort([o{s}, {insert}])[1]")
    nothing, one = struct("0", "''", "''"), struct("2", "'I'", "chr(10) || 'assistant:'")
    two = struct("4", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")
    return rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), h AS (SELECT *, {_CRC.format("key")} % 20 AS hit FROM d),
r AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM h)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_replace(text, '[ 	-
]+$', '') AS body FROM r
), c AS (
  SELECT *, CASE WHEN body = '' THEN 1
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                 WHEN body[-1] IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM n
), e AS (SELECT *, CASE fault WHEN 3 THEN 1 ELSE 0 END AS x FROM c),
m AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY conv_id
), w AS (
  SELECT conv_id, rows AS i, {nothing} AS f0, {two} AS f1, {one} AS f2, {nothing} AS f3 FROM m
  UNION ALL
  SELECT conv_id, i - 1, {', '.join(best)}
  FROM (SELECT w.conv_id, w.i, {', '.join(own)} FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i)
), f AS (SELECT conv_id, f0 FROM w WHERE i = 0)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(f0.c, 0) AS cost,
       coalesce(f0.a, '') AS audit, sha256(coalesce(substr(f0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS k
LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM k.conv_id
"""


def damaged_conversations(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn`` modulo 20, rows are dropped, emptied, stripped of ends, repeated or made the user's."""
    null = F.lit(" ")
    parts = [F.coalesce(F.col(c).cast("string"), null) for c in ("conv_id", "turn")]
    hit = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20
    text, role = F.coalesce("text", null), F.coalesce("role", null)
    times = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")


@register(_op11_sql())
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = repair_digests(repair_conversations(damaged_conversations(rows)))
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(repaired, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@register()
def op13_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of two thirds of the documents teach."""
    docs = table(spark, sf_dir, "documents")
    state = learn_toxicity(docs, table(spark, sf_dir, "labels").where(crc_remainder(3) != 1))
    rows = docs.select("doc_id", "text", (crc_remainder(3) == 1).alias("held_out"))
    scored = score_toxicity(rows, state)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@register(
    rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ts FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM benchmark
), q AS (SELECT item_id, t, count(*) AS times FROM i GROUP BY item_id, t),
n AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d),
f AS (
  SELECT r, doc_id, t, CAST(count(*) AS BIGINT) AS tf, any_value(len) AS len
  FROM (SELECT r, doc_id, unnest(ts) AS t, CAST(len(ts) AS BIGINT) AS len FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, t
), w AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, n GROUP BY t
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len * docs) // terms)))) AS BIGINT) AS score
  FROM f JOIN q USING (t) JOIN w USING (t), n GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10
"""
)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
