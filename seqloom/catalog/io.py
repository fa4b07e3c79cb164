"""Source, sink, loader-plan, lookup and streaming queries: S1-S4, M1, L1-L4, T2, ST1, ST2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import digest
from ..functions.portable import epoch_micros, r6, r6_sql, uniform_sql
from ..operators.sequences import build_vocab, encode, lookup
from ..plans.batches import accumulate, annotate_steps, assign_shards, plan_batches, steps_report
from ..session import scratch_path, shuffles_freed
from ..sources.corpora import Corpus, canonical_path, mixed_corpus, scan_artifacts, scan_corpora, scan_pairs, write_pair_shards
from ..streaming.state import decay_stream, init_state, pack_stream
from ..operators.scans import decay_scan, final_state
from . import prepare, register, table
from .prepare import SEQ_LEN, _sql_encoded, _sql_masked, _sql_packed, _sql_pair_digest, _sql_taken, _with, pair_digest, pairs
from .scans import _SQL_REC, D

SEED = 42
WEIGHTS = (0.6, 0.4)
FILE_ROWS = 100  # rows per pair file, small enough that the smallest tables give several
WORKERS = 4
BATCH = 4
MAX_STEPS = 150
WARMUP = 20
ACCUM = 2
EVERY = 50
L4_K = 4
STREAM_CHUNK = 50  # documents per pack group of the stream
ARRIVALS = 3  # micro-batches of the streaming queries, whatever the size of the table


def _corpora(sf_dir: str, with_missing: bool = False) -> list[Corpus]:
    c = [
        Corpus("documents", f"{sf_dir}/documents.parquet", weight=WEIGHTS[0], order=["doc_id"]),
        Corpus(
            "conversations", f"{sf_dir}/conversations.parquet", weight=WEIGHTS[1], order=["conv_id", "turn"],
            rename={"text": "content"},
        ),
    ]
    if with_missing:
        c.append(Corpus("absent", f"{sf_dir}/no_such_corpus.parquet", weight=0.5, optional=True, order=["id"]))
    return c


@register(
    "s1_scan_corpora",
    """
SELECT 'documents' AS source, doc_id AS id, CAST(-1 AS BIGINT) AS turn, md5(text) AS text_md5 FROM documents
UNION ALL
SELECT 'conversations', conv_id, turn, md5(text) FROM conversations""",
)
def s1_scan_corpora(spark, sf_dir):
    # the second corpus arrives with its text under `content`, a third is missing (optional)
    corpora = _corpora(sf_dir, with_missing=True)
    opened = scan_corpora(spark, corpora)
    out = None
    for c, df in opened:
        ident = (F.col("doc_id"), F.lit(-1).cast("bigint")) if c.name == "documents" else (F.col("conv_id"), F.col("turn"))
        f = df.select(F.lit(c.name).alias("source"), ident[0].alias("id"), ident[1].alias("turn"), F.md5("text").alias("text_md5"))
        out = f if out is None else out.unionByName(f)
    return out


def _sql_interleave() -> str:
    u = uniform_sql(SEED, "'draw'", "draw")
    cut = WEIGHTS[0] / sum(WEIGHTS)
    return f"""
WITH d AS (SELECT 0 AS source, row_number() OVER (ORDER BY doc_id) - 1 AS rk, text FROM documents),
c AS (SELECT 1 AS source, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rk, text FROM conversations),
src AS (SELECT * FROM d UNION ALL SELECT * FROM c),
sizes AS (SELECT source, count(*) AS n FROM src GROUP BY source),
draws AS (SELECT draw, CASE WHEN {u} < {cut!r} THEN 0 ELSE 1 END AS source
          FROM (SELECT unnest(range(0, CAST((SELECT sum(n) FROM sizes) + 1 AS BIGINT))) AS draw) r),
ranked AS (SELECT draw, source, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS rk FROM draws),
cut AS (SELECT min(draw) AS cut FROM ranked JOIN sizes USING (source) WHERE rk >= n)
SELECT CAST(r.draw AS BIGINT) AS draw, CASE r.source WHEN 0 THEN 'documents' ELSE 'conversations' END AS source,
       md5(s.text) AS text_md5
FROM ranked r JOIN src s ON s.source = r.source AND s.rk = r.rk
WHERE r.draw < (SELECT cut FROM cut)"""


@register("m1_interleave", _sql_interleave())
def m1_interleave(spark, sf_dir):
    corpora = _corpora(sf_dir)
    mixed = mixed_corpus(spark, corpora, seed=SEED)
    return mixed.select("draw", "source", F.md5("text").alias("text_md5"))


_PAIRS_WITH = _with(_sql_taken(), _sql_encoded(), _sql_packed(SEQ_LEN, prepare.GROUP_DOCS), _sql_masked())

_T4_SQL = _with(_sql_taken(), _sql_encoded(), _sql_packed(SEQ_LEN, prepare.GROUP_DOCS), _sql_masked()) + _sql_pair_digest()


def _written_pairs(spark, sf_dir) -> str:
    return write_pair_shards(pairs(spark, sf_dir), scratch_path(spark, "pairs"), file_rows=FILE_ROWS)


@register("s3_write_pairs", _T4_SQL)
def s3_write_pairs(spark, sf_dir):
    path = _written_pairs(spark, sf_dir)
    return pair_digest(spark.read.parquet(path))


@register("s2_scan_pairs", _T4_SQL)
def s2_scan_pairs(spark, sf_dir):
    path = _written_pairs(spark, sf_dir)
    return pair_digest(scan_pairs(spark, path))


@register(
    "s4_scan_artifacts",
    _PAIRS_WITH + "\nSELECT CAST(count(*) AS BIGINT) AS rows, true AS all_listed, true AS all_filled FROM masked",
)
def s4_scan_artifacts(spark, sf_dir):
    # the listing of the files that the sink wrote, against the rows read from each
    path = _written_pairs(spark, sf_dir)
    listing = scan_artifacts(spark, path, "*.parquet").select(canonical_path("path").alias("name"), "length")
    read = scan_pairs(spark, path).groupBy(canonical_path("file").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    both = listing.join(read, "name", "full_outer")
    return both.agg(
        F.sum("n").cast("bigint").alias("rows"),
        F.bool_and(F.col("length").isNotNull()).alias("all_listed"),
        F.bool_and(F.col("n").isNotNull() & (F.col("length") > 0)).alias("all_filled"),
    )


# ---- loader plans over the files that the sink wrote

def _loader(spark, sf_dir):
    """Rows ``(file, row, seq_id)`` and listed files of the written pairs, as the readers see them."""
    path = _written_pairs(spark, sf_dir)
    rows = scan_pairs(spark, path).select(canonical_path("file").alias("file"), "row", "seq_id")
    files = scan_artifacts(spark, path, "*.parquet").select(canonical_path("path").alias("path"))
    return rows, assign_shards(files, WORKERS)


_SQL_ROWS = f""",
prow AS (SELECT printf('shard=%012d', CAST(seq_id // {FILE_ROWS} AS BIGINT)) AS file, seq_id % {FILE_ROWS} AS row, seq_id FROM masked),
files AS (SELECT file, CAST(row_number() OVER (ORDER BY file) - 1 AS BIGINT) AS file_rank FROM (SELECT DISTINCT file FROM prow) f),
per AS (SELECT CAST(ceil(count(*) / {float(WORKERS)!r}) AS BIGINT) AS per FROM files),
shards AS (SELECT file, file_rank, CAST(file_rank // (SELECT per FROM per) AS BIGINT) AS worker FROM files)"""



@register("l1_assign_shards", _PAIRS_WITH + _SQL_ROWS + "\nSELECT file AS path, file_rank, worker FROM shards")
def l1_assign_shards(spark, sf_dir):
    _, shards = _loader(spark, sf_dir)
    return shards.select(F.regexp_extract("path", "(shard=[0-9]+)", 1).alias("path"), "file_rank", "worker")


_SQL_BATCHES = _SQL_ROWS + f""",
wr AS (SELECT prow.seq_id, s.worker, s.file_rank, prow.row,
              CAST(row_number() OVER (PARTITION BY s.worker ORDER BY s.file_rank, prow.row) - 1 AS BIGINT) AS ordinal_in_worker
       FROM prow JOIN shards s USING (file)),
wb AS (SELECT *, ordinal_in_worker // {BATCH} AS batch FROM wr),
nb AS (SELECT worker, max(batch) + 1 AS nb FROM wb GROUP BY worker),
stepped AS (
  SELECT wb.seq_id, wb.worker, wb.batch, wb.ordinal_in_worker,
         CAST((SELECT sum(least(wb.batch, nb.nb)) + sum(CASE WHEN nb.worker < wb.worker AND nb.nb > wb.batch THEN 1 ELSE 0 END)
               FROM nb) AS BIGINT) AS step
  FROM wb)"""


def _batches(spark, sf_dir):
    rows, shards = _loader(spark, sf_dir)
    return plan_batches(rows, shards, BATCH)


@register("l2_plan_batches", _PAIRS_WITH + _SQL_BATCHES + "\nSELECT seq_id, worker, batch, ordinal_in_worker, step FROM stepped")
def l2_plan_batches(spark, sf_dir):
    return _batches(spark, sf_dir).select("seq_id", "worker", "batch", "ordinal_in_worker", "step")


@register(
    "l3_annotate_steps",
    _PAIRS_WITH
    + _SQL_BATCHES
    + f""",
ann AS (
  SELECT seq_id, worker, batch, step AS global_step,
         CASE WHEN step < {WARMUP} THEN step / {float(max(1, WARMUP))!r}
              ELSE 0.5 * (1.0 + cos(pi() * ((step - {WARMUP}) / {float(max(1, MAX_STEPS - WARMUP))!r}))) END AS m
  FROM stepped WHERE step < {MAX_STEPS})
SELECT seq_id, worker, batch, global_step, {r6_sql('m')} AS lr_mult, {r6_sql('0.01 * m')} AS lr_matrix, {r6_sql('0.001 * m')} AS lr_vector,
       global_step % {ACCUM} = 0 AS accum_open, (global_step + 1) % {ACCUM} = 0 AS accum_close,
       global_step % 10 = 0 AS log, global_step > 0 AND global_step % {EVERY} = 0 AS checkpoint
FROM ann""",
)
def l3_annotate_steps(spark, sf_dir):
    a = annotate_steps(_batches(spark, sf_dir), start=0, max_steps=MAX_STEPS, warmup=WARMUP, accum=ACCUM, every=EVERY)
    return a.select(
        "seq_id", "worker", "batch",
        "global_step", r6("lr_mult").alias("lr_mult"), r6("lr_matrix").alias("lr_matrix"), r6("lr_vector").alias("lr_vector"),
        "accum_open", "accum_close", "log", "checkpoint",
    )


@register(
    "l4_accumulate",
    f"""
WITH w AS (SELECT event_id // {L4_K} AS win, max(CASE WHEN event_id % {L4_K} = {L4_K - 1} THEN 1 ELSE 0 END) AS closed,
                  sum(value) AS s1, sum(value * value) AS s2
           FROM events GROUP BY 1)
SELECT CAST(win AS BIGINT) AS win, {r6_sql('s1')} AS v0, {r6_sql('s2')} AS v1 FROM w WHERE closed = 1""",
)
def l4_accumulate(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.array(F.col("value"), F.col("value") * F.col("value")).alias("g")
    )
    acc = accumulate(ev, "event_id", "g", L4_K)
    return acc.select(F.col("window").alias("win"), r6(F.col("g")[0]).alias("v0"), r6(F.col("g")[1]).alias("v1"))


@register(
    "t2_lookup",
    _with(
        _sql_taken(),
        _sql_encoded().replace(
            f"LIMIT {prepare.VOCAB - len(prepare.SPECIALS)}", f"LIMIT (SELECT max(vec_id) + 1 - {len(prepare.SPECIALS)} FROM embeddings)"
        ),
    )
    + f""",
tok AS (SELECT ordinal, unnest(ids) AS id FROM encoded),
vecs AS (SELECT tok.ordinal, list_sum(CAST(e.embedding AS DOUBLE[])) AS s FROM tok JOIN embeddings e ON e.vec_id = tok.id)
SELECT ordinal, CAST(count(*) AS BIGINT) AS n_vectors, {r6_sql('sum(s)')} AS total FROM vecs GROUP BY ordinal""",
)
def t2_lookup(spark, sf_dir):
    docs = prepare.prepared_docs(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1  # a vector for every id
    with shuffles_freed(spark):  # the word counts are written, their shuffle goes
        # the vocabulary pass reads the documents in place
        enc = encode(docs, build_vocab(prepare.selected_docs(spark, sf_dir), size=rows), keys=["ordinal"])
    # moved as they are, handed on as doubles
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("token_id"), F.col("embedding").alias("vec"))
    v = lookup(enc, emb, "ids", "ordinal", element="double")
    total = F.aggregate(F.col("vectors"), F.lit(0.0), lambda a, vec: a + F.aggregate(vec, F.lit(0.0), lambda b, x: b + x))
    return v.select("ordinal", F.size("vectors").cast("bigint").alias("n_vectors"), r6(total).alias("total"))


# ---- streaming

_CUT_SQL = "(SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events)"


@register(
    "st1_decay_stream",
    _SQL_REC.replace(
        "SELECT user_id, event_id, CAST(value AS DOUBLE) AS x,",
        "SELECT user_id, event_id, epoch_us(ts) AS us, CAST(value AS DOUBLE) AS x,",
    ).replace(
        "r AS (\n  SELECT user_id, k, event_id, x,",
        "r AS (\n  SELECT user_id, k, event_id, us, x,",
    ).replace("SELECT ev.user_id, ev.k, ev.event_id, ev.x,", "SELECT ev.user_id, ev.k, ev.event_id, ev.us, ev.x,")
    + f"SELECT event_id, {r6_sql('h')} AS h, {r6_sql('prev')} AS prev FROM r WHERE us >= {_CUT_SQL}",
)
def st1_decay_stream(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    us = epoch_micros("ts", ev.schema["ts"].dataType)
    lo, hi = ev.agg(F.min(us), F.max(us)).first()
    cut = (lo + hi) // 2
    history = ev.where(us < cut)
    stream_rows = ev.where(us >= cut)
    hs = decay_scan(history, "user_id", ["ts", "event_id"], "value", decay=D)
    fin = final_state(hs, "user_id").join(
        history.groupBy("user_id").agg(
            F.max(us).alias("last_us"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id")
        ),
        "user_id",
    ).withColumnRenamed("user_id", "key")
    root = scratch_path(spark, "st1")
    init_state(spark, fin, f"{root}/state")
    # the stream arrives in three chronological parts; each is one micro-batch of the same query
    q = stream_rows.select(us.alias("__us")).agg(F.min("__us"), F.max("__us")).first()
    edges = [q[0] + (q[1] - q[0] + 1) * i // 3 for i in range(4)]
    for i in range(3):
        part = stream_rows.where((us >= edges[i]) & (us < edges[i + 1]) if i < 2 else (us >= edges[i]))
        part.write.parquet(f"{root}/in/part{i}")
        src = spark.readStream.schema(stream_rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        decay_stream(
            src, f"{root}/state", f"{root}/out", f"{root}/ckpt", "user_id", "ts", "event_id", "value", decay=D
        ).awaitTermination()
    out = spark.read.parquet(f"{root}/out/rows")
    return out.select("event_id", r6("h").alias("h"), r6("prev").alias("prev"))


@register(
    "st2_pack_stream",
    _with(_sql_taken(), _sql_encoded(), _sql_packed(SEQ_LEN, STREAM_CHUNK))
    + """
SELECT group_id AS batch_id, chunk, CAST(len(input_ids) AS BIGINT) AS n_tokens, md5(array_to_string(input_ids, '|')) AS ids_md5
FROM packed""",
)
def st2_pack_stream(spark, sf_dir):
    root = scratch_path(spark, "st2")
    # the groups arrive in three parts; each is one micro-batch of the same query and holds whole groups
    _in_arrivals(
        spark, sf_dir, root, F.floor(F.col("ordinal") / F.lit(STREAM_CHUNK)),
        lambda src: pack_stream(src, f"{root}/out", f"{root}/ckpt", SEQ_LEN, group_docs=STREAM_CHUNK),
    )
    out = spark.read.parquet(f"{root}/out")
    return out.select(
        F.col("group_id").alias("batch_id"), "chunk", F.size("input_ids").cast("bigint").alias("n_tokens"), digest("input_ids").alias("ids_md5")
    )


def _in_arrivals(spark, sf_dir, root, unit, start):
    """Write the encoded documents in ARRIVALS parts by ``unit`` (monotone in the ordinal) and run the stream after each."""
    enc, _ = prepare.encoded_docs(spark, sf_dir)
    enc = enc.select("*", unit.cast("bigint").alias("unit")).checkpoint()
    units = (enc.agg(F.max("unit")).first()[0] or 0) + 1
    for i in range(ARRIVALS):
        part = enc.where((F.col("unit") >= units * i // ARRIVALS) & (F.col("unit") < units * (i + 1) // ARRIVALS)).drop("unit")
        part.write.parquet(f"{root}/in/part{i}")
        src = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        start(src).awaitTermination()


@register(
    "st2_carry_stream",
    _with(_sql_taken(), _sql_encoded(), _sql_packed(SEQ_LEN, 1 << 60))
    + """
SELECT seq_id, CAST(len(input_ids) AS BIGINT) AS n_tokens, md5(array_to_string(input_ids, '|')) AS ids_md5 FROM packed""",
)
def st2_carry_stream(spark, sf_dir):
    """Three micro-batches with a carried tail give the chunks of one pack of all documents."""
    root = scratch_path(spark, "st2c")
    _in_arrivals(
        spark, sf_dir, root, F.col("ordinal"),
        lambda src: pack_stream(src, f"{root}/out", f"{root}/ckpt", SEQ_LEN, carry_tail=True, state_dir=f"{root}/state"),
    )
    out = spark.read.parquet(f"{root}/out")
    return out.select("seq_id", F.size("input_ids").cast("bigint").alias("n_tokens"), digest("input_ids").alias("ids_md5"))


@register(
    "l3_steps_report",
    _PAIRS_WITH
    + _SQL_BATCHES
    + f"""
SELECT CAST(count(DISTINCT step) AS BIGINT) AS batches,
       CAST(least(count(DISTINCT step), {MAX_STEPS}) AS BIGINT) AS reachable_steps,
       CAST({MAX_STEPS} AS BIGINT) AS max_steps,
       count(DISTINCT step) < {MAX_STEPS} AS schedule_truncated
FROM stepped""",
)
def l3_steps_report(spark, sf_dir):
    return steps_report(_batches(spark, sf_dir), start=0, max_steps=MAX_STEPS)
