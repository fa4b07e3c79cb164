"""Stateful streaming operators (ST1, ST2) on Structured Streaming ``foreachBatch``.

State lives in a versioned parquet table in the shared checkpoint folder:
micro-batch ``n`` reads version ``n-1`` and writes version ``n``; outputs go
to ``batch_id=n`` folders written with overwrite. A replayed micro-batch
(after a driver or executor failure) therefore recomputes and overwrites the
same files: the sink is idempotent and no state is applied twice. No local
port or state server is opened.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.portable import epoch_micros
from ..operators.scans import decay_scan
from ..operators.sequences import pack, pack_continuous


def _version_path(state_dir: str, n: int) -> str:
    return f"{state_dir.rstrip('/')}/v={n:09d}"


def _read_state(spark: SparkSession, state_dir: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The state before this micro-batch. Only the first one may find none; anything else that fails, fails."""
    prev = _version_path(state_dir, batch_id - 1)
    try:
        return spark.read.schema(schema).parquet(prev)
    except AnalysisException as e:
        if batch_id == 0 and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def state_schema(key: T.DataType, rid: T.DataType) -> T.StructType:
    return (
        T.StructType().add("key", key).add("h", "double").add("last_us", "long").add("last_id", rid).add("rows", "long")
    )


def init_state(spark: SparkSession, final: DataFrame, state_dir: str) -> None:
    """Write E4's output (``key, h, last_us, last_id, rows``) as state version -1;
    ``last_us`` is the last applied time in epoch microseconds. Key and id keep their types."""
    final.select(
        "key", F.col("h").cast("double"), F.col("last_us").cast("bigint"), "last_id", F.col("rows").cast("bigint")
    ).write.mode("overwrite").parquet(_version_path(state_dir, -1))


def decay_step_batch(
    batch: DataFrame,
    batch_id: int,
    state_dir: str,
    out_dir: str,
    key: str,
    ts: str,
    rid: str,
    value: str,
    decay: float,
) -> None:
    """ST1 micro-batch: per key, read ``h``, emit, then write the new ``h``.

    Rows are ordered by ``(ts, id)`` within the batch. A row not after the key's
    last applied ``(ts, id)`` is late: it is routed to ``late/`` and not applied.
    For the others the batch is scanned from zero and the carried state is
    added with its decay: ``h_t = h'_t + d^(k+1) h0`` and ``prev_t = prev'_t + d^k h0``.
    Joins are on a struct around the key, so a null key is a key like any other.
    """
    spark = batch.sparkSession
    held = F.struct(F.col("key").alias("k")).alias("__key")
    kinds = state_schema(batch.schema[key].dataType, batch.schema[rid].dataType)
    state = _read_state(spark, state_dir, batch_id, kinds).select("*", held)
    rows = batch.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(rid).alias("rid"),
                        F.col(value).cast("double").alias("x"),
                        epoch_micros(ts, batch.schema[ts].dataType).alias("__us"))
    j = rows.select("*", held).join(state.select("__key", "h", "last_us", "last_id"), "__key", "left").drop("__key")
    late_cond = F.col("last_us").isNotNull() & (
        (F.col("__us") < F.col("last_us")) | ((F.col("__us") == F.col("last_us")) & (F.col("rid") <= F.col("last_id")))
    )
    j = j.withColumn("__late", F.coalesce(late_cond, F.lit(False)))
    late = j.where("__late").select("key", "ts", "rid", "x")
    live = j.where(~F.col("__late")).withColumn("h0", F.coalesce(F.col("h"), F.lit(0.0))).drop("h", "last_us", "last_id", "__late")
    sc = decay_scan(live, "key", ["ts", "rid"], "x", decay=decay, out="hb", emit_previous="pb")
    d = float(decay)
    sc = sc.withColumn("h", F.col("hb") + F.pow(F.lit(d), (F.col("k") + 1).cast("double")) * F.col("h0")).withColumn(
        "prev", F.col("pb") + F.pow(F.lit(d), F.col("k").cast("double")) * F.col("h0")
    )
    out = sc.select(F.col("key").alias(key), F.col("ts").alias(ts), F.col("rid").alias(rid), F.col("x").alias(value), "h", "prev")
    out.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/rows/batch_id={batch_id:09d}")
    late.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/late/batch_id={batch_id:09d}")
    written = spark.read.parquet(f"{out_dir.rstrip('/')}/rows/batch_id={batch_id:09d}")
    last = written.groupBy(F.col(key).alias("key")).agg(
        F.max_by("h", F.struct(ts, rid)).alias("h"),
        F.max(epoch_micros(ts, written.schema[ts].dataType)).alias("last_us"),
        F.max_by(rid, F.struct(ts, rid)).alias("last_id"),
        F.count(F.lit(1)).cast("bigint").alias("__n"),
    ).select("*", held)
    carried = state.join(last.select("__key"), "__key", "left_anti").drop("__key")
    updated = last.join(state.select("__key", "rows"), "__key", "left").select(
        "key", "h", "last_us", "last_id", (F.coalesce(F.col("rows"), F.lit(0)) + F.col("__n")).cast("bigint").alias("rows")
    )
    carried.unionByName(updated).write.mode("overwrite").parquet(_version_path(state_dir, batch_id))


def decay_stream(
    stream: DataFrame,
    state_dir: str,
    out_dir: str,
    checkpoint: str,
    key: str,
    ts: str,
    rid: str,
    value: str,
    decay: float = 0.9,
    available_now: bool = True,
):
    """ST1: start the step-mode stream; initial state must have been written with
    ``init_state`` (E4's output of the history). Returns the started query."""
    def fn(df, batch_id):
        decay_step_batch(df, batch_id, state_dir, out_dir, key, ts, rid, value, decay)

    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


TAIL_SCHEMA = T.StructType().add("chunks", "long").add("ids", T.ArrayType(T.IntegerType()))


def pack_stream(
    stream: DataFrame,
    out_dir: str,
    checkpoint: str,
    seq_len: int,
    ids: str = "ids",
    ordinal: str = "ordinal",
    available_now: bool = True,
    carry_tail: bool = False,
    state_dir: str | None = None,
    group_docs: int | None = None,
):
    """ST2: each micro-batch of encoded documents is packed, as one group or in groups.

    With ``group_docs`` the documents with one ``ordinal div group_docs`` form a group, the groups of a
    micro-batch are packed by as many tasks, and ``group_id`` tells them apart; a micro-batch holds whole groups.
    Without it the micro-batch is the group and is packed as one run of tokens: each task cuts the chunks of its own
    range of documents, its place in the run follows from the token counts of the ranges before it. By default the
    group's tail is dropped (the reference's rule, with the micro-batch as the group). With ``carry_tail`` the
    leftover tokens (fewer than one chunk) and the number of chunks so far are kept as versioned state; the tail goes in
    front of the next micro-batch, so across batches only the final tail is lost, and ``seq_id`` numbers the chunks as
    one pack of all documents would. Output folders ``batch_id=n`` hold ``(batch_id, chunk, input_ids)`` with
    ``group_id`` or ``seq_id`` where named above; a replayed batch rewrites the same folder and state version.
    """
    if carry_tail and not state_dir:
        raise ValueError("carry_tail needs a state_dir")
    if carry_tail and group_docs:
        raise ValueError("carry_tail continues one group; it goes without group_docs")

    def fn(df, batch_id):
        spark = df.sparkSession
        docs = df.select(F.col(ordinal).cast("bigint").alias("ordinal"), F.col(ids).cast("array<int>").alias("ids"))
        number = F.lit(batch_id).cast("bigint").alias("batch_id")
        folder = f"{out_dir.rstrip('/')}/batch_id={batch_id:09d}"
        if group_docs:
            seqs = pack(docs, seq_len=seq_len, ids="ids", ordinal="ordinal", group_docs=group_docs)
            seqs.select(number, "group_id", "chunk", "input_ids").write.mode("overwrite").parquet(folder)
            return
        before = _read_state(spark, state_dir, batch_id, TAIL_SCHEMA).first() if carry_tail else None  # less than a chunk
        done, lead = (before["chunks"], list(before["ids"])) if before else (0, [])
        seqs, rest = pack_continuous(docs, seq_len, "ids", "ordinal", lead)
        named = [(F.col("chunk") + F.lit(done)).alias("seq_id")] if carry_tail else []
        seqs.select(number, *named, "chunk", "input_ids").write.mode("overwrite").parquet(folder)
        if carry_tail:
            left = rest.first()  # at most one row of less than a chunk
            chunks = done + (left["chunk"] if left else spark.read.parquet(folder).count())
            tail = spark.createDataFrame([(chunks, left["ids"] if left else [])], TAIL_SCHEMA)
            tail.write.mode("overwrite").parquet(_version_path(state_dir, batch_id))

    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
