import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators.scans import decay_scan, final_state
from seqloom.operators.sequences import pack_continuous
from seqloom.session import scratch_path
from seqloom.streaming.state import decay_stream, init_state, pack_stream
from tests.conftest import SF001


def test_stream_continues_batch_and_routes_late(spark):
    rows = [(k, i, float((i * 7 + k) % 5)) for k in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "key long, t long, x double").withColumn(
        "ts", F.timestamp_seconds(F.col("t"))
    )
    hist, live = df.where("t < 12"), df.where("t >= 12")
    full = decay_scan(df, "key", ["ts", "t"], "x", decay=0.9, emit_previous="prev")
    hs = decay_scan(hist, "key", ["ts", "t"], "x", decay=0.9)
    fin = final_state(hs, "key").join(
        hist.groupBy("key").agg(F.max(F.unix_micros("ts")).alias("last_us"), F.max("t").alias("last_id")), "key"
    )
    root = scratch_path(spark, "st-test")
    init_state(spark, fin, f"{root}/state")
    for i, (lo, hi) in enumerate([(12, 20), (20, 30)]):
        live.where((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.parquet(f"{root}/in/p{i}")
        time.sleep(0.05)
    # one late row: older than what the state already applied for key 0
    df.where("key = 0 AND t = 5").coalesce(1).write.parquet(f"{root}/in/p9")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        f"{root}/in"
    )
    decay_stream(src, f"{root}/state", f"{root}/out", f"{root}/ck", "key", "ts", "t", "x", decay=0.9).awaitTermination()
    got = spark.read.parquet(f"{root}/out/rows").select("key", "t", F.col("h").alias("gh"), F.col("prev").alias("gp"))
    want = full.where("t >= 12").select("key", "t", "h", "prev")
    diff = got.join(want, ["key", "t"]).agg(
        F.max(F.abs(F.col("gh") - F.col("h"))).alias("dh"), F.max(F.abs(F.col("gp") - F.col("prev"))).alias("dp")
    ).first()
    assert got.count() == want.count()
    assert diff["dh"] < 1e-12 and diff["dp"] < 1e-12
    late = spark.read.parquet(f"{root}/out/late").collect()
    assert [(r["key"], r["rid"]) for r in late] == [(0, 5)]


def test_pack_stream_groups_are_micro_batches(spark):
    enc = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 7))) for i in range(6)], "ordinal long, ids array<int>")
    root = scratch_path(spark, "st2-test")
    for i in range(2):
        enc.where(F.col("ordinal").between(3 * i, 3 * i + 2)).coalesce(1).write.parquet(f"{root}/in/p{i}")
        time.sleep(0.05)
    src = spark.readStream.schema(enc.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        f"{root}/in"
    )
    pack_stream(src, f"{root}/out", f"{root}/ck", seq_len=4).awaitTermination()
    out = spark.read.parquet(f"{root}/out").orderBy("batch_id", "chunk").collect()
    # each batch has 21 tokens -> 4 chunks of 5, tail of 1 dropped
    assert [(r["batch_id"], r["chunk"]) for r in out] == [(0, c) for c in range(4)] + [(1, c) for c in range(4)]
    assert out[0]["input_ids"] == [0, 1, 2, 3, 4] and out[1]["input_ids"] == [5, 6, 10, 11, 12]


@pytest.mark.parametrize("parts", [1, 200])
def test_pairs_independent_of_partitioning(spark, parts):
    from seqloom.catalog.prepare import pair_digest, pairs

    base = pair_digest(pairs(spark, SF001)).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        other = pair_digest(pairs(spark, SF001)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(base) == sorted(other)


def test_pack_stream_carries_tail(spark):
    enc = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 7))) for i in range(6)], "ordinal long, ids array<int>")
    root = scratch_path(spark, "st2-tail")
    for i in range(2):
        enc.where(F.col("ordinal").between(3 * i, 3 * i + 2)).coalesce(1).write.parquet(f"{root}/in/p{i}")
        time.sleep(0.05)
    src = spark.readStream.schema(enc.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        f"{root}/in"
    )
    pack_stream(src, f"{root}/out", f"{root}/ck", seq_len=4, carry_tail=True, state_dir=f"{root}/state").awaitTermination()
    out = spark.read.parquet(f"{root}/out").orderBy("batch_id", "chunk").collect()
    flat = [t for i in range(6) for t in range(i * 10, i * 10 + 7)]
    got = [t for r in out for t in r["input_ids"]]
    # batch 0: 21 tokens -> 4 chunks, 1 carried; batch 1: 1 + 21 = 22 -> 4 chunks, 2 left
    assert [r["batch_id"] for r in out] == [0] * 4 + [1] * 4
    assert got == flat[: len(got)] and len(got) == 40


def _step(spark, root, batch_id, rows, schema="key string, ts timestamp_ntz, id string, x double"):
    import datetime as dt

    from seqloom.streaming.state import decay_step_batch

    data = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i, x) for k, s, i, x in rows]
    batch = spark.createDataFrame(data, schema)
    decay_step_batch(batch, batch_id, f"{root}/state", f"{root}/out", "key", "ts", "id", "x", 0.5)


def test_stream_state_keeps_null_and_string_keys(spark):
    root = scratch_path(spark, "st1-null")
    _step(spark, root, 0, [(None, 0, "a", 1.0), ("k", 0, "b", 1.0)])
    _step(spark, root, 1, [(None, 1, "c", 1.0)])
    _step(spark, root, 2, [(None, 2, "d", 1.0), ("k", 3, "e", 0.0)])
    h = {r["id"]: r["h"] for r in spark.read.parquet(f"{root}/out/rows").collect()}
    assert h == {"a": 0.5, "b": 0.5, "c": 0.75, "d": 0.875, "e": 0.25}
    state = spark.read.parquet(f"{root}/state/v={2:09d}").collect()
    assert sorted((str(r["key"]), r["rows"]) for r in state) == [("None", 3), ("k", 2)]


def test_stream_fails_on_unreadable_state(spark):
    import os

    root = scratch_path(spark, "st1-bad")
    _step(spark, root, 0, [("k", 0, "a", 1.0)])
    with pytest.raises(Exception):  # noqa: B017 - version 1 was never written
        _step(spark, root, 2, [("k", 1, "b", 1.0)])
    folder = f"{root}/state/v={0:09d}"
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            with open(f"{folder}/{f}", "wb") as out:
                out.write(b"broken")
            crc = f"{folder}/.{f}.crc"
            if os.path.exists(crc):
                os.remove(crc)
    with pytest.raises(Exception):  # noqa: B017 - a damaged state is not an empty one
        _step(spark, root, 1, [("k", 1, "b", 1.0)])


def test_pack_stream_in_groups(spark):
    enc = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 7))) for i in range(12)], "ordinal long, ids array<int>")
    root = scratch_path(spark, "st2-groups")
    enc.repartition(1).write.parquet(f"{root}/in")
    src = spark.readStream.schema(enc.schema).parquet(f"{root}/in")
    pack_stream(src, f"{root}/out", f"{root}/ck", seq_len=4, group_docs=3).awaitTermination()
    got = sorted((r["group_id"], r["chunk"]) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [(g, c) for g in range(4) for c in range(4)]  # 21 tokens a group: four chunks of 5


def test_carried_stream_equals_one_pack(spark):
    """Micro-batches of any size, empty ones and long documents included, give the chunks of one big pack."""
    rng = np.random.default_rng(4)
    sizes = [0, 1, 900, 3, 0, 0, 17, 64, 5000] + rng.integers(0, 40, 400).tolist()
    ids = rng.integers(0, 1000, sum(sizes)).tolist()
    at = np.append(0, np.cumsum(sizes)).tolist()
    rows = [(7 * i, ids[a:z]) for i, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True))] + [(10**6, None)]
    docs = spark.createDataFrame(rows, "ordinal long, ids array<int>")
    root = scratch_path(spark, "st2-carry")
    edges = [0, 1, 3, 3, 40, 2000, 10**7]
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        docs.where((F.col("ordinal") >= lo) & (F.col("ordinal") < hi)).repartition(3).write.parquet(f"{root}/in/p{i}")
        src = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        pack_stream(src, f"{root}/out", f"{root}/ck", seq_len=63, carry_tail=True, state_dir=f"{root}/state").awaitTermination()
    got = spark.read.parquet(f"{root}/out").orderBy("seq_id").collect()
    assert [r["seq_id"] for r in got] == list(range(len(ids) // 64))
    assert [t for r in got for t in r["input_ids"]] == ids[: len(ids) // 64 * 64]
    last = sorted(r["batch_id"] for r in got)[-1]
    state = spark.read.parquet(f"{root}/state/v={last:09d}").first()
    assert state["ids"] == ids[len(ids) // 64 * 64 :] and state["chunks"] == len(ids) // 64


def test_pack_continuous_cuts_in_several_tasks(spark):
    docs = spark.createDataFrame([(i, list(range(10 * i, 10 * i + 10))) for i in range(500)], "ordinal long, ids array<int>").repartition(5)
    whole, rest = pack_continuous(docs, 6, lead=[-2, -1])
    want = [-2, -1, *range(5000)]
    rows = whole.orderBy("chunk").collect()
    assert [t for r in rows for t in r["input_ids"]] == want[: len(want) // 7 * 7]
    assert [r["ids"] for r in rest.collect()] == [want[len(want) // 7 * 7 :]]
    assert whole.select(F.spark_partition_id()).distinct().count() > 4
    empty, none = pack_continuous(docs.limit(0), 6)
    assert empty.count() == 0 and none.count() == 0
