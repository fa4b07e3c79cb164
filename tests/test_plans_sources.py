import os
import tempfile

import pytest
from pyspark.sql import functions as F

from seqloom.operators.mixing import Source, interleave
from seqloom.plans.batches import accumulate, annotate_steps, assign_shards, plan_batches
from seqloom.sources.corpora import Corpus, mixed_corpus, scan_artifacts, scan_pairs, write_pairs


def _files(spark, n):
    return spark.createDataFrame([(f"f{i:02d}",) for i in range(n)], "path string")


@pytest.mark.parametrize("files,workers", [(5, 1), (5, 2), (5, 4), (5, 7), (1, 4)])
def test_shards_cover_each_file_once(spark, files, workers):
    s = assign_shards(_files(spark, files), workers).collect()
    assert sorted(r["path"] for r in s) == [f"f{i:02d}" for i in range(files)]
    per = -(-files // workers)
    assert all(r["worker"] == r["file_rank"] // per for r in s)


def test_shards_without_workers(spark):
    assert {r["worker"] for r in assign_shards(_files(spark, 3), None).collect()} == {0}


def test_batch_plan_round_robin(spark):
    rows = spark.createDataFrame([(f"f{i // 3:02d}", i % 3) for i in range(15)], "file string, row long")
    shards = assign_shards(_files(spark, 5), 2)  # worker 0: f00-f02 (9 rows), worker 1: f03-f04 (6 rows)
    b = plan_batches(rows, shards, batch_size=4).collect()
    steps = sorted({(r["worker"], r["batch"], r["step"]) for r in b})
    assert steps == [(0, 0, 0), (0, 1, 2), (0, 2, 4), (1, 0, 1), (1, 1, 3)]
    assert max(r["ordinal_in_worker"] for r in b if r["worker"] == 0) == 8


def test_step_annotation(spark):
    steps = spark.createDataFrame([(s,) for s in range(12)], "step long")
    a = annotate_steps(steps, start=0, max_steps=10, warmup=2, accum=4, every=5).orderBy("global_step").collect()
    assert len(a) == 10
    assert a[1]["lr_mult"] == pytest.approx(0.5) and a[2]["lr_mult"] == pytest.approx(1.0)
    assert a[0]["accum_open"] and a[3]["accum_close"] and a[5]["checkpoint"] and not a[0]["checkpoint"]


def test_accumulate_drops_trailing_window(spark):
    df = spark.createDataFrame([(s, [1.0, float(s)]) for s in range(10)], "step long, g array<double>")
    acc = {r["window"]: r["g"] for r in accumulate(df, "step", "g", 4).collect()}
    assert acc == {0: [4.0, 6.0], 1: [4.0, 22.0]}


def test_interleave_order_and_rates(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(3000)], "id long, text string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(3000)], "id long, text string")
    out = interleave([Source(a, ["id"], "a"), Source(b, ["id"], "b")], [0.6, 0.4], seed=42, out_cols=["text"])
    rows = out.orderBy("draw").collect()
    assert [r["draw"] for r in rows] == list(range(len(rows)))
    for src in ("a", "b"):
        seq = [int(r["text"][1:]) for r in rows if r["source"] == src]
        assert seq == list(range(len(seq)))  # per-source order kept
    na = sum(1 for r in rows if r["source"] == "a")
    n = len(rows)
    assert abs(na / n - 0.6) < 4 * (0.24 / n) ** 0.5
    assert na == 3000 or n - na == 3000  # stops at the first draw that finds its source empty


def test_optional_corpus_missing(spark, tmp_path):
    p = str(tmp_path / "c1")
    spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, content string").write.parquet(p)
    out = mixed_corpus(spark, [Corpus("one", p, order=["id"]), Corpus("gone", str(tmp_path / "nope"), optional=True)])
    assert [r["text"] for r in out.orderBy("draw").collect()] == [f"t{i}" for i in range(5)]
    with pytest.raises(Exception):
        mixed_corpus(spark, [Corpus("gone", str(tmp_path / "nope"))])


def test_pairs_sink_and_scan(spark, tmp_path):
    rows = [(i, [i, i + 1], [i, i + 1]) for i in range(20)]
    df = spark.createDataFrame(rows, "seq_id long, context_ids array<int>, target_ids array<int>")
    path = str(tmp_path / "pairs")
    write_pairs(df, path, files=3)
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    assert len(files) >= 2
    # a ragged file is dropped as a whole, a corrupt file is skipped
    spark.createDataFrame([(100, [1], [1]), (101, [1, 2], [1, 2])], df.schema).coalesce(1).write.parquet(str(tmp_path / "r"))
    rag = [f for f in os.listdir(tmp_path / "r") if f.endswith(".parquet")][0]
    os.rename(tmp_path / "r" / rag, os.path.join(path, "zz-ragged.parquet"))
    with open(os.path.join(path, "zzz-corrupt.parquet"), "wb") as fh:
        fh.write(b"not parquet")
    got = scan_pairs(spark, path)
    assert sorted(r["seq_id"] for r in got.collect()) == list(range(20))
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError):
        scan_pairs(spark, str(empty))


def test_artifact_listing(spark, tmp_path):
    for n in ("model_step_9.pt", "model_step_10.pt", "model_step_x.pt", "notes.txt"):
        (tmp_path / n).write_bytes(b"x" * 3)
    got = scan_artifacts(spark, str(tmp_path), "model_step_*.pt")
    assert got.columns == ["path", "modificationTime", "length"]
    assert sorted(os.path.basename(r["path"]) for r in got.collect()) == ["model_step_10.pt", "model_step_9.pt", "model_step_x.pt"]


def test_steps_report(spark):
    from seqloom.plans.batches import steps_report

    steps = spark.createDataFrame([(s,) for s in range(25)], "step long")
    r = steps_report(steps, start=0, max_steps=100).first()
    assert (r["batches"], r["reachable_steps"], r["schedule_truncated"]) == (25, 25, True)
    r = steps_report(steps, start=90, max_steps=100).first()
    assert (r["reachable_steps"], r["schedule_truncated"]) == (10, False)


def test_reference_mask_rule():
    from seqloom.operators.sequences import EOS_ID, reference_mask_id

    assert reference_mask_id(128256) == 128000
    assert reference_mask_id(32000) == EOS_ID
    assert reference_mask_id(32000, mask_token_id=7) == 7


def test_interleave_with_an_empty_source(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(50)], "id long, text string")
    b = spark.createDataFrame([], "id long, text string")
    out = interleave([Source(a, ["id"], "a"), Source(b, ["id"], "b")], [0.6, 0.4], seed=42, out_cols=["text"])
    rows = out.orderBy("draw").collect()
    # everything before the first draw of the empty source, in order
    assert all(r["source"] == "a" for r in rows)
    assert [r["text"] for r in rows] == [f"a{i}" for i in range(len(rows))]
    assert len(rows) < 50


def test_interleave_independent_of_partitioning(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(400)], "id long, text string")
    b = spark.createDataFrame([(i // 3, i % 3, f"b{i}") for i in range(300)], "conv long, turn long, text string")

    def run():
        return sorted(
            interleave([Source(a, ["id"], "a"), Source(b, ["conv", "turn"], "b")], [0.6, 0.4], seed=7, out_cols=["text"]).collect()
        )

    base = run()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert run() == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("repeated", [False, True])
def test_interleave_null_and_repeated_order_values(spark, repeated):
    rows = [(None if i == 5 else i // (3 if repeated else 1), f"a{i}") for i in range(60)]
    a = spark.createDataFrame(rows, "id long, text string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(60)], "id long, text string")
    out = interleave([Source(a, ["id"], "a"), Source(b, ["id"], "b")], [0.5, 0.5], seed=3, out_cols=["text"]).orderBy("draw").collect()
    assert [r["draw"] for r in out] == list(range(len(out)))
    assert len({r["text"] for r in out}) == len(out)  # no row twice
    place = {t: (i is not None, i or 0) for i, t in rows}
    seq = [place[r["text"]] for r in out if r["source"] == "a"]
    assert seq == sorted(place.values())[: len(seq)]


def test_interleave_writes_keys_only(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(50)], "id long, text string")
    plan = interleave([Source(a, ["id"], "a")], [1.0], out_cols=["text"])._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "LogicalRDD" in line]
    assert scans and sum("text" in line for line in scans) == 1  # the source itself; no written copy of the text


def test_resume_after_skipped_steps(spark):
    steps = spark.createDataFrame([(i,) for i in range(10)], "step long")
    a = annotate_steps(steps, start=8, max_steps=100, every=4, skip_rows=4).orderBy("global_step").collect()
    assert [(r["step"], r["global_step"]) for r in a] == [(4 + k, 8 + k) for k in range(6)]


def test_pair_report_names_skipped_files(spark, tmp_path):
    import os

    from seqloom.sources.corpora import scan_pairs, scan_pairs_report, write_pairs

    path = str(tmp_path / "pairs")
    good = spark.createDataFrame([(i, [1, 2], [1, 2]) for i in range(40)], "seq_id long, context_ids array<int>, target_ids array<int>")
    write_pairs(good, path, file_rows=10)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) >= 4
    ragged = spark.createDataFrame([(90, [1], [1]), (91, [1, 2], [1, 2])], good.schema)
    ragged.coalesce(1).write.mode("append").parquet(path)
    with open(f"{path}/zzz.parquet", "wb") as f:
        f.write(b"not parquet")
    report = scan_pairs_report(spark, path).collect()
    assert sorted(r["skipped"] for r in report if r["skipped"]) == ["ragged", "unreadable"]
    assert {r["name"]: r["skipped"] for r in report}["zzz.parquet"] == "unreadable"
    assert scan_pairs(spark, path).count() == 40


def test_checkpoint_folder_is_required_off_local(monkeypatch):
    from seqloom import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def _pair_table(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.col("id").alias("seq_id"), F.array(F.col("id").cast("int"), F.lit(1)).alias("context_ids"),
        F.array(F.col("id").cast("int"), F.lit(2)).alias("target_ids"),
    )


@pytest.mark.parametrize("column", ["seq_id", "context_ids"])
def test_half_broken_file_goes_as_a_whole(spark, tmp_path, column):
    import pyarrow.parquet as pq

    from seqloom.sources.corpora import scan_pairs_report

    path = str(tmp_path / "pairs")
    write_pairs(_pair_table(spark, 20), path, files=2)
    half = _pair_table(spark, 400, 1000).toArrow()
    target = f"{path}/zz-half.parquet"
    pq.write_table(half, target, row_group_size=100, compression="snappy")
    chunk = next(
        c for c in (pq.ParquetFile(target).metadata.row_group(2).column(k) for k in range(3)) if c.path_in_schema.split(".")[0] == column
    )
    with open(target, "r+b") as fh:  # the third of four row groups; the footer stays
        fh.seek(chunk.dictionary_page_offset or chunk.data_page_offset)
        fh.write(b"\xff" * chunk.total_compressed_size)
    assert sorted(r["seq_id"] for r in scan_pairs(spark, path).collect()) == list(range(20))
    # also when only a column that is whole is read
    assert scan_pairs(spark, path).select("target_ids").count() == 20
    report = {r["name"]: r for r in scan_pairs_report(spark, path).collect()}["zz-half.parquet"]
    assert report["skipped"] == "broken" and report["rows"] < 400


def test_pair_shards_follow_from_the_keys(spark, tmp_path):
    from seqloom.sources.corpora import write_pair_shards

    path = str(tmp_path / "shards")
    write_pair_shards(_pair_table(spark, 95).repartition(7), path, file_rows=10)
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))
    assert len(files) == 10
    rows = scan_pairs(spark, path).collect()
    assert sorted(r["seq_id"] for r in rows) == list(range(95))
    assert all(r["seq_id"] // 10 == int(r["file"].split("shard=")[1][:12]) and r["seq_id"] % 10 == r["row"] for r in rows)


def test_batch_plan_over_written_files(spark, tmp_path):
    from seqloom.sources.corpora import canonical_path, write_pair_shards

    path = str(tmp_path / "shards")
    write_pair_shards(_pair_table(spark, 95), path, file_rows=10)
    shards = assign_shards(scan_artifacts(spark, path, "*.parquet").select(canonical_path("path").alias("path")), 3)
    rows = scan_pairs(spark, path).select(canonical_path("file").alias("file"), "row", "seq_id")
    plan = plan_batches(rows, shards, batch_size=4)
    got = {r["seq_id"]: (r["worker"], r["batch"], r["step"]) for r in plan.collect()}
    # brute force: 4, 4 and 2 files; batches of 4 inside each worker, workers in turn
    parts = [list(range(0, 40)), list(range(40, 80)), list(range(80, 95))]
    batches = [[p[k : k + 4] for k in range(0, len(p), 4)] for p in parts]
    want, step = {}, 0
    for b in range(max(map(len, batches))):
        for w, own in enumerate(batches):
            if b < len(own):
                want.update({s: (w, b, step) for s in own[b]})
                step += 1
    assert got == want


def test_batch_plan_rejects_gaps(spark):
    rows = spark.createDataFrame([("f00", 0), ("f00", 2)], "file string, row long")
    with pytest.raises(Exception, match="gaps"):
        plan_batches(rows, assign_shards(_files(spark, 1), 1), 4).collect()


def test_loader_plan_has_no_single_task_sort_of_rows(spark):
    rows = spark.createDataFrame([("f00", 0), ("f01", 0)], "file string, row long")
    plan = plan_batches(rows, assign_shards(_files(spark, 2), 2), 4)._jdf.queryExecution().optimizedPlan().toString()
    # windows remain over totals only (blocks of files, partitions), never over rows or files
    assert all("row_number" not in line for line in plan.splitlines())


def test_pair_shards_evaluate_the_input_once(spark, tmp_path):
    """No pass over the input for the bounds of ranges."""
    from seqloom.sources.corpora import write_pair_shards

    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    pairs = _pair_table(spark, 95)
    write_pair_shards(pairs.mapInArrow(counted, pairs.schema), str(tmp_path / "shards"), file_rows=10)
    assert rows.value == 95
