import pytest
from pyspark.sql import functions as F

from seqloom.operators.mixing import shuffle, standardize, take, truncate
from seqloom.operators.sequences import BOS_ID, MASK_ID, build_vocab, encode, mask_pairs, pack
from tests.conftest import SF001


def _docs(spark):
    return standardize(spark.read.parquet(f"{SF001}/documents.parquet"), keep=("doc_id",))


def test_standardize_by_schema(spark):
    a = spark.createDataFrame([(1, "x", "y")], "id int, content string, text string")
    b = spark.createDataFrame([(1, "y")], "id int, text string")
    c = spark.createDataFrame([(1, None)], "id int, content string")
    d = spark.createDataFrame([(1, 2)], "id int, other int")
    assert standardize(a, ("id",)).first()["text"] == "x"
    assert standardize(b, ("id",)).first()["text"] == "y"
    assert standardize(c, ("id",)).first()["text"] is None  # presence, not coalesce
    assert standardize(d, ("id",)).first()["text"] == ""
    assert standardize(a).columns == ["text"]


def test_shuffle_is_partition_independent(spark):
    docs = _docs(spark)
    a = shuffle(docs, "doc_id", seed=42).select("doc_id", "ordinal")
    b = shuffle(docs.repartition(3), "doc_id", seed=42, buckets=7).select("doc_id", "ordinal")
    assert a.exceptAll(b).count() == 0
    ords = sorted(r[0] for r in a.select("ordinal").collect())
    assert ords == list(range(docs.count()))


def test_take_fewer_when_short(spark):
    docs = shuffle(_docs(spark), "doc_id")
    assert take(docs, 10).count() == 10
    assert take(docs, 10**9).count() == docs.count()


def test_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],)], "a array<int>")
    assert [r[0] for r in truncate(df, ["a"], 2).collect()] == [[1, 2], [1]]


def _enc(spark, rows):
    df = spark.createDataFrame(rows, "ordinal long, ids array<int>")
    return df


def test_pack_edge_cases(spark):
    C = 4  # seq_len 3
    rows = [
        (0, []),  # empty doc
        (1, list(range(10, 10 + C))),  # exactly C
        (2, list(range(20, 20 + C - 1))),  # C-1
        (3, list(range(30, 30 + 5 * C + 1))),  # 5C+1
    ]
    seqs = pack(_enc(spark, rows), seq_len=C - 1, group_docs=10).orderBy("seq_id").collect()
    flat = [t for _, r in rows for t in r]
    n = len(flat) // C
    assert [r["input_ids"] for r in seqs] == [flat[i * C:(i + 1) * C] for i in range(n)]
    assert [r["seq_id"] for r in seqs] == list(range(n))


def test_pack_group_shorter_than_chunk(spark):
    rows = [(0, [1, 2]), (1, [3]), (2, [4, 5, 6, 7, 8])]
    seqs = pack(_enc(spark, rows), seq_len=3, group_docs=2).orderBy("seq_id").collect()
    # group 0 has 3 tokens < 4: nothing; group 1 gives one chunk, tail dropped
    assert [r["input_ids"] for r in seqs] == [[4, 5, 6, 7]]
    assert seqs[0]["seq_id"] == 0


def test_prepare_invariants(spark):
    docs = take(shuffle(_docs(spark), "doc_id"), 150)
    vocab = build_vocab(docs, size=500)
    enc = encode(docs, vocab, keys=["ordinal"])
    assert enc.where(F.element_at("ids", 1) != BOS_ID).count() == 0
    seqs = pack(enc, seq_len=63, group_docs=50)
    assert seqs.where(F.size("input_ids") != 64).count() == 0
    pairs = mask_pairs(seqs, p=0.15).cache()
    bad = pairs.where(
        ~F.exists(F.arrays_zip("context_ids", "target_ids"), lambda z: F.lit(True))
        | F.exists(
            F.arrays_zip("context_ids", "target_ids"),
            lambda z: (z["context_ids"] != z["target_ids"]) & (z["context_ids"] != MASK_ID),
        )
    )
    assert bad.count() == 0
    tot = pairs.select(F.sum(F.size("target_ids"))).first()[0]
    masked = pairs.select(F.sum(F.size(F.filter("context_ids", lambda x: x == MASK_ID)))).first()[0]
    rate = masked / tot
    sd = (0.15 * 0.85 / tot) ** 0.5
    assert abs(rate - 0.15) < 4 * sd


def test_natural_ordinal_hot_first_column(spark):
    from seqloom.functions.ordinal import natural_ordinal

    # one conversation holds most turns
    rows = [(0, t, "x") for t in range(3000)] + [(c, t, "y") for c in range(1, 50) for t in range(5)]
    df = spark.createDataFrame(rows, "conv long, turn long, s string")
    o = natural_ordinal(df, ["conv", "turn"]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in o] == list(range(len(rows)))
    assert [(r["conv"], r["turn"]) for r in o] == sorted((c, t) for c, t, _ in rows)


def test_arrow_and_relational_encode_agree(spark):
    from seqloom.operators.sequences import encode_relational

    docs = take(shuffle(_docs(spark), "doc_id"), 80)
    extra = spark.createDataFrame([(10**6, "", 10**6), (10**6 + 1, "  a  b ", 10**6 + 1)], "doc_id long, text string, ordinal long")
    docs = docs.unionByName(extra)
    vocab = build_vocab(docs, size=300)
    a = encode(docs, vocab, keys=["ordinal"]).select("ordinal", F.col("ids").cast("array<int>").alias("ids"))
    b = encode_relational(docs, vocab, keys=["ordinal"]).select("ordinal", F.col("ids").cast("array<int>").alias("ids"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    got = {r["ordinal"]: r["ids"] for r in a.where(F.col("ordinal") >= 10**6).collect()}
    assert got[10**6] == [BOS_ID]


def test_lookup_unknown_id_raises(spark):
    import pytest

    from seqloom.operators.sequences import lookup

    table = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "token_id int, vec array<double>")
    ok = spark.createDataFrame([(1, [1, 0, 1])], "k long, ids array<int>")
    got = lookup(ok, table, "ids", "k").first()["vectors"]
    assert got == [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]
    bad = spark.createDataFrame([(1, [1, 7])], "k long, ids array<int>")
    with pytest.raises(ValueError):
        lookup(bad, table, "ids", "k")


def test_pack_report_accounting(spark):
    from seqloom.operators.sequences import pack_groups, pack_report

    enc = spark.createDataFrame([(0, [11, 12, 13, 14, 15]), (1, [16, 17]), (2, [18])], "ordinal long, ids array<int>")
    seqs = pack(enc, seq_len=2, group_docs=2)
    pairs = mask_pairs(seqs, p=0.0)
    r = pack_report(pack_groups(enc, 2, group_docs=2), pairs, 2).first()
    # group 0: 7 tokens -> 2 chunks of 3, 1 dropped; group 1: 1 token -> dropped group
    assert (r["sequences"], r["total_tokens"], r["tokens_in"], r["tokens_dropped"], r["groups"], r["groups_dropped"]) == (2, 6, 8, 2, 2, 1)
    assert r["mask_rate"] == 0.0


def test_fused_prepare_equals_operator_chain(spark):
    from seqloom.catalog.prepare import pair_digest, pairs, pairs_chain

    for g in (100, 1000):
        a = sorted(pair_digest(pairs(spark, "/root/testdata/sf0.001", seq_len=127, group_docs=g)).collect())
        b = sorted(pair_digest(pairs_chain(spark, "/root/testdata/sf0.001", seq_len=127, group_docs=g)).collect())
        assert a == b and len(a) > 0


def test_take_unordered_equals_take_of_shuffle(spark):
    from seqloom.operators.mixing import take_unordered

    docs = _docs(spark)
    total = docs.count()
    for n, buckets in [(1, 7), (37, 7), (100, 16), (total - 1, 3), (total, 7), (total + 5, 7)]:
        a = take_unordered(docs, "doc_id", n, seed=42, buckets=buckets).select("doc_id")
        b = take(shuffle(docs, "doc_id", seed=42), n).select("doc_id")
        assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect()), (n, buckets)


def test_fused_prepare_with_take_smaller_than_table(spark):
    from seqloom.catalog.prepare import pair_digest
    from seqloom.operators.prepare import prepare_pairs

    docs = _docs(spark)
    n = 120  # fewer than the 200 documents of the fixture
    a = sorted(pair_digest(prepare_pairs(docs, "doc_id", n=n, seq_len=63, group_docs=25, vocab_size=400)).collect())
    sel = take(shuffle(docs, "doc_id", seed=42), n)
    vocab = build_vocab(sel.select("doc_id", "text"), size=400)
    enc = encode(sel, vocab, keys=["ordinal"])
    b = sorted(pair_digest(mask_pairs(pack(enc, seq_len=63, group_docs=25), p=0.15, seed=42)).collect())
    assert a == b and len(a) > 0


def test_relational_encode_above_the_broadcast_limit(spark):
    from seqloom.operators.sequences import build_vocab, encode

    docs = spark.createDataFrame([(1, "a b a c"), (1, "a b a c"), (2, ""), (3, "zz a")], "k int, text string")
    vocab = build_vocab(docs.where("k < 3"), size=7)
    a = encode(docs, vocab, keys=["k"]).collect()
    b = encode(docs, vocab, keys=["k"], max_broadcast=1).collect()
    assert sorted((r["k"], list(r["ids"])) for r in a) == sorted((r["k"], list(r["ids"])) for r in b) and len(b) == 4


def test_take_unordered_edges(spark, monkeypatch):
    from seqloom.operators import mixing

    df = spark.range(500).withColumnRenamed("id", "k")
    want = [r["k"] for r in mixing.shuffle(df, "k", seed=3).orderBy("ordinal").collect()]
    monkeypatch.setattr(mixing, "CROSSING_ROWS", 2)
    for n in (0, 1, 77, 499, 500, 900):
        got = sorted(r["k"] for r in mixing.take_unordered(df, "k", n, seed=3, buckets=4).collect())
        assert got == sorted(want[:n])


def _vectors(spark, n):
    return spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "token_id int, vec array<double>")


def test_lookup_of_a_one_word_corpus_stays_even(spark):
    """A token that is all of the corpus takes its vector from a broadcast; no task regroups more than its share."""
    from seqloom.functions.skew import heavy_keys
    from seqloom.operators.sequences import lookup

    rows = [(k, [7] * 50) for k in range(400)] + [(1000, [7, 1, 2, None and 0 or 3]), (1001, [])]
    df = spark.createDataFrame(rows, "k long, ids array<int>").repartition(6)
    out = lookup(df, _vectors(spark, 10), "ids", "k")
    got = {r["k"]: [v[0] for v in r["vectors"]] for r in out.collect()}
    assert got[3] == [7.0] * 50 and got[1000] == [7.0, 1.0, 2.0, 3.0] and len(got) == 401
    counts = spark.createDataFrame([(7, 20001), (1, 1), (2, 1), (None, 9)], "id int, n long")
    assert heavy_keys(counts, "id") == [7] and heavy_keys(counts.limit(0), "id") == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        again = lookup(df, _vectors(spark, 10), "ids", "k")
        sizes = sorted(again.groupBy(F.spark_partition_id()).agg(F.sum(F.size("vectors")).alias("n")).toPandas()["n"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_lookup_heavy_and_rare_ids_agree_with_plain_lookup(spark):
    import numpy as np

    from seqloom.operators.sequences import lookup

    rng = np.random.default_rng(3)
    rows = [(k, np.minimum(rng.zipf(1.3, int(rng.integers(0, 30))), 199).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    for heavy in (1, 20, 100_000):
        got = {r["k"]: [v[0] for v in r["vectors"]] for r in lookup(df, _vectors(spark, 200), "ids", "k", heavy=heavy).collect()}
        assert got == {k: [float(i) for i in ids] for k, ids in rows if ids}
    with pytest.raises(ValueError, match="no vector"):
        lookup(df, _vectors(spark, 100), "ids", "k")


def test_vocabulary_over_a_million_words_of_equal_count(spark):
    # 1.2 million words occur once, a few more often: the cut falls into the huge class
    n = 1_200_000
    texts = spark.range(n).select(F.concat(F.lit("w"), F.lpad("id", 8, "0")).alias("text"))
    often = spark.createDataFrame([("zz yy",), ("zz yy zz",)], "text string")
    vocab = build_vocab(texts.unionByName(often), size=1_000_005)
    plan = vocab._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" not in plan
    got = vocab.where("token_id >= 5")
    assert got.agg(F.count("*"), F.min("token_id"), F.max("token_id"), F.countDistinct("token_id")).first() == (
        1_000_000, 5, 1_000_004, 1_000_000
    )
    first = {r["token"]: (r["token_id"], r["count"]) for r in got.where("token_id < 8").collect()}
    assert first == {"zz": (5, 3), "yy": (6, 2), "w00000000": (7, 1)}
    # the rest in order of the words: id = 7 + number of the word
    assert got.where("token_id >= 7 AND token_id - 7 <> cast(substr(token, 2) AS int)").isEmpty()


def test_masks_of_both_forms_are_equal(spark):
    from seqloom.operators.sequences import mask_pairs_sql

    df = spark.range(50).select((F.col("id") * 10_000_000_019).alias("seq_id"), F.sequence(F.lit(5), F.lit(300)).alias("input_ids"))
    a, b = mask_pairs(df, p=0.2, seed=9), mask_pairs_sql(df, p=0.2, seed=9)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_list_offsets_beyond_32_bits_raise():
    import numpy as np

    from seqloom.functions.arrow_kernels import list_offsets

    assert list_offsets(np.array([2, 0, 3])).tolist() == [0, 2, 2, 5] and list_offsets(np.zeros(0, np.int64)).tolist() == [0]
    with pytest.raises(OverflowError):
        list_offsets(np.array([2**31 - 1, 1]))


def test_kernels_work_on_slices_of_a_batch(monkeypatch):
    """However many rows a batch has, a kernel sees a bounded part of it; the rows are those of the whole batch."""
    import numpy as np
    import pyarrow as pa

    from seqloom.functions import arrow_kernels as ak

    seen = []
    for name, column in (("encode_batch", "text"), ("mask_batch", "ids")):
        def spy(batch, *a, whole=getattr(ak, name), column=column):
            seen.append(int(np.sum(ak.row_lengths(batch.column(column)))) if batch.num_rows > 1 else 0)
            return whole(batch, *a)

        monkeypatch.setattr(ak, name, spy)
    texts = ["a b  a", None, "", "c " * 3000, *["b c x"] * 4000]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    args = (["k"], "text", "ids", pa.array(["a", "b", "c"]), 5, 3, 1)
    whole = ak.encode_batch(batch, *args)
    parts = list(ak.encode_batches(iter([batch, batch.slice(0, 0)]), *args, limit=1000))
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == whole.to_pylist() and len(parts) > 20
    masked = ak.mask_batch(whole, "k", "ids", 0.3, 4, 9)
    seen.clear()
    parts = list(ak.mask_batches(iter([whole]), "k", "ids", 0.3, 4, 9, limit=1000))
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == masked.to_pylist()
    assert len(seen) > 10 and max(seen) <= 1000


def test_encode_and_mask_hand_on_small_batches(spark, monkeypatch):
    """encode and mask_pairs cut Spark's batches: with a row limit of one batch for all, tasks hand on several."""
    from seqloom.functions import arrow_kernels as ak
    from seqloom.operators.sequences import mask_pairs

    calls = spark.sparkContext.accumulator(0)
    for name in ("encode_batches", "mask_batches"):
        def counted(it, *a, whole=getattr(ak, name), **b):
            for x in whole(it, *a, limit=2000, **b):
                calls.add(1)
                yield x

        monkeypatch.setattr(ak, name, counted)
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("ordinal"), F.repeat(F.lit("a b "), 50).alias("text"))
    enc = encode(docs, build_vocab(docs, size=10), keys=["ordinal"])
    assert enc.where(F.size("ids") == 101).count() == 300 and calls.value >= 30
    calls.value = 0
    out = mask_pairs(enc.select(F.col("ordinal").alias("seq_id"), F.col("ids").alias("input_ids")), p=0.2)
    assert out.where(F.size("target_ids") == 101).count() == 300 and calls.value >= 45


def test_lookup_sends_a_vector_once_to_a_block(spark):
    """The exchange carries ids and the distinct ids' vectors, not a vector per token; small blocks give the same rows."""
    import numpy as np

    from seqloom.operators.sequences import lookup

    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(0, 40, 3000).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, ids array<int>").repartition(4)
    out = lookup(df, _vectors(spark, 40), "ids", "k")
    plan = out._jdf.queryExecution().executedPlan()
    assert "posexplode" not in plan.toString()
    few = lookup(df, _vectors(spark, 40), "ids", "k", held_bytes=16 * 30)
    for one in (out, few):
        assert {r["k"]: [v[0] for v in r["vectors"]] for r in one.collect()} == {k: [float(i) for i in ids] for k, ids in rows}
    assert few.rdd.getNumPartitions() > out.rdd.getNumPartitions()


def test_lookup_of_repeated_keys_and_ids(spark):
    """Rows with one key come together by position, then by vector; so do the vectors of an id that has several."""
    from seqloom.operators.sequences import lookup

    rows = [(1, [0, 1, 1]), (1, [2]), (None, [1]), (None, [0, 2]), (2, [2, 0]), (3, None), (4, []), (1, [0])]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    one = spark.createDataFrame([(0, [5.0]), (1, None), (2, [3.0]), (9, [1.0]), (None, [0.0])], "token_id long, vec array<double>")
    got = {r["k"]: r["vectors"] for r in lookup(df, one, "ids", "k").collect()}
    assert got == {1: [[3.0], [5.0], [5.0], None, None], None: [None, [5.0], [3.0]], 2: [[3.0], [5.0]]}
    two = one.unionByName(spark.createDataFrame([(0, [4.0]), (0, [6.0])], "token_id long, vec array<double>"))
    got = {r["k"]: r["vectors"] for r in lookup(df, two, "ids", "k").collect()}
    zero = [[4.0], [5.0], [6.0]]
    assert got[1] == [[3.0], [4.0], [4.0], [5.0], [5.0], [6.0], [6.0], None, None]
    assert got[None] == [None, *zero, [3.0]] and got[2] == [[3.0], *zero]


def test_lookup_moves_few_vectors_of_a_large_table(spark):
    """Rare ids, each in many documents: blocks are not multiplied until each needs few vectors; the vectors of a task are mapped."""
    import numpy as np

    from seqloom.operators.sequences import lookup

    rng = np.random.default_rng(8)
    rows = [(k, rng.integers(0, 2000, 40).tolist()) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, ids array<int>").repartition(4)
    table = spark.createDataFrame([(i, [i + 0.5, -1.0, 2.0]) for i in range(2000)], "token_id int, vec array<float>")
    out = lookup(df, table, "ids", "k", held_bytes=12 * 100, element="double")
    assert dict(out.dtypes)["vectors"] == "array<array<double>>"
    assert out.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert {r["k"]: [v for v in r["vectors"]] for r in out.collect()} == {k: [[i + 0.5, -1.0, 2.0] for i in ids] for k, ids in rows}


def test_vectors_of_a_block_in_a_file():
    """Filed and kept vectors of a block together, also ragged ones, nulls and ids with several."""
    import pyarrow as pa

    from seqloom.operators.sequences import _place_vectors

    def batch(kind, id=None, vec=None, key=None, ids=None):
        n = len(id or key)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([0] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "id": pa.array(id or [None] * n, pa.int32()),
            "vec": pa.array(vec or [None] * n, pa.list_(pa.float32())), "key": pa.array(key or [None] * n, pa.int64()),
            "ids": pa.array(ids or [None] * n, pa.list_(pa.int32())), "pos": pa.array([None] * n, pa.list_(pa.int32())),
        })

    plain = [batch(0, [4, 5], [[1.0, 2.0], [3.0]]), batch(0, [6, 7], [[], [4.0, 5.0]])]
    rows = batch(1, key=[1, 2], ids=[[7, 4, 4], [6, 5]])
    for limit in (0, 20, 1 << 20):
        got = pa.Table.from_batches(_place_vectors(iter([*plain, rows]), limit, pa.list_(pa.float64())))
        assert got.schema.field("vectors").type.value_type.value_type == pa.float64()
        assert got.column("vectors").to_pylist() == [[[4.0, 5.0], [1.0, 2.0], [1.0, 2.0]], [[], [3.0]]]
        odd = [*plain, batch(0, [8, 9], [None, [None, 1.0]]), batch(0, [4], [[9.0]]), batch(1, key=[1, 2], ids=[[8, 4], [9, 7]])]
        got = pa.Table.from_batches(_place_vectors(iter(odd), limit))
        (a, b, c), d = got.column("vectors").to_pylist()
        assert a is None and sorted([b, c]) == [[1.0, 2.0], [9.0]] and d == [[None, 1.0], [4.0, 5.0]]
