import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators.scans import decay_scan, final_state, momentum_scan, surprise


def _golden(spark):
    return spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0)], "key int, t int, x double")


def test_golden_final_state(spark):
    s = decay_scan(_golden(spark), "key", ["t"], "x", decay=0.5, emit_previous="prev")
    fs = final_state(s, "key").collect()
    assert abs(fs[0]["h"] - 0.0625) < 1e-4
    visible = [r["prev"] for r in s.orderBy("t").collect()]
    assert visible == pytest.approx([0.0, 0.5, 0.25, 0.125], abs=1e-12)


def _loop(xs, d, g):
    h, out, prev = 0.0, [], []
    for x in xs:
        prev.append(h)
        h = d * h + g * x
        out.append(h)
    return np.array(out), np.array(prev)


@pytest.mark.parametrize("decay", [0.9, 0.999, 0.5, 1e-3])
def test_long_key_matches_loop(spark, decay):
    rng = np.random.default_rng(42)
    xs = rng.normal(size=20000)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs)], "key int, t int, x double")
    s = decay_scan(df, "key", ["t"], "x", decay=decay, emit_previous="prev")
    got = s.orderBy("t").select("h", "prev").toPandas()
    h, prev = _loop(xs, decay, 1 - decay)
    assert np.max(np.abs(got["h"].to_numpy() - h)) < 1e-9
    assert np.max(np.abs(got["prev"].to_numpy() - prev)) < 1e-9


@pytest.mark.parametrize("parts", [1, 7])
def test_index_is_the_row_number(spark, parts):
    df = spark.createDataFrame([(k % 3, i, float(i % 7)) for i, k in enumerate(range(3000))], "key int, t int, x double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r["key"], r["t"]): r["k"] for r in decay_scan(df, "key", ["t"], "x", decay=0.9).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {(i % 3, i): i // 3 for i in range(3000)}


def test_edge_decays(spark):
    df = _golden(spark)
    zero = decay_scan(df, "key", ["t"], "x", decay=0.0).orderBy("t").collect()
    assert [r["h"] for r in zero] == [1.0, 0.0, 0.0, 0.0]
    one = decay_scan(df, "key", ["t"], "x", decay=1.0, emit_previous="p").collect()
    assert all(r["h"] == 0.0 and r["p"] == 0.0 for r in one)


def test_momentum_lookahead(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1.0, 2.0, -1.0])], "key int, t int, g double")
    r = momentum_scan(df, "key", ["t"], "g", momentum=0.5).orderBy("t").collect()
    assert [x["buf"] for x in r] == pytest.approx([1.0, 2.5, 0.25])
    assert [x["update"] for x in r] == pytest.approx([1.5, 3.25, -0.875])


def test_surprise_is_global_mean(spark):
    s = decay_scan(_golden(spark), "key", ["t"], "x", decay=0.5, emit_previous="prev")
    v = surprise(s, "prev", "x").first()["surprise"]
    assert v == pytest.approx(((0 - 1) ** 2 + 0.5**2 + 0.25**2 + 0.125**2) / 4)


def test_hot_key(spark):
    # one key holds most rows; the range partitioning spreads it over tasks
    rows = [(0, i, float(i % 5)) for i in range(5000)] + [(k, i, 1.0) for k in range(1, 4) for i in range(50)]
    df = spark.createDataFrame(rows, "key int, t long, x double")
    s = decay_scan(df, "key", ["t"], "x", decay=0.9)
    h = [r["h"] for r in s.where("key = 0").orderBy("t").collect()]
    ref, cur = [], 0.0
    for i in range(5000):
        cur = 0.9 * cur + 0.1 * float(i % 5)
        ref.append(cur)
    assert max(abs(x - y) for x, y in zip(h, ref)) < 1e-9


def test_string_order(spark):
    df = spark.createDataFrame([(1, f"t{i:03d}", 1.0) for i in range(5)], "key int, t string, x double")
    s = decay_scan(df, "key", ["t"], "x", decay=0.5)
    assert s.count() == 5


def test_null_key_and_null_order_are_kept(spark):
    rows = [(None, 0, 1.0), (None, 1, 0.0), (1, None, 2.0), (1, 1, 0.0)]
    df = spark.createDataFrame(rows, "key int, t long, x double")
    s = decay_scan(df, "key", ["t"], "x", decay=0.5)
    assert s.count() == 4
    h = {(r["key"], r["t"]): r["h"] for r in s.collect()}
    assert h[(None, 1)] == pytest.approx(0.25) and h[(1, 1)] == pytest.approx(0.5)


def test_readout_equals_numpy(spark):
    import numpy as np

    from seqloom.operators.scans import mlp_readout

    rng = np.random.default_rng(3)
    w1 = rng.normal(size=(8, 4)).tolist()
    w2 = rng.normal(size=(4, 8)).tolist()
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(20)], "id int, h array<double>")
    a = df.select("id", mlp_readout(F.col("h"), w1, w2).alias("r")).orderBy("id").collect()
    H = np.array([r["h"] for r in df.orderBy("id").collect()])
    Z = H @ np.array(w1).T
    want = (Z / (1 + np.exp(-Z))) @ np.array(w2).T
    assert np.allclose(np.array([x["r"] for x in a]), want, atol=1e-12)


def test_momentum_long_key_matches_loop(spark):
    rng = np.random.default_rng(11)
    g = rng.normal(size=5000)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(g)], "key int, t int, g double")
    got = momentum_scan(df, "key", ["t"], "g", momentum=0.95).orderBy("t").toPandas()
    buf, bufs = 0.0, []
    for v in g:
        buf = 0.95 * buf + v
        bufs.append(buf)
    bufs = np.array(bufs)
    assert np.max(np.abs(got["buf"].to_numpy() - bufs)) < 1e-9
    assert np.max(np.abs(got["update"].to_numpy() - (g + 0.95 * bufs))) < 1e-9


def test_values_of_very_different_size_match_the_loop(spark):
    # terms of 1e60 still matter two thousand steps later
    xs = [1e60] * 1024 + [0.0] * 1500 + [1.0] * 10
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "key int, t int, x double")
    got = decay_scan(df, "key", ["t"], "x", decay=0.9, emit_previous="p").orderBy("t").toPandas()
    h, prev = _loop(xs, 0.9, 1 - 0.9)
    assert np.allclose(got["h"], h, rtol=1e-9) and np.allclose(got["p"], prev, rtol=1e-9)


@pytest.mark.parametrize("decay", [0.0, 0.5, 1.0])
def test_vector_state_matches_the_loop(spark, decay):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i % 2, i, [float(v) for v in r]) for i, r in enumerate(x)], "key int, t int, x array<double>")
    s = decay_scan(df, "key", ["t"], "x", decay=decay, emit_previous="p")
    assert s.columns == ["key", "t", "x", "k", "h", "p"]
    for key in (0, 1):
        got = s.where(F.col("key") == key).orderBy("t").toPandas()
        want = [np.zeros(4)]
        for v in x[key::2]:
            want.append(decay * want[-1] + (1 - decay) * v)
        assert np.allclose(np.stack(got["h"]), np.stack(want[1:]))
        assert np.allclose(np.stack(got["p"]), np.stack(want[:-1]))
    fin = {r["key"]: (r["h"], r["rows"]) for r in final_state(s, "key").collect()}
    assert fin[0][1] == 150
    m = momentum_scan(df, "key", ["t"], "x", momentum=1.0).where("key = 0").orderBy("t").toPandas()
    assert np.allclose(np.stack(m["buf"]), np.cumsum(x[0::2], axis=0))
    assert surprise(s, "p", "x").first()["rows"] == 300


def test_scan_inside_a_larger_stage(spark):
    df = spark.createDataFrame([(0, i, 1.0) for i in range(500)], "key int, t int, x double")
    s = decay_scan(df, "key", ["t"], "x", decay=0.9)
    both = df.withColumn("k", F.lit(-1).cast("long")).withColumn("h", F.lit(0.0)).unionByName(s)
    assert both.where("k >= 0").select("k").distinct().count() == 500
    assert s.where("k = 499").first()["h"] == pytest.approx(1 - 0.9**500)


@pytest.mark.parametrize("parts", [1, 5])
def test_nan_and_signed_zero_keys(spark, parts):
    """NaN is one key, and so is zero with either sign, alone, nested and across partitions."""
    nan = float("nan")
    rows = [(k, i, 1.0 if i == 0 else 0.0) for k in (nan, 0.0, 2.0) for i in range(60)]
    rows = [(-0.0 if k == 0.0 and i % 2 else k, i, x) for k, i, x in rows]
    df = spark.createDataFrame(rows, "key double, t int, x double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for frame in (df, df.withColumn("key", F.struct(F.col("key").alias("a"), F.lit(1).alias("b")))):
            got = decay_scan(frame, "key", ["t"], "x", decay=0.5).collect()
            assert len(got) == 180 and all(r["k"] == r["t"] for r in got)
            assert all(r["h"] == 0.5 ** (r["t"] + 1) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("decay", [0.0, 0.3, 0.97, 1.0])
def test_random_runs_match_loop(spark, decay):
    """Runs of every length, null, infinite and NaN values, scalars and vectors, across batches and partitions."""
    rng = np.random.default_rng(8)
    odd = {5: None, 40: float("inf"), 70: float("nan"), 75: None, 90: -float("inf")}
    rows, want, wantv = [], {}, {}
    for key in range(120):
        h, hv = 0.0, np.zeros(2)
        n = int(rng.choice([1, 2, 7, 60, 700]))
        for t in range(n):
            x = float(rng.normal())
            if key in odd and t == n // 2:
                x = odd[key]
            v = None if x is None else [x, float(t)]
            rows.append((key, t, x, v))
            h = None if h is None or x is None else decay * h + (1 - decay) * x
            with np.errstate(invalid="ignore"):
                hv = None if hv is None or x is None else decay * hv + (1 - decay) * np.array(v)
            want[key, t], wantv[key, t] = h, None if hv is None else hv.tolist()
    df = spark.createDataFrame(rows, "key int, t int, x double, v array<double>").repartition(6)
    for r in decay_scan(df, "key", ["t"], "x", decay=decay).collect():
        w = want[r["key"], r["t"]]
        assert (r["h"] is None) == (w is None) and (w is None or r["h"] == pytest.approx(w, rel=1e-9, abs=1e-12, nan_ok=True))
    for r in decay_scan(df, "key", ["t"], "v", decay=decay, emit_previous="p").collect():
        w = wantv[r["key"], r["t"]]
        assert (r["h"] is None) == (w is None) and (w is None or r["h"] == pytest.approx(w, rel=1e-9, abs=1e-12, nan_ok=True))
