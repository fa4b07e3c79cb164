import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators.matrix import (
    balance, clip, fan_out, global_norm, lane_mean, layer_norm, mix, orthogonalize, potentials, residuals,
)


def _np_sinkhorn(w, iters=5):
    w = w.copy()
    for _ in range(iters):
        m = w.max(axis=1, keepdims=True)
        w = w - (m + np.log(np.exp(w - m).sum(axis=1, keepdims=True)))
        m = w.max(axis=0, keepdims=True)
        w = w - (m + np.log(np.exp(w - m).sum(axis=0, keepdims=True)))
    return np.exp(w)


def _cells(spark, w):
    n = w.shape[0]
    return spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n)], "i int, j int, w double")


def test_balance_matches_numpy_4x4(spark):
    w = np.random.default_rng(42).normal(size=(4, 4))
    got = balance(_cells(spark, w)).toPandas()
    p = np.zeros((4, 4))
    for r in got.itertuples():
        p[r.i, r.j] = r.p
    assert np.allclose(p, _np_sinkhorn(w), atol=1e-4)
    assert np.allclose(p.sum(axis=0), 1.0, atol=1e-12)


def test_balance_permutation_equivariant(spark):
    w = np.random.default_rng(7).normal(size=(5, 5))
    perm = np.array([3, 0, 4, 1, 2])
    a = balance(_cells(spark, w)).toPandas().set_index(["i", "j"])["p"]
    b = balance(_cells(spark, w[np.ix_(perm, perm)])).toPandas().set_index(["i", "j"])["p"]
    for i in range(5):
        for j in range(5):
            assert a[(perm[i], perm[j])] == pytest.approx(b[(i, j)], abs=1e-12)


def test_balance_missing_cells_reports_residual(spark):
    rows = [(0, 0, 0.0), (0, 1, 1.0), (1, 1, 0.5), (1, 2, 0.2), (2, 0, 0.3), (2, 2, 0.1)]
    df = spark.createDataFrame(rows, "i int, j int, w double")
    p = balance(df, iters=50)
    r = residuals(p).first()
    assert r["col_residual"] < 1e-9
    assert r["row_residual"] < 1e-3


def test_balance_rejects_non_square(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 2, 1.0)], "i int, j int, w double")
    with pytest.raises(ValueError):
        balance(df)


def test_balance_uses_no_window(spark):
    w = np.random.default_rng(3).normal(size=(3, 3))
    plan = balance(_cells(spark, w), iters=2)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_balance_stops_at_the_residual(spark):
    w = np.random.default_rng(8).normal(size=(6, 6)) * 3
    cells = _cells(spark, w)
    u, v, rounds, residual = potentials(cells, iters=200, tol=1e-3)
    assert rounds < 200 and residual <= 1e-3
    want = [np.abs(_np_sinkhorn(w, t).sum(axis=1) - 1).max() for t in range(1, rounds + 1)]
    assert residual == pytest.approx(want[-1], abs=1e-9)
    assert all(r > 1e-3 for r in want[:-1])
    _, _, rounds, residual = potentials(cells, iters=2, tol=1e-12)
    assert rounds == 2 and residual == pytest.approx(want[1], abs=1e-9)


def test_balance_wide_range_of_weights(spark):
    # weights far beyond the range of exp: only relative sums are ever formed
    w = np.random.default_rng(4).normal(size=(5, 5)) * 900
    got = balance(_cells(spark, w), iters=7).toPandas().set_index(["i", "j"])["p"]
    want = _np_sinkhorn(w, 7)
    assert all(got[(i, j)] == pytest.approx(want[i, j], abs=1e-9) for i in range(5) for j in range(5))


def test_balance_heavy_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    from seqloom.operators import matrix

    w = np.full((30, 30), -np.inf)
    rng = np.random.default_rng(6)
    w[0, :] = rng.normal(size=30)  # a dense row and column hold most cells
    w[:, 0] = rng.normal(size=30)
    w[np.arange(30), np.arange(30)] = rng.normal(size=30)
    monkeypatch.setattr(matrix, "BROADCAST_LABELS", 2)
    monkeypatch.setattr(matrix, "heavy_keys", lambda counts, key: [0])
    got = balance(_cells(spark, w), iters=3).toPandas().set_index(["i", "j"])["p"]
    want = _np_sinkhorn(w, 3)
    assert len(got) == 900
    assert all(got[(i, j)] == pytest.approx(want[i, j], abs=1e-12) for i in range(30) for j in range(30))


@pytest.mark.parametrize("bad", [(0, 0, float("nan")), (0, 0, float("inf")), (None, 0, 1.0)])
def test_balance_rejects_bad_cells(spark, bad):
    with pytest.raises(ValueError):
        balance(spark.createDataFrame([bad, (0, 0, 1.0)], "i int, j int, w double"))


def test_balance_null_weight_is_zero(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, None), (1, 0, 0.0), (1, 1, 0.0)], "i int, j int, w double")
    p = {(r["i"], r["j"]): r["p"] for r in balance(df).collect()}
    assert p[(0, 1)] == 0.0 and p[(0, 0)] + p[(1, 0)] == pytest.approx(1.0)


def test_mix_matches_einsum(spark):
    rng = np.random.default_rng(42)
    B, S, N, D = 2, 8, 4, 16
    x = rng.normal(size=(B, S, N, D))
    P = _np_sinkhorn(rng.normal(size=(N, N)))
    rows = [(b, s, n, [float(v) for v in x[b, s, n]]) for b in range(B) for s in range(S) for n in range(N)]
    xdf = spark.createDataFrame(rows, "b int, s int, lane int, x array<double>")
    pdf = spark.createDataFrame([(o, i, float(P[o, i])) for o in range(N) for i in range(N)], "o int, i int, p double")
    got = mix(xdf, pdf, keys=["b", "s"]).collect()
    want = np.einsum("oi,bsid->bsod", P, x)
    for r in got:
        assert np.allclose(r["y"], want[r["b"], r["s"], r["lane"]], atol=1e-3)


def _vecs(spark, n=300, d=16, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, d))
    return spark.createDataFrame([(i, [float(v) for v in m[i]]) for i in range(n)], "id long, v array<double>"), m


def test_orthogonalize_equals_direct_iteration(spark):
    df, G = _vecs(spark)
    got = orthogonalize(df, "v", out="o").orderBy("id").toPandas()
    X = G / (np.linalg.norm(G) + 1e-7)
    X = X.T
    a, b, c = 3.4445, -4.7750, 2.0315
    for _ in range(5):
        A = X @ X.T
        X = a * X + (b * A + c * A @ A) @ X
    want = X.T
    assert np.allclose(np.stack(got["o"].to_numpy()), want, atol=1e-9)


def test_orthogonalize_needs_tall(spark):
    df, _ = _vecs(spark, n=8, d=16)
    with pytest.raises(ValueError):
        orthogonalize(df, "v")


def test_global_norm_and_clip(spark):
    df, m = _vecs(spark, n=50, d=4)
    n = global_norm(df, "v").first()["norm"]
    assert n == pytest.approx(np.linalg.norm(m))
    c = clip(df, "v", max_norm=1.0)
    assert global_norm(c, "v").first()["norm"] == pytest.approx(n / (n + 1e-6))


def test_layer_norm(spark):
    df, m = _vecs(spark, n=10, d=8)
    got = np.stack(layer_norm(df, "v", out="y").orderBy("id").toPandas()["y"].to_numpy())
    want = (m - m.mean(axis=1, keepdims=True)) / np.sqrt(m.var(axis=1, keepdims=True) + 1e-5)
    assert np.allclose(got, want)


def test_fan_out_lane_mean(spark):
    df, m = _vecs(spark, n=20, d=8)
    f = fan_out(df, "id", "v", n=4, sigma=0.02, seed=42)
    assert f.count() == 80
    lm = np.stack(lane_mean(f, ["id"], "v").orderBy("id").toPandas()["v"].to_numpy())
    assert np.abs(lm - m).max() < 0.1  # noise 0.02 averaged over 4 lanes
    again = fan_out(df.repartition(3), "id", "v", n=4, sigma=0.02, seed=42)
    assert f.exceptAll(again).count() == 0  # reproducible


def test_balance_through_checkpoint_matches_numpy(spark):
    w = np.random.default_rng(5).normal(size=(4, 4))
    got = balance(_cells(spark, w), iters=12, checkpoint_every=10).toPandas()
    p = np.zeros((4, 4))
    for r in got.itertuples():
        p[r.i, r.j] = r.p
    assert np.allclose(p, _np_sinkhorn(w, iters=12), atol=1e-12)


def test_orthogonalize_independent_of_partitioning(spark):
    df, _ = _vecs(spark, n=200, d=8, seed=9)
    a = np.stack(orthogonalize(df.coalesce(1), "v", out="o").orderBy("id").toPandas()["o"].to_numpy())
    b = np.stack(orthogonalize(df.repartition(7), "v", out="o").orderBy("id").toPandas()["o"].to_numpy())
    assert np.allclose(a, b, atol=1e-12)


def test_mix_raises_on_an_absent_lane(spark):
    from seqloom.operators.matrix import mix

    x = spark.createDataFrame([(1, 0, 1.0), (2, 7, 1.0)], "key int, lane long, x double")
    p = spark.createDataFrame([(0, 0, 1.0)], "o long, i long, p double")
    with pytest.raises(Exception, match="absent from the mixing matrix"):
        mix(x, p, ["key"]).collect()


def test_layer_norm_and_cross_entropy_of_long_vectors(spark):
    import time

    from seqloom.operators.matrix import layer_norm
    from seqloom.operators.metrics import cross_entropy

    rng = np.random.default_rng(0)
    took = {}
    for n in (1000, 16000):
        m = rng.normal(size=(4, n)) * 50
        df = spark.createDataFrame([(i, [float(v) for v in r], i) for i, r in enumerate(m)], "id int, v array<double>, label int").cache()
        df.count()
        start = time.time()
        y = np.stack([r["y"] for r in layer_norm(df, "v", out="y").orderBy("id").select("y").collect()])
        loss = cross_entropy(df, "v", "label").first()["loss"]
        took[n] = time.time() - start
        assert np.allclose(y, (m - m.mean(1, keepdims=True)) / np.sqrt(m.var(1, keepdims=True) + 1e-5))
        top = m.max(1)
        assert loss == pytest.approx(np.mean(top + np.log(np.exp(m - top[:, None]).sum(1)) - m[np.arange(4), np.arange(4)]))
    assert took[16000] < 40 * took[1000]  # quadratic work would take 256 times as long
