import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators.metrics import check_finite, check_rectangular, combine, cross_entropy, paired_mse, trend
from seqloom.operators.sampling import draw, sample_walk, topk_softmax
from seqloom.operators.versions import keep_newest, latest_version


def _ties(spark):
    rows = [("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 0.5), ("b", "x", 2.0)]
    return spark.createDataFrame(rows, "key string, item string, score double")


def test_topk_ties_and_short_keys(spark):
    t = topk_softmax(_ties(spark), "key", "item", "score", k=2, temperature=0.8).orderBy("key", "rank").collect()
    assert [(r["key"], r["item"], r["rank"]) for r in t] == [("a", "x", 1), ("a", "y", 2), ("b", "x", 1)]
    assert t[0]["prob"] == pytest.approx(0.5) and t[2]["prob"] == pytest.approx(1.0)


def test_topk_probabilities_sum_to_one(spark):
    t = topk_softmax(_ties(spark), "key", "item", "score", k=50)
    sums = t.groupBy("key").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_topk_plan_has_group_limit(spark):
    t = topk_softmax(_ties(spark), "key", "item", "score", k=2)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_temperature_zero_raises(spark):
    with pytest.raises(ValueError):
        topk_softmax(_ties(spark), "key", "item", "score", temperature=0)


def test_draw_one_per_key(spark):
    t = topk_softmax(_ties(spark), "key", "item", "score", k=50)
    d = draw(t, "key", "item", seed=42).collect()
    assert sorted(r["key"] for r in d) == ["a", "b"]
    assert [r["item"] for r in d if r["key"] == "b"] == ["x"]


def test_sample_walk_stops_after_eos(spark):
    table = spark.createDataFrame([("s", "e", 0.0), ("e", "s", 0.0)], "key string, item string, score double")
    prompts = spark.createDataFrame([(1, "s"), (2, "e")], "w int, start string")
    out = sample_walk(prompts, table, "w", "start", steps=5, eos="e").orderBy("walker", "step").collect()
    one = [r["item"] for r in out if r["walker"] == 1]
    two = [r["item"] for r in out if r["walker"] == 2]
    assert one == ["s", "e"]  # eos emitted, then stop
    assert two == ["e", "s", "e"]  # eos at the start is not checked before the first draw


def test_cross_entropy_ignore(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0), ([1.0, 0.0], -100)], "s array<double>, y int")
    r = cross_entropy(df, "s", "y").first()
    assert r["loss"] == pytest.approx(0.6931471805599453) and r["rows"] == 1
    allign = spark.createDataFrame([([0.0, 0.0], -100)], "s array<double>, y int")
    assert cross_entropy(allign, "s", "y").first()["loss"] is None


def test_paired_mse_and_combine(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "k int, v array<double>")
    b = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "k int, v array<double>")
    assert paired_mse(a, b, "k", "v", "v").first()["mse"] == pytest.approx((4 + 1 + 1) / 4)
    c = spark.createDataFrame([(3, [1.0, 0.0])], "k int, v array<double>")
    with pytest.raises(ValueError):
        paired_mse(a, c, "k", "v", "v")
    gen = spark.createDataFrame([(2.0,)], "loss double")
    lat = spark.createDataFrame([(4.0,)], "loss double")
    assert combine({"gen": gen, "latent": lat}, {"latent": 0.5}).first()["total"] == pytest.approx(4.0)


def test_trend_and_guards(spark):
    df = spark.createDataFrame([(s, 10.0 - s * 0.01) for s in range(100)], "step int, loss double")
    t = trend(df, "step", "loss").first()
    assert t["decreasing"] and t["points"] == 10
    r = spark.createDataFrame([("f1", [1, 2]), ("f1", [1]), ("f2", [1, 2])], "file string, a array<int>")
    ok = {x["file"]: x["ok"] for x in check_rectangular(r, ["a"]).collect()}
    assert ok == {"f1": False, "f2": True}
    f = spark.createDataFrame([([1.0, float("nan")],), ([1.0, 2.0],)], "v array<double>")
    assert check_finite(f, "v").first()["non_finite_rows"] == 1


def test_retention_and_versions(spark):
    names = spark.createDataFrame(
        [("model_step_9.pt", 300), ("model_step_10.pt", 100), ("model_step_x.pt", 400), ("model_step_8.pt", 200)],
        "name string, mtime long",
    )
    kept = {r["name"] for r in keep_newest(names, [], ["mtime"], k=2).where("keep").collect()}
    assert kept == {"model_step_x.pt", "model_step_9.pt"}  # by time
    v = latest_version(names, "name").first()
    assert (v["version"], v["name"]) == (10, "model_step_10.pt")  # by number, not by time or text


def test_cross_entropy_long_equals_wide(spark):
    from seqloom.operators.metrics import cross_entropy_long

    wide = spark.createDataFrame([(1, [0.5, 1.5, -1.0], 1), (2, [2.0, 0.0, 0.0], 0), (3, [1.0, 1.0, 1.0], -100)],
                                 "k int, s array<double>, y int")
    long = wide.select("k", F.posexplode("s").alias("item", "score"))
    a = cross_entropy(wide, "s", "y").first()
    b = cross_entropy_long(long, wide.select("k", "y"), "k", "item", "score", "y").first()
    assert a["rows"] == b["rows"] == 2
    assert a["loss"] == pytest.approx(b["loss"], abs=1e-12)


def test_keep_newest_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3), ("a", 1)], "g string, t int")
    kept = sorted((r["g"] or "-", r["t"]) for r in keep_newest(df, ["g"], ["t"], k=2).where("keep").collect())
    assert kept == [("-", 2), ("-", 3), ("a", 1)]


def test_keep_newest_plan_uses_group_limit(spark):
    df = spark.createDataFrame([(g % 3, t) for g in range(30) for t in range(5)], "g int, t int")
    plan = keep_newest(df, ["g"], ["t"], k=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sample_walk_matches_python_brute_force(spark):
    import hashlib
    import math

    def u(*parts):
        h = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:13]
        return int(h, 16) / 2.0**52

    table = [("a", "b", 1.0), ("a", "c", 0.5), ("a", "d", 0.1), ("b", "a", 0.3), ("b", "c", 0.9), ("c", "a", 0.2),
             ("c", "b", 0.2), ("c", "e", 0.4), ("d", "e", 1.0), ("e", "a", 0.7), ("e", "d", 0.7)]
    k, temp, steps, eos, seed = 2, 0.8, 6, "e", 42
    by_key = {}
    for key, item, s in table:
        by_key.setdefault(key, []).append((s / temp, item))
    probs = {}
    for key, cands in by_key.items():
        top = sorted(cands, key=lambda x: (-x[0], x[1]))[:k]
        m = max(s for s, _ in top)
        z = sum(math.exp(s - m) for s, _ in top)
        acc, rows = 0.0, []
        for s, it in top:
            acc += math.exp(s - m) / z
            rows.append((acc, it))
        probs[key] = rows
    want = []
    for w, start in [(1, "a"), (2, "c"), (3, "e")]:
        want.append((w, 0, start))
        cur = start
        for t in range(1, steps + 1):
            if cur not in probs:
                break
            x = u(seed, w, t)
            nxt = next((it for c, it in probs[cur] if c > x), probs[cur][-1][1])
            want.append((w, t, nxt))
            cur = nxt
            if cur == eos:
                break
    tdf = spark.createDataFrame(table, "key string, item string, score double")
    pdf = spark.createDataFrame([(1, "a"), (2, "c"), (3, "e")], "w long, s string")
    got = sorted((r["walker"], r["step"], r["item"]) for r in sample_walk(pdf, tdf, "w", "s", steps, eos=eos, seed=seed, k=k, temperature=temp).collect())
    assert got == sorted(want)


def test_long_cross_entropy_raises_on_a_label_without_score(spark):
    from seqloom.operators.metrics import cross_entropy_long

    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.1), (2, 0, 0.3)], "k int, item int, s double")
    labels = spark.createDataFrame([(1, 1), (2, 5)], "k int, y int")
    with pytest.raises(Exception, match="label has no score"):
        cross_entropy_long(scores, labels, "k", "item", "s", "y").collect()
    assert cross_entropy_long(scores, labels.where("k = 1"), "k", "item", "s", "y").first()["rows"] == 1


def test_paired_mse_frame_raises_on_unpaired_keys(spark):
    from seqloom.operators.metrics import paired_mse_frame

    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="differ in size or shape"):
        paired_mse_frame(a, a.where("k = 1"), "k", "v", "v").collect()
    with pytest.raises(Exception, match="differ in size or shape"):
        paired_mse_frame(a, a.unionByName(a), "k", "v", "v").collect()


@pytest.mark.parametrize("held", [0, 10**6])
def test_sample_walk_held_and_joined_agree_with_brute_force(spark, held):
    """Walkers on one item in three, items without a row, null starts; both ways of meeting the table."""
    import hashlib

    import numpy as np

    rng = np.random.default_rng(6)
    edges = {(int(a), int(b)): float(s) for a, b, s in zip(rng.integers(0, 30, 400), rng.integers(0, 34, 400), rng.random(400))}
    table = [(f"k{a}", f"k{b}", s) for (a, b), s in edges.items()]
    starts = [(w, None if w % 50 == 0 else "k1" if w % 3 == 0 else f"k{w % 34}") for w in range(600)]
    probs = {}
    for a in {x[0] for x in table}:
        top = sorted(((-s / 0.7, b) for k, b, s in table if k == a))[:4]
        p = np.exp([-s + top[0][0] for s, _ in top])
        probs[a] = list(zip(np.cumsum(p / p.sum()), [b for _, b in top]))
    want = []
    for w, cur in starts:
        want.append((w, 0, cur))
        for t in range(1, 8):
            if cur not in probs:
                break
            u = int(hashlib.md5(f"9:{w}:{t}".encode()).hexdigest()[:13], 16) / 2.0**52
            cur = next((b for c, b in probs[cur] if c > u), probs[cur][-1][1])
            want.append((w, t, cur))
            if cur == "k2":
                break
    out = sample_walk(
        spark.createDataFrame(starts, "w long, s string").repartition(3), spark.createDataFrame(table, "key string, item string, score double"),
        "w", "s", 7, eos="k2", seed=9, k=4, temperature=0.7, held_rows=held,
    )
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)


def test_first_above():
    import numpy as np

    cum = np.array([0.2, 0.5, 1.0, 0.3, 0.9999, 1.0])
    start, stop = np.array([0, 0, 0, 3, 5, 3]), np.array([3, 3, 3, 5, 6, 5])
    u = np.array([0.0, 0.2, 0.7, 0.3, 0.5, 0.99999])
    assert sample_first(cum, start, stop, u) == [0, 1, 2, 4, 5, 4]


def sample_first(*args):
    from seqloom.operators.sampling import first_above

    return first_above(*args).tolist()


def test_shifted_cross_entropy(spark):
    from seqloom.operators.metrics import shifted_cross_entropy

    seqs = [
        (1, [[1.0, 2.0, 0.5], [0.0, 0.0, 0.0], [3.0, 1.0, 1.0]], [0, 2, 1]), (2, [[5.0, 1.0, 1.0], [9.0, 9.0, 9.0]], [0, -100]),
        (3, [[1.0, 1.0, 1.0]], [0]), (4, [[2.0, 0.0, 0.0], [0.0, 0.0, 0.0]], [0, None]),
    ]
    df = spark.createDataFrame(seqs, "k long, s array<array<double>>, l array<int>")
    r = shifted_cross_entropy(df, "k", "s", "l").first()
    want = [np.log(np.exp(s[t]).sum()) - s[t][lab[t + 1]] for s, lab in [(seqs[0][1], seqs[0][2])] for t in range(2)]
    assert r["rows"] == 2 and r["loss"] == pytest.approx(np.mean(want))
    bad = spark.createDataFrame([(1, [[1.0]], [0, 1])], df.schema)
    with pytest.raises(Exception, match="differ in length"):
        shifted_cross_entropy(bad, "k", "s", "l").collect()


def test_sampling_table_takes_the_sort_of_the_ranking(spark):
    from seqloom.operators.sampling import sampling_table, topk_softmax

    rows = [("a", "x", 1.0), ("a", "y", 3.0), ("a", "z", 3.0), ("a", None, 2.0), ("b", "x", 0.5), ("c", "x", 1.0), ("c", "y", 1.0)]
    probs = topk_softmax(spark.createDataFrame(rows, "key string, item string, score double"), "key", "item", "score", k=3, temperature=1.0)
    table = sampling_table(probs)
    got = {r["key"]: (r["items"], r["cums"]) for r in table.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": ["y", "z", None], "b": ["x"], "c": ["x", "y"]}
    assert got["c"][1] == [0.5, 1.0] and all(v[1][-1] == pytest.approx(1.0) for v in got.values())
    plan = table._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan  # one row per key comes from the window, not from a second pass by key


def test_joined_walk_deals_out_the_table_once(spark, monkeypatch):
    dealt, kind = [], type(spark.range(0))
    real = kind.repartition

    def repartition(self, *args):
        dealt.append(self.columns)
        return real(self, *args)

    monkeypatch.setattr(kind, "repartition", repartition)
    held = spark._jsc.getPersistentRDDs().size()
    table = spark.createDataFrame([(f"k{a}", f"k{(a * 7 + b) % 40}", float(b)) for a in range(40) for b in range(5)], "key string, item string, score double")
    walkers = spark.createDataFrame([(w, f"k{w % 40}" if w % 2 else "k1") for w in range(400)], "w long, s string")
    out = sample_walk(walkers, table, "w", "s", 6, held_rows=0)
    assert dealt == [["cur", "items", "cums"]] and spark._jsc.getPersistentRDDs().size() == held
    assert out.groupBy("step").count().where("count <> 400").isEmpty() and out.count() == 2800
