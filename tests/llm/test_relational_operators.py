"""URL rules, Jaccard join, suffix tree, top-k search, the queries and the pipeline against brute force and on edge cases."""

import collections
import math
import random
import re

import numpy as np
import pytest
from edge_cases import SF001, edge_docs, no_docs  # noqa: F401

import corpus_pipeline
from seqloom.llm.components import connected_components
from seqloom.llm.ngram_jaccard import jaccard_components, one_per_component
from seqloom.llm.pivot_search import build_index, integer_vectors, top_k
from seqloom.llm.suffix_tree_lm import learn, score_texts
from seqloom.llm.url_rules import judge_urls

# ---- urls


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "net", "x.net", "ample.com", "EXAMPLE.com", "com.", ""]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/en/a", "/es/x", "/fr", "/e"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:6] for p in paths if rng.random() < 0.5]
    urls = [None, "", "no scheme", "://", "http://", "x://com/en/?a#b", "http://com?x", "http://com#/en/"]
    urls += [f"{rng.choice(['http', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', 'z', 'é'])}" for _ in range(400)]
    rows = [(k if k % 50 else None, u, "old") for k, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    out = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = collections.Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got == collections.Counter((i, u, *brute_verdict(u, rules)) for i, u, _ in rows)


def test_urls_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in judge_urls(pages, none).collect()] == [(None, "allow")]
    twice = spark.createDataFrame([("A.com", None, "allow"), ("a.com", "", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert judge_urls(pages, twice).first().verdict == "block"
    assert judge_urls(pages.limit(0), twice).count() == 0


def test_url_host_of_very_many_labels(spark):
    # repeated rows, a clashing column, and hosts whose suffix keys would be quadratic in their labels
    long_host = "x." * 100_000 + "example.com"
    urls = [f"http://{long_host}/en/a", f"http://{long_host}/en/a", "http://" + "net." * 100_000 + "net/es/", "http://" + "." * 100_000 + "/es/"]
    rules = [("example.com", "/en/", "block"), ("net", "/es/", "block"), ("a.b.c.d.net", "/es/", "allow")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}


# ---- Jaccard


def shingles(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=85, width=4):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(x for x in (least.get(r, i), i, math.inf) if x is not None)
    return [(i, len(sets[k]), None if least[find(k)] == math.inf else least[find(k)]) for k, (i, _) in enumerate(rows)]


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 90]))] for _ in range(12)]
    rows = []
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
        rows.append((k, " ".join(w) if rng.random() < 0.5 else " ".join(w).upper()))
    return rows


@pytest.mark.parametrize("seed,percent,width", [(1, 85, 4), (2, 80, 5)])
def test_components_equal_brute_force(spark, seed, percent, width):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, n long, set_id long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, percent, width).collect())
    want = sorted(brute_components(rows, percent, width))
    assert got == want
    kept = sorted(r.doc_id for r in one_per_component(df, percent, width).collect())
    assert kept == sorted({c for _, _, c in want})


def test_long_lists_in_blocks(spark, monkeypatch):
    from seqloom.llm import ngram_jaccard as J

    monkeypatch.setattr(J, "BLOCK", 8)
    rows = near_copies(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == sorted(brute_components(rows))


def test_components_edge_cases(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(edge_docs).collect())
    small = [(i, t if i != 7 else " ".join((t or "").split()[:5000])) for i, t in rows]
    want = collections.Counter((i, n if i != 7 else len(shingles(dict(rows)[7], 4)), i if not n else c) for i, n, c in brute_components(small))
    assert got == want
    assert jaccard_components(no_docs).count() == 0 and one_per_component(no_docs).count() == 0
    kept = one_per_component(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(["1", "2", "None", "None", "4", "6", "7", "8", "10", "11", "12"])


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (102, 100), (100, 101)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


# ---- suffix tree


def brute_base(train, text):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    mine = tokens(text)
    return len(mine), sum(c[x] > 0 for x in mine), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in mine)


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_base_scores_equal_brute_force(spark, edge_docs, frequent):
    docs = edge_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").limit(60).selectExpr("doc_id + 1000 AS doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [t for i, t in rows if (i or 0) % 2 == 0]
    model = learn(docs.where("coalesce(doc_id, 0) % 2 = 0"), frequent=frequent)
    got = score_texts(docs, model).collect()
    assert len(got) == len(rows)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(brute_base(train, t))
    have = collections.defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score))
        assert r.score < 0
    for i in want:
        for a, b in zip(sorted(want[i]), sorted(have[i]), strict=True):
            assert a[:3] == b[:3] and b[3] == pytest.approx(a[3], rel=1e-9)


def test_tree_is_a_distribution_and_beats_unigrams(spark):
    rng = random.Random(4)
    follow = {w: [rng.choice("abcdefgh") for _ in range(2)] for w in "abcdefgh"}
    texts = []
    for k in range(300):
        w = ["a"]
        for _ in range(60):
            w.append(rng.choice(follow[w[-1]]))
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = learn(df.where("doc_id < 250"))
    assert np.allclose((10 ** model.state["log"]).sum(axis=1), 1.0) and len(model.state["log"]) > 8
    held = score_texts(df.where("doc_id >= 250"), model).toPandas()
    assert (held.score > held.base_score).all()


def brute_tree(train, texts, depth, least):
    """Score of every text by a tree over words, as the module's docstring states it; and the nodes."""
    seqs = lambda t: [None] * depth + (t or "").lower().split() + [None]
    uni, after = collections.Counter(), collections.defaultdict(collections.Counter)
    for q in map(seqs, train):
        for i in range(depth, len(q)):
            uni[q[i]] += 1
            for k in range(1, depth + 1):
                after[tuple(q[i - k : i])][q[i]] += 1
    norm = sum(uni.values()) + len(uni) + 1

    def p(s, x):
        if not s:
            return (uni[x] + 1) / norm
        c, whole = after[s], sum(after[s].values())
        return (c[x] + len(c) * p(s[1:], x)) / (whole + len(c))

    nodes = set()
    for s, c in list(after.items()):
        whole = sum(c.values())
        starts = len(s) > 1 and s[:2] == (None, None)  # the text's start stands once in a context
        if whole >= least and not starts:
            gain = sum(n * math.log(n / whole / p(s[1:], x)) for x, n in c.items())
            if gain > len(c) / 2 * math.log(whole):
                nodes |= {s[k:] for k in range(len(s))}
    out = {}
    for i, t in texts:
        q = seqs(t)
        out[i] = 0.0
        for j in range(depth, len(q)):
            s = next((tuple(q[j - k : j]) for k in range(depth, 0, -1) if tuple(q[j - k : j]) in nodes), None)
            out[i] += math.log10(p(s, q[j])) if s else math.nan  # no node: left to the tree over symbols
    return out, nodes


@pytest.mark.parametrize("hot", [1 << 22, 400, 3])
def test_contexts_of_any_words_grow_with_the_texts(spark, hot):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]  # beyond the 254 symbols
    follow = {}
    texts = []
    for k in range(500):
        w = [rng.choice(words[300:303]), rng.choice(words[:20])]
        while len(w) < 60:  # the next word depends on three words before
            w.append(rng.choice(follow.setdefault(tuple(w[-3:]) if w[-1] in words[:20] else w[-1], [rng.choice(words) for _ in range(2)] + words[:3])))
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = learn(df.where("doc_id < 480"), min_count=1, hot=hot)
    want, nodes = brute_tree([t for i, t in texts if i < 480], texts, 3, 1)
    single = {s[0] for s in nodes if len(s) == 1}
    assert len(single) > 255 and any(len(s) == 3 for s in nodes)
    assert model.terms.where("n > 0").count() > len(nodes)
    got = {r.doc_id: r.score for r in score_texts(df, model).collect()}
    sure = [i for i, t in texts if set(t.split()) <= single]
    assert len(got) == len(texts) and len(sure) > 10
    for i in sure:
        assert got[i] == pytest.approx(want[i], rel=1e-9)


def test_suffix_tree_without_training(spark, edge_docs, no_docs):
    model = learn(no_docs)
    got = score_texts(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(r.n_known == 0 and r.base_score == 0.0 for r in got)
    assert score_texts(no_docs, model).count() == 0


# ---- top-k


def brute_top(vectors, queries, k):
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items()}
    out = []
    for q in queries:
        s = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)
        out += [(q, r + 1, i, -s_) for r, (s_, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "copies", "few", "large"])
def test_top_k_equals_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    n = 4 if kind == "few" else 400
    m = rng.normal(size=(n, 8)).astype(np.float32) * (1e5 if kind == "large" else 1.0)
    if kind == "clusters":
        m += 6 * rng.normal(size=(5, 8))[rng.integers(0, 5, n)].astype(np.float32)
    if kind == "copies":
        m[: n // 2] = m[0]
    vectors = {i: [float(x) for x in v] for i, v in enumerate(m)}
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, d int")
    index = build_index(integer_vectors(df), pivots=6, rings=4)
    queries = [i for i in vectors if i % 40 == 0]
    got = top_k(index, index.rows.where("vec_id % 40 = 0"), 10)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute_top(vectors, queries, 10)


def test_top_k_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (None, [1.0]), (4, []), (5, [float("inf")]), (6, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = build_index(integer_vectors(df))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(index, index.rows.where("vec_id % 100 = 0")).collect())
    # both rows of vec_id 0 ask, and both are candidates
    valid = [(0, [1024, 2048]), (0, [1024, 2048]), (100, [512]), (4, []), (6, [-1024, 102])]
    pairs = {q: sorted((-sum(x * y for x, y in zip(a, b)), j) for i, a in valid if i == q for j, b in valid if j != q) for q in (0, 100)}
    assert got == [(q, r + 1, j, -s) for q in (0, 100) for r, (s, j) in enumerate(pairs[q][:10])]
    empty = build_index(integer_vectors(df.limit(0)))
    assert top_k(empty, empty.rows).count() == 0


def test_top_k_keeps_the_last_neighbour_in_the_own_ring(spark):
    rng = np.random.default_rng(11)
    m = 5 * rng.normal(size=(3, 16))[rng.integers(0, 3, 600)] + rng.normal(size=(600, 16))
    vectors = {i: [float(x) for x in v] for i, v in enumerate(m)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    index = build_index(integer_vectors(df), pivots=1, rings=1)
    got = top_k(index, index.rows.where("vec_id % 20 = 0"), 10)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute_top(vectors, range(0, 600, 20), 10)


def test_search_of_many_wide_queries(spark, tmp_path):
    """2,000 queries in one batch, each near all 768 rings: its vector is handed on once per block, a bounded number at once."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(23)
    m = rng.integers(-9, 10, size=(4000, 256))
    rows = {"vec_id": pa.array(range(4000), pa.int64()), "embedding": pa.array(list(m.astype(float)))}
    pq.write_table(pa.table(rows), f"{tmp_path}/v.parquet")
    index = build_index(integer_vectors(spark.read.parquet(f"{tmp_path}/v.parquet"), scale=1.0))
    got = top_k(index, index.rows.where("vec_id % 2 = 0"), 10).orderBy("query_id", "rank").collect()
    want = []
    for q, scores in zip(range(0, 4000, 2), (m[::2] @ m.T), strict=True):
        best = [j for j in np.lexsort((np.arange(4000), -scores))[:11] if j != q][:10]
        want += [(q, r + 1, j, scores[j]) for r, j in enumerate(best)]
    assert [tuple(r) for r in got] == want


def test_packed_vectors_of_all_widths(spark):
    from seqloom.llm.pivot_search import _matrix

    rows = [(0, [1.0, -2.5]), (1, [40_000.0]), (2, []), (3, [2.0**40, -3.0]), (4, [None, 1.0]), (5, [-1e30, 7.0])]
    for part in ([0], [0, 1, 2], [0, 3], [2], [5, 0], [4]):
        df = spark.createDataFrame([rows[k] for k in part], "vec_id long, embedding array<double>").coalesce(1)
        got = integer_vectors(df, scale=1.0).toArrow()
        want = [np.clip(np.floor(rows[k][1]), -(2.0**62), 2.0**62) for k in part if k != 4]
        assert got.column("dim").to_pylist() == [len(v) for v in want]
        m = _matrix(got.column("vec").combine_chunks(), 2)
        assert [m[k, : len(v)].tolist() for k, v in enumerate(want)] == [v.tolist() for v in want]


# ---- pipeline


def test_pipeline_stages(spark, edge_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF001)
        assert out.columns == docs.columns and out.join(now, docs.columns, "left_anti").count() == 0
        now = out.checkpoint()
    rows = [(r.doc_id, r.text) for r in now.collect()]
    assert all(c == i for i, _, c in brute_components(rows, 80, 5))
    ran = corpus_pipeline.run(spark, SF001).toPandas()
    assert set(ran.doc_id) == {i for i, _ in rows} and ran.groupby("doc_id").length.sum().sum() == ran.drop_duplicates("doc_id").doc_tokens.sum()


def test_pipeline_filters_against_brute_force(spark):
    from test_text_operators import brute_languages, brute_rules

    from seqloom.llm import repetition_rules as rules

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.collect()
    learn = [(r.lang, r.text) for r in rows if r.text is not None and r.lang is not None]
    _, found = brute_languages(learn, [r.text for r in rows])
    stays = {r.doc_id for r, (lang, score) in zip(rows, found, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language_id"](spark, docs, SF001).checkpoint()
    assert sorted(r.doc_id for r in named.select("doc_id").collect()) == sorted(stays)

    def keeps(text):
        n_words, chars, symbols, _, repeated, dup = brute_rules(text, tuple(rules.DUP_NGRAM_SHARE))
        if n_words < 50 or 2 * repeated > n_words or symbols > rules.SYMBOLS_PER_WORD * n_words:
            return False
        lines = collections.Counter()
        again = 0
        for line in text.split("\n"):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            again += sum(map(len, words)) if lines[line] else 0
            lines[line] += 1
        limits = rules.DUP_NGRAM_SHARE.values()
        return again <= rules.DUP_LINE_SHARE * chars and all(d <= limit * chars for d, limit in zip(dup, limits, strict=True))

    kept = stages["quality_rules"](spark, named, SF001)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in rows if r.doc_id in stays and keeps(r.text))


def test_pipeline_edge_cases(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF001)
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF001).count() >= 0


def test_signatures_never_rule_out_a_link():
    from seqloom.llm.ngram_jaccard import _close, _signature

    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        linked = 100 * same >= 85 * (len(a) + len(b) - same)
        sig = [np.frombuffer(_signature(s), np.uint64)[None, :] for s in (a, b)]
        assert not linked or _close(*sig, np.array([len(a)]), np.array([len(b)]), 85)[0]


def test_most_frequent_words_fit_the_limit(spark):
    from seqloom.llm.suffix_tree_lm import most_frequent

    counts = spark.createDataFrame([(k, 1 + k % 7 if k < 90 else 10_000 * k) for k in range(100)], "h long, n long")
    h, n = most_frequent(counts, 40)
    assert len(h) == 10 + 12 + 13 and (np.diff(n) <= 0).all() and n.min() == 6 and h[0] == 99  # all of a count or none
    assert len(most_frequent(counts, 5)[0]) == 5 and len(most_frequent(counts.limit(0), 5)[0]) == 0


def test_most_frequent_words_of_one_large_class(spark):
    from seqloom.llm.suffix_tree_lm import most_frequent

    counts = spark.createDataFrame([(k, 1) for k in range(3000)], "h long, n long")
    h, n = most_frequent(counts, 1000)
    assert 800 <= len(h) <= 1000 and len(set(h.tolist())) == len(h) and (n == 1).all()
    again, _ = most_frequent(counts.repartition(5), 1000)
    assert (h == again).all()


def test_search_keeps_every_row_of_a_vec_id(spark):
    """Differing rows of one vec_id are candidates each; a third of the rows share one id; several query chunks."""
    import seqloom.llm.pivot_search as P

    rng = np.random.default_rng(17)
    rows = [(int(rng.integers(0, 60)) if k % 3 else 7, rng.normal(size=5).round(2).tolist()) for k in range(600)]
    rows += [(1, [5.0] + [0.0] * 4), (1, [9.0] + [0.0] * 4), (200, [1.0] + [0.0] * 4), (300, [1.0, 0.5] + [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    old = P.QUERY_CHUNK, P.RING_SPLIT
    P.QUERY_CHUNK, P.RING_SPLIT = 3, 40
    try:
        index = P.build_index(P.integer_vectors(df), pivots=4, rings=3)
        got = P.top_k(index, index.rows.where("vec_id % 10 = 0").select("vec_id"), 10).collect()
    finally:
        P.QUERY_CHUNK, P.RING_SPLIT = old
    whole = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in whole if i % 10 == 0}):
        pairs = sorted((-int(a @ b), j) for i, a in whole if i == q for j, b in whole if j != q)[:10]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(pairs)]
    assert sorted(tuple(r) for r in got) == sorted(want)
