"""Ranked search against brute force, on classes of equal bags and edge cases."""

import math
import random
import re
from collections import Counter

from edge_cases import edge_docs, no_docs  # noqa: F401

from seqloom.llm import ranked_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute_force(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs]
    N, L = sum(bool(t) for _, t in bags), sum(len(t) for _, t in bags)
    df = Counter(w for _, t in bags for w in set(t))
    words = {}
    for item, text in items:
        words.setdefault(item, []).extend(terms(text))
    out = []
    for item, asked in words.items():
        found = []
        for doc, t in bags:
            tf = Counter(t)
            if t:
                m = 100 - 75 + (75 * len(t) * N) // L
                score = sum(
                    math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in asked if tf[w]
                )
                if score > 0:
                    found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(found[:k])]
    return sorted(out, key=str)


def got_of(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in S.ranked_search(d, i, **options).collect()), key=str)


def test_terms():
    assert [w.decode() for part in S.terms("Ab-c\x00É9\x7f_ü½".encode()) for w in part] == ["ab", "c", "É9", "ü½"]
    long = b"x" * 3_000_000
    for text in (long, b" " + long + b" y", b"a " + long, (b"word " * 700_000) + long + b".z"):
        assert [w for part in S.terms(text) for w in part] == text.replace(b".", b" ").split()


def test_random_documents(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÜBER", "x1y"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([3, 20, 63])]) for _ in range(n))
    docs = [(rng.randrange(10**6), text(rng.randint(0, 60))) for _ in range(400)]
    docs += [(rng.randrange(10**6), docs[0][1]) for _ in range(300)]  # a group of copies: a third of the rows and more
    docs += [(7, "w1 w2"), (7, "w1 w2"), (7, "w2 w1"), (None, "w1 w2"), (None, "w1 w2"), (9, None), (10, ""), (11, " \n.")]
    items = [(k, text(rng.randint(1, 12))) for k in range(25)] + [(3, "w1 w1 Été"), (None, "w2"), (90, None), (91, "unknown")]
    want = brute_force(docs, items)
    assert got_of(spark, docs, items) == want
    assert got_of(spark, docs, items, item_bytes=120) == want  # several blocks of items
    assert got_of(spark, docs, items, k=1000) == brute_force(docs, items, 1000)


def test_equal_bags_are_one_class(spark):
    docs = [(k, "a b a c") for k in range(50, 0, -1)] + [(k, "c a, A. b") for k in range(100, 120)] + [(200, "a a b d d")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    block = S.ItemBlock([(1, "a b")])
    bags = S.document_bags(d, spark.sparkContext.broadcast(block.words), "test-classes")
    classes = S.bag_classes(bags, 71, sum(len(terms(t)) for _, t in docs), 10).collect()
    assert sorted(r.ids for r in classes) == [list(range(1, 11)), [200]]
    assert got_of(spark, docs, [(1, "a b")]) == brute_force(docs, [(1, "a b")])


def test_very_large_scores_stay_whole(spark):
    docs = [(1, "rare " * 50_000), (2, "rare common"), *((k, "common") for k in range(3, 40))]
    items = [(1, "rare " * 30_000 + "common")]
    assert got_of(spark, docs, items) == brute_force(docs, items)


def test_edge_cases(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "one w1 line", 5), (2, None, 6)], "item_id long, text string, doc_id long")
    got = [tuple(r) for r in S.ranked_search(edge_docs, items).collect()]
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sorted(got, key=str) == brute_force(docs, [(1, "one w1 line"), (2, None)])
    assert S.ranked_search(no_docs, items).count() == 0 and S.ranked_search(edge_docs, items.limit(0)).count() == 0
    assert S.ranked_search(no_docs, items).columns == ["item_id", "rank", "doc_id", "score"]
