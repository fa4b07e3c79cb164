"""Toxicity: subwords and scores against plain Python, the gradient against differences, held-out accuracy, edge cases."""

import random

import numpy as np
import pyarrow as pa
from edge_cases import edge_docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from seqloom.llm import toxicity as X
from seqloom.llm.queries import op13_toxicity_subwords
from seqloom.llm.text_batches import Powers, Words

SF01 = "/root/testdata/sf0.1"


def test_subwords_are_the_character_ngrams():
    texts = X.normalised(pa.array(["Über idiot's", "a", None, "né"]))
    assert texts[0].decode().split() == ["über", "idiot", "s"]
    w = Words(texts, Powers())
    word, bucket = X.subwords(w.buf, w.starts, w.ends, Powers())
    grams = {}
    for k in range(len(w.starts)):
        t = f"<{w.word(k).decode()}>"
        grams[k] = 1 + sum(max(0, len(t) - n + 1) for n in X.NGRAMS)
        assert (word == k).sum() == grams[k]
    one = Words([b"idiot idiots"], Powers())
    word, bucket = X.subwords(one.buf, one.starts, one.ends, Powers())
    shared = set(bucket[word == 0]) & set(bucket[word == 1])
    assert len(shared) == len({"<id", "idi", "dio", "iot", "<idi", "idio", "diot"})


def test_scores_equal_plain_python():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aber", "bé", "cccc", "idiot", "x" * 40]) for _ in range(rng.randint(0, 23))) for _ in range(40)]
    values = np.random.default_rng(1).standard_normal(X.BUCKETS)
    got = X.ToxicityModel({"values": values, "bias": 0.3, "prior": 0.5}).score(X.normalised(pa.array(texts)))

    def value(word):
        w = Words([word.encode()], Powers())
        return values[X.subwords(w.buf, w.starts, w.ends, Powers())[1]].mean()

    for text, score in zip(texts, got, strict=True):
        words = text.split()
        passages = [words[k : k + X.PASSAGE_WORDS] for k in range(0, len(words), X.PASSAGE_WORDS)]
        best = max((np.mean([value(w) for w in p]) for p in passages), default=0.0)
        assert abs(score - 1 / (1 + np.exp(-best - 0.3))) < 1e-12


def test_gradient():
    p = X.Passages([b"one two three four five six seven", b"", b"two two", b"eight nine one"], Powers())
    live, features = X._live_features(p)
    rng = np.random.default_rng(2)
    now = (rng.standard_normal((len(live), X.DIMENSIONS)), rng.standard_normal((X.DIMENSIONS, 2)), 0.2)
    weight, y = np.full(4, 0.25), np.array([1.0, 0, 0, 1])
    loss, slope = X._gradient(p, features, now, weight, y)
    for k, part in enumerate(now[:2]):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in part.shape)
            moved = [x.copy() if isinstance(x, np.ndarray) else x for x in now]
            moved[k][at] += 1e-6
            assert abs((X._gradient(p, features, tuple(moved), weight, y)[0] - loss) / 1e-6 - slope[k][at]) < 1e-4


def test_unseen_misspellings(spark):
    """Insults never seen as such share n-grams with those of the training texts; other words do not."""
    rng = random.Random(5)
    clean = ["".join(rng.choice("abefgklmnprstuv") for _ in range(rng.randint(4, 8))) for _ in range(300)]
    forms = [f"{a}dumbhead{b}" for a in ("", "o", "zu") for b in ("", "s", "ed", "ing", "ich", "o", "aire")]
    rng.shuffle(forms)
    seen, unseen = forms[:12], forms[12:]
    rows = []
    for k in range(600):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = int(k % 3 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(seen if k < 400 else unseen)
        rows.append((k, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    state = X.learn_toxicity(df.select("doc_id", "text"), df.where("doc_id < 400").select("doc_id", "toxic"))
    scored = X.score_toxicity(df.where("doc_id >= 400"), state).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in scored)
    assert right >= 0.95 * len(scored)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = op13_toxicity_subwords(spark, SF01).where("held_out").join(labels, "doc_id").collect()
    toxic = np.array([r.score for r in rows if r.toxic])
    clean = np.array([r.score for r in rows if not r.toxic])
    assert (toxic[:, None] > clean[None, :]).mean() > 0.92
    assert (clean >= 0.7).mean() < 0.04 and (toxic >= 0.7).mean() > 0.65
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame(
        [(2, 1), (4, 1), (4, 0), (7, 0), (None, 1), (9, None), (11, 0), (12, 1)], "doc_id long, toxic int"
    )
    state = X.learn_toxicity(edge_docs, labels)
    out = X.score_toxicity(edge_docs, state)
    assert sorted(out.columns) == sorted(edge_docs.columns)
    got = out.collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert len(empty) == 1 and len({r.score for r in got if r.doc_id == 4}) == 1
    assert X.score_toxicity(no_docs, state).count() == 0
    nothing = X.learn_toxicity(no_docs, labels.limit(0))
    assert {r.score for r in X.score_toxicity(edge_docs, nothing).collect()} == {0.5}
    one = X.learn_toxicity(edge_docs, labels.where("toxic = 1"))
    assert {r.score for r in X.score_toxicity(edge_docs, one).collect()} == {1.0}


def test_sample_is_bounded(spark):
    rows = [(k, f"word{k} text", k % 2) for k in range(500)] + [(1000, "x" * (X.SAMPLE_TEXT_BYTES + 1), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = X.labelled_sample(df, df.select("doc_id", "toxic"), rows=40).collect()
    assert sorted(r.toxic for r in sample) == [0] * 40 + [1] * 40
