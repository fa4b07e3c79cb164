"""Quality classifier by compression with dictionaries of good and bad text.

Two zstandard dictionaries are built from labelled texts, one per class. A text
is compressed with each; the dictionary of the class that it resembles
saves more bytes. The normalised difference ``(bad - good) / (bad + good)`` of the
compressed sizes, and the share of bytes that the better of both leaves, go
through a logistic curve fitted on labelled texts that built no dictionary.

The classifier is fitted on a bounded sample of the labelled rows
(``SAMPLE_ROWS`` per class, texts up to ``SAMPLE_TEXT_BYTES``, taken in the order of
a hash of doc_id); scores are computed for every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_batches import slices, texts_of

#: Bounds of the sample: 2 classes x SAMPLE_ROWS x SAMPLE_TEXT_BYTES, 40 MB at most.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 1200, 16 << 10
DICTIONARY_BYTES = 64 << 10
SPARE = 4
LEVEL = 3


def labelled_sample(
    documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES
) -> list[tuple[int, bytes]]:
    """Up to ``rows`` distinct (quality, text) per class, in the order of a hash of doc_id.

    Rows with a null doc_id, quality or text, and texts above ``text_bytes``, teach nothing (where all labelled texts are
    longer, every score is the share of good labels); a doc_id labelled both ways counts as good. The join is on
    doc_id; a bound on the hash, from the number of labels, leaves about ``SPARE`` times the rows wanted to be ranked.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    short = documents.where(F.octet_length("text") <= text_bytes).select("doc_id", F.xxhash64("doc_id").alias("order"))
    ranked = Window.partitionBy("quality").orderBy("order", "doc_id")
    below = F.lit(False)
    for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect():
        bound = int(-(2**63) + min(1.0, SPARE * rows / r["n"]) * (2**64 - 1))
        below = below | ((F.col("quality") == r["quality"]) & (F.col("order") <= F.lit(min(bound, 2**63 - 1))))
    chosen = (
        short.join(marked, "doc_id").where(below).withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= rows).select("doc_id", "quality")
    )
    found = (
        documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 x rows
        .where(F.octet_length("text") <= text_bytes)
        .select("quality", "text").distinct().limit(2 * rows).collect()
    )
    return sorted((int(r["quality"]), r["text"].encode()) for r in found)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """Dictionary content for a class: trained, or (too few texts to train) the texts themselves."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


class CompressionModel:
    """Dictionaries and curve. ``state`` is plain data; ``score`` runs on lists of texts."""

    def __init__(self, state: dict):
        self.state = state
        self._by = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=self._precomputed(d), write_content_size=False, write_dict_id=False)
            for d in (state["good"], state["bad"])
        ] if state["good"] and state["bad"] else []
        self._frame = [len(c.compress(b"")) for c in self._by]  # bytes that any text costs

    @staticmethod
    def _precomputed(content: bytes):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return d

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Normalised size difference and compressed share, per text; zeros for an empty text."""
        out = np.zeros((len(texts), 2))
        good, bad = self._by
        for k, t in enumerate(texts):
            if t:
                g = max(1, len(good.compress(t)) - self._frame[0])
                b = max(1, len(bad.compress(t)) - self._frame[1])
                out[k] = (b - g) / (b + g), min(g, b) / len(t)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self._by:
            return np.full(len(texts), self.state["prior"])
        x = np.clip((self.features(texts) - self.state["mean"]) / self.state["scale"], *self.state["range"])
        return 1.0 / (1.0 + np.exp(-np.clip(_terms(x) @ self.state["weights"], -30, 30)))


def _terms(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, x[:, 0] * x[:, 1], x[:, 1] ** 2])


def fit(sample: list[tuple[int, bytes]], dictionary_bytes: int = DICTIONARY_BYTES, shares: tuple[float, float] | None = None) -> dict:
    """Model state from a labelled sample; ``shares`` are the classes' shares among all labels (else the sample's).

    Every second text of a class builds its dictionary, the others fit the curve. With a class missing, every
    score is the share of good labels (one half without any).
    """
    by = {q: [t for k, t in sample if k == q and t] for q in (0, 1)}
    share = shares or tuple(len(by[q]) / max(1, len(by[0]) + len(by[1])) for q in (0, 1))
    state = {"good": b"", "bad": b"", "prior": share[1] if sum(share) else 0.5}
    if min(len(by[0]), len(by[1])) < 4:
        return state
    order = {q: sorted(by[q], key=lambda t: hash_order(t)) for q in by}
    state["good"], state["bad"] = (_dictionary(order[q][0::2], dictionary_bytes) for q in (1, 0))
    rest = [(q, t) for q in (0, 1) for t in order[q][1::2]]
    model = CompressionModel(state)
    x = model.features([t for _, t in rest])
    y = np.array([q for q, _ in rest], float)
    state["mean"], state["scale"] = x.mean(0), np.maximum(x.std(0), 1e-6)
    weight = np.where(y == 1, share[1] / max(1, y.sum()), share[0] / max(1, (1 - y).sum())) * len(y)
    x = (x - state["mean"]) / state["scale"]
    state["range"] = x.min(0), x.max(0)  # the curve is not used beyond what it was fitted on
    a = _terms(x)
    w = np.zeros(a.shape[1])
    for _ in range(50):  # Newton steps of a weighted, lightly damped logistic regression
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 0.1 * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    state["weights"] = w
    return state


def hash_order(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text, 7)


def learn_quality(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Fit on a sample of the labelled rows; the classes' shares come from all labels."""
    counts = {r["quality"]: r["n"] for r in labels.where(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    shares = (counts.get(0, 0) / total, counts.get(1, 0) / total) if total else None
    return fit(labelled_sample(documents, labels, rows), shares=shares)


def score_quality(documents: DataFrame, state: dict, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: good text likelier) to every row.

    Only the text is looked at; null counts as empty and an empty text gets the curve's value for no
    difference. An existing column named score is replaced. Narrow: no shuffle; the state (two
    dictionaries of fixed size) is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(state)
    rows = documents.drop("score")
    schema = T.StructType(list(rows.schema.fields)).add("score", "double")
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionModel(shared.value)
        for b in slices(batches, text):
            score = model.score(texts_of(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    return rows.mapInArrow(run, schema)
