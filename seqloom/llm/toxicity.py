"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is a bag of character n-grams (with its two ends marked) and of itself, each hashed to a row
of an embedding table; the word's vector is the mean of these rows. A passage of PASSAGE_WORDS
consecutive words is the mean of its words' vectors, and a linear softmax over two classes
reads it. The passage that looks most toxic decides for its text, so a remark in a long
text is not averaged away. The embedding table and the softmax are learned together, by
gradient descent on labelled texts. A misspelling or an inflection that was never seen shares
most of its n-grams with known words, and so their vectors.

Labels teach through a bounded sample (SAMPLE_ROWS distinct texts of a class and SAMPLE_BYTES in all,
texts up to SAMPLE_TEXT_BYTES, in the order of a hash of doc_id); scores are computed for every whole text.
As the softmax is linear, a word's share of the logit is the mean over its rows of one number each;
the executors get that one number per row (1 MB), never the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_batches import BYTE_NUMBERS, Powers, Words, mix64, slices, texts_of

#: Bounds of the sample: distinct texts of a class, bytes of one text, bytes of all texts of a class.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES, SAMPLE_BYTES = 4000, 8 << 10, 5 << 20
#: Labels ranked per row that is wanted: a bound on the hash of doc_id leaves about so many times SAMPLE_ROWS.
SPARE = 4
BUCKETS, DIMENSIONS, NGRAMS = 1 << 18, 8, (3, 4)
PASSAGE_WORDS = 5
#: Rows of the table learn if they occur in this share of the sample's texts (two at least); others stay zero.
LEAST_SHARE = 0.005
STEPS, RATE, MOMENTUM = 200, 20.0, 0.9
#: The rate grows while the loss falls; a step that raises the loss is taken back and the rate halved.
FASTER, SLOWER = 1.05, 0.5
#: The bias moves with every text, so it learns more slowly.
BIAS_SHARE = 1e-3
_CHUNK_WORDS = 1 << 16
_WORD_SEED = np.uint64(0x5851F42D4C957F2D)
#: ASCII characters other than letters and digits part words.
_APART = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def normalised(column: pa.Array) -> list[bytes]:
    """Lower-cased UTF-8 texts with blanks between words; null becomes empty."""
    kind = pa.large_string() if pa.types.is_large_string(column.type) else pa.string()
    return [t.translate(_APART) for t in texts_of(pc.utf8_lower(column.cast(kind)))]


def subwords(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of characters of the given words, ``<`` and ``>`` at their ends, and of the words themselves."""
    size = ends - starts + 2
    after = np.cumsum(size)
    first = after - size
    total = int(after[-1]) if len(after) else 0
    buf = np.empty(total, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    inner = np.ones(total, bool)
    inner[first] = inner[after - 1] = False
    buf[first], buf[after - 1] = ord("<"), ord(">")
    at = np.arange(total) - first[word] - 1 + starts[word]
    buf[inner] = joined[at[inner]]
    up, down = powers.upto(total + 1)
    prefix = np.zeros(total + 1, np.uint64)
    np.cumsum(BYTE_NUMBERS[buf] * up[:total], out=prefix[1:])
    chars = np.append(np.flatnonzero((buf & 0xC0) != 0x80), total)  # where characters begin
    words, found = [np.arange(len(size))], [mix64((prefix[after] - prefix[first]) * down[first] ^ _WORD_SEED)]
    for n in NGRAMS:
        begin, end = chars[:-n], chars[n:]
        if not len(begin):
            break
        whole = word[begin] == word[end - 1]
        begin, end = begin[whole], end[whole]
        words.append(word[begin])
        found.append(mix64((prefix[end] - prefix[begin]) * down[begin]))
    return np.concatenate(words), (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Passages:
    """Texts as passages of distinct words: ``word`` (number of each word), ``passage`` (of each word), ``text`` (of each passage)."""

    def __init__(self, texts: list[bytes], powers: Powers):
        w = Words(texts, powers)
        _, at, word = np.unique(w.hashes, return_index=True, return_inverse=True)
        self.n_texts, self.n_words = len(texts), len(at)
        self.word = word.astype(np.int32)
        self._joined, self._spans, self._powers = w.buf, (w.starts[at], w.ends[at]), powers
        begin = np.cumsum(w.counts) - w.counts
        local = (np.arange(len(w.rows)) - begin[w.rows]) // PASSAGE_WORDS
        each = -(-w.counts // PASSAGE_WORDS)
        self.first = np.cumsum(each) - each  # passage of each text
        self.spoken = np.flatnonzero(each)  # texts with a word
        self.passage = (self.first[w.rows] + local).astype(np.int32)
        self.text = np.repeat(np.arange(len(texts)), each)
        self.length = np.bincount(self.passage, minlength=len(self.text))

    def subwords(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, word, bucket) for the distinct words in chunks; words count from 0 in each chunk."""
        starts, ends = self._spans
        for lo in range(0, self.n_words, _CHUNK_WORDS):
            hi = min(self.n_words, lo + _CHUNK_WORDS)
            yield lo, hi, *subwords(self._joined, starts[lo:hi], ends[lo:hi], self._powers)

    def logits(self, word_values: np.ndarray) -> np.ndarray:
        """Mean over each passage of its words' values."""
        return np.bincount(self.passage, weights=word_values[self.word], minlength=len(self.text)) / self.length

    def word_values(self, bucket_values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_words)
        for lo, hi, word, bucket in self.subwords():
            n = np.bincount(word, minlength=hi - lo)
            out[lo:hi] = np.bincount(word, weights=bucket_values[bucket], minlength=hi - lo) / n
        return out

    def highest(self, logits: np.ndarray) -> np.ndarray:
        """Highest logit of each text; 0 for a text without a word."""
        out = np.zeros(self.n_texts)
        if len(self.spoken):
            out[self.spoken] = np.maximum.reduceat(logits, self.first[self.spoken])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def train(sample: list[tuple[int, bytes]], steps: int = STEPS, seed: int = 13) -> dict:
    """Learn ``table`` (BUCKETS x DIMENSIONS), ``softmax`` (DIMENSIONS x 2) and ``bias`` from (toxic, text) with normalised texts.

    Each step scores every text by its most toxic passage, and moves that passage's rows of the table and the
    softmax along the gradient of the cross-entropy, both classes weighing the same.
    """
    y = np.array([k for k, _ in sample], float)
    p = Passages([t for _, t in sample], Powers())
    live, features = _live_features(p)
    rng = np.random.default_rng(seed)
    n = len(live)
    table = rng.standard_normal((n, DIMENSIONS)) * 0.005
    softmax = rng.standard_normal((DIMENSIONS, 2)) * 0.5
    now = (table, softmax, 0.0)
    moved = tuple(np.zeros_like(x) for x in now)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    rate, before = RATE, None
    for _ in range(steps):
        loss, slope = _gradient(p, features, now, weight, y)
        if before and loss > before[0]:
            loss, now, slope = before
            rate, moved = rate * SLOWER, tuple(0.0 * m for m in moved)
        else:
            rate *= FASTER
        before = (loss, now, slope)
        moved = tuple(MOMENTUM * m - rate * g for m, g in zip(moved, slope, strict=True))
        now = tuple(x + m for x, m in zip(now, moved, strict=True))
    table, softmax, bias = before[1] if before else now
    whole = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    whole[live] = table
    return {"table": whole, "softmax": softmax, "bias": float(bias)}


def _gradient(p: Passages, features: tuple, now: tuple, weight: np.ndarray, y: np.ndarray) -> tuple[float, tuple]:
    """Cross-entropy over the texts, and its gradient by table, softmax and bias."""
    word, row, many = features
    table, softmax, bias = now
    contrast = softmax[:, 1] - softmax[:, 0]
    value = table @ contrast
    logits = p.logits(np.bincount(word, weights=value[row], minlength=p.n_words) / many)
    best = p.highest(logits)
    chance = _sigmoid(best + bias)
    error = weight * (chance - y)
    chosen = np.flatnonzero(logits == best[p.text])
    chosen = chosen[np.append(True, p.text[chosen][1:] != p.text[chosen][:-1])]  # of equal passages, the first
    at_passage = np.zeros(len(p.text))
    at_passage[chosen] = error[p.text[chosen]] / p.length[chosen]
    at_word = np.bincount(p.word, weights=at_passage[p.passage], minlength=p.n_words) / many
    at_row = np.bincount(row, weights=at_word[word], minlength=len(table))
    along = table.T @ at_row
    loss = -float(weight @ np.log(np.where(y == 1, chance, 1 - chance) + 1e-15))
    return loss, (np.outer(at_row, contrast), np.column_stack([-along, along]), BIAS_SHARE * error.sum())


def _live_features(p: Passages) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets that learn; and (word, number of its bucket among them) of the subwords, with all subwords counted per word."""
    both = np.unique(p.text[p.passage].astype(np.int64) * p.n_words + p.word)
    texts = np.bincount(both % max(1, p.n_words), minlength=p.n_words)  # texts of each word
    seen, many = np.zeros(BUCKETS), np.ones(p.n_words)
    for lo, hi, word, bucket in p.subwords():
        seen += np.bincount(bucket, weights=texts[lo:hi][word], minlength=BUCKETS)
        many[lo:hi] = np.bincount(word, minlength=hi - lo)
    number = np.full(BUCKETS, -1, np.int32)
    live = np.flatnonzero(seen >= max(2, LEAST_SHARE * p.n_texts))
    number[live] = np.arange(len(live))
    words, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for lo, _, word, bucket in p.subwords():
        at = number[bucket]
        words.append((word[at >= 0] + lo).astype(np.int32))
        rows.append(at[at >= 0])
    return live, (np.concatenate(words), np.concatenate(rows), many)


class ToxicityModel:
    """Scores lists of normalised texts; ``state`` holds one number per bucket, the bias, and the score without a class."""

    def __init__(self, state: dict):
        self.state, self.powers = state, Powers()

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.state["values"] is None:
            return np.full(len(texts), self.state["prior"])
        p = Passages(texts, self.powers)
        return _sigmoid(p.highest(p.logits(p.word_values(self.state["values"]))) + self.state["bias"])


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Up to ``rows`` distinct (toxic, text) per class, in the order of a hash of doc_id.

    Rows with a null doc_id, label or text, and texts above SAMPLE_TEXT_BYTES, teach nothing; a doc_id with both labels
    counts as toxic. Only the classes' counts reach the driver.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = documents.where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).select("doc_id", F.xxhash64("doc_id").alias("order"))
    below = F.lit(False)
    for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect():
        bound = int(-(2**63) + min(1.0, SPARE * rows / r["n"]) * (2**64 - 1))
        below = below | ((F.col("toxic") == r["toxic"]) & (F.col("order") <= F.lit(min(bound, 2**63 - 1))))
    ranked = Window.partitionBy("toxic").orderBy("order", "doc_id")
    chosen = short.join(marked, "doc_id").where(below).withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= rows)
    return (
        documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic").distinct()), "doc_id")  # at most 2 x rows
        .where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
        .select("toxic", "text").distinct()
    )


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state, as one row, from all rows of a sample."""
    sample = sorted({x for b in batches for x in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True)})
    share = sum(k for k, _ in sample) / len(sample) if sample else 0.5
    texts = normalised(pa.array([t for _, t in sample], pa.string()))
    taken, used = [], {0: 0, 1: 0}
    for (k, _), t in zip(sample, texts, strict=True):
        used[k] += len(t)
        if t.strip() and used[k] <= SAMPLE_BYTES:
            taken.append((k, t))
    values, bias = None, 0.0
    if len({k for k, _ in taken}) == 2:
        model = train(taken)
        contrast = model["softmax"][:, 1] - model["softmax"][:, 0]
        values, bias = (model["table"] @ contrast).astype("<f4").tobytes(), model["bias"]
    yield pa.RecordBatch.from_arrays(
        [pa.array([values], pa.binary()), pa.array([bias]), pa.array([float(share)])], names=["values", "bias", "prior"]
    )


def learn_toxicity(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Train on a sample of the labelled rows, in one task; the state that reaches the driver has a fixed size.

    Without texts of both classes, every score is the share of toxic labels (one half without any).
    """
    sample = labelled_sample(documents, labels, rows)
    found = sample.repartition(1).mapInArrow(_fit, "values binary, bias double, prior double").collect()
    if not found:
        return {"values": None, "bias": 0.0, "prior": 0.5}
    values = found[0]["values"]
    return {"values": None if values is None else np.frombuffer(values, "<f4"), "bias": found[0]["bias"], "prior": found[0]["prior"]}


def score_toxicity(documents: DataFrame, state: dict, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: toxic likelier) to every row.

    Only the text is looked at; null counts as empty, and a text without a word gets the score of the bias
    alone. An existing column named score is replaced. Narrow: no shuffle; the state (a fixed size) is
    broadcast. Words of a slice of text are scored once each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(state)
    rows = documents.drop("score")
    schema = T.StructType(list(rows.schema.fields)).add("score", "double")
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(shared.value)
        for b in slices(batches, text):
            score = model.score(normalised(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    return rows.mapInArrow(run, schema)
