"""Quality rules with repetition coverage (rolling hashes over Arrow slices in numpy).

For every text: words, symbols, repeated lines, and for several n-gram lengths
the share of word characters (code points) that lie inside an n-gram occurring
more than once in the text. A rolling window hash names every n-gram; one sort
per length over a whole slice of texts finds the repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_batches import Powers, Words, mix64, slices, texts_of, window_hashes

#: Largest share of word characters inside repeated n-grams, by n-gram length in words. Every
#: occurrence counts, the first too, so one line said twice in a text of 60 words covers up to 0.28.
DUP_NGRAM_SHARE = {5: 0.40, 8: 0.36, 10: 0.32}
#: Largest share of a text's word characters inside lines that repeat an earlier line.
DUP_LINE_SHARE = 0.25
#: Largest number of symbols ``# * $ % & | < >`` per word.
SYMBOLS_PER_WORD = 0.10
BASE_MIN_WORDS = 50
BASE_REPEAT_PERCENT = 50
BASE_WINDOW = 3
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, dup_ngram_chars array<long>, base_failed boolean, kept boolean"
)


def repeated_windows(hashes: np.ndarray, rows: np.ndarray, salt: np.ndarray, width: int) -> np.ndarray:
    """Per word: does it lie in a window of ``width`` words that occurs at least twice in its own text?

    ``rows`` holds the text number of every word and ``salt`` a number per word that tells texts
    apart. Windows across texts do not count.
    """
    n = len(hashes)
    covered = np.zeros(n, bool)
    h = window_hashes(hashes, width)
    if not len(h):
        return covered
    starts = np.flatnonzero(rows[: len(h)] == rows[width - 1 :])
    keys = h[starts] + salt[starts]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return covered
    maybe = np.zeros(1 << 16, bool)
    maybe[twice >> np.uint64(48)] = True
    likely = np.flatnonzero(maybe[keys >> np.uint64(48)])
    at = np.searchsorted(twice, keys[likely])
    at[at == len(twice)] = 0
    found = starts[likely[twice[at] == keys[likely]]]
    for k in range(width):
        covered[found + k] = True
    return covered


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their word characters."""
    lines = text.split(b"\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0, 0
    seen: set[bytes] = set()
    n = chars = 0
    for line in lines:
        if line in seen:
            n += 1
            chars += sum(len(w.decode()) for w in line.split())
        elif line.strip():
            seen.add(line)
    return n, chars


def measure(texts: list[bytes], powers: Powers, widths: list[int]) -> dict[str, np.ndarray]:
    """Measures of each text, as arrays in the order of ``texts``."""
    count = len(texts)
    w = Words(texts, powers)
    points = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(~w.blank & ((w.buf & 0xC0) != 0x80), out=points[1:])  # code points of words so far
    word_len = points[w.ends] - points[w.starts]
    ends = np.minimum(w.offsets[1:] - 1, len(w.buf))
    symbol = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(_SYMBOL[w.buf], out=symbol[1:])
    salt = np.repeat(mix64(np.arange(1, count + 1, dtype=np.uint64)), w.counts)

    def inside(width: int, weights=None) -> np.ndarray:
        hit = repeated_windows(w.hashes, w.rows, salt, width)
        return np.bincount(w.rows[hit], weights=None if weights is None else weights[hit], minlength=count).astype(np.int64)

    lines = [_dup_lines(t) for t in texts]
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": points[ends] - points[w.offsets[:-1]],
        "n_symbols": symbol[ends] - symbol[w.offsets[:-1]],
        "n_dup_lines": np.array([x for x, _ in lines], np.int64),
        "dup_line_chars": np.array([x for _, x in lines], np.int64),
        "n_repeat_words": inside(BASE_WINDOW),
        "dup_ngram_chars": np.stack([inside(n, word_len) for n in widths], axis=1)
        if widths else np.zeros((count, 0), np.int64),
    }


def repetition_rules(
    documents: DataFrame,
    ngram_share: dict[int, float] = DUP_NGRAM_SHARE,
    line_share: float = DUP_LINE_SHARE,
    symbols_per_word: float = SYMBOLS_PER_WORD,
) -> DataFrame:
    """Measures and verdict per document: ``doc_id``, counts, ``base_failed``, ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    ``kept`` is false for these, and where word characters inside repeated n-grams, repeated lines
    or symbols exceed their shares. Null text counts as empty (no words: base fails). One row per
    input row, also for repeated or null doc_ids; other columns are ignored. Narrow: no shuffle.
    """
    widths = list(ngram_share)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in slices(batches, "text"):
            m = measure(texts_of(b.column("text")), powers, widths)
            failed, kept = verdicts(m, list(ngram_share.values()), line_share, symbols_per_word)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
            ngrams = pa.ListArray.from_arrays(
                pa.array(np.arange(len(kept) + 1, dtype=np.int32) * len(widths)), pa.array(m["dup_ngram_chars"].ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(m[n]) for n in names), ngrams, pa.array(failed), pa.array(kept)],
                names=["doc_id", *names, "dup_ngram_chars", "base_failed", "kept"],
            )

    return rows.mapInArrow(run, SCHEMA)


def verdicts(m: dict[str, np.ndarray], limits: list[float], line_share: float, symbols_per_word: float):
    """(base_failed, kept) from the measures."""
    words, chars = m["n_words"], np.maximum(m["word_chars"], 1)
    failed = (words < BASE_MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * words)
    kept = ~failed & (m["dup_line_chars"] <= line_share * chars) & (m["n_symbols"] <= symbols_per_word * words)
    for k, limit in enumerate(limits):
        kept &= m["dup_ngram_chars"][:, k] <= limit * chars
    return failed, kept


def keep_documents(
    documents: DataFrame,
    text: str = "text",
    ngram_share: dict[int, float] = DUP_NGRAM_SHARE,
    line_share: float = DUP_LINE_SHARE,
    symbols_per_word: float = SYMBOLS_PER_WORD,
) -> DataFrame:
    """The rows of ``documents``, with all their columns, that ``repetition_rules`` keeps. Narrow: no shuffle."""
    widths, limits = list(ngram_share), list(ngram_share.values())
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in slices(batches, text):
            kept = verdicts(measure(texts_of(b.column(at)), powers, widths), limits, line_share, symbols_per_word)[1]
            yield b.filter(pa.array(kept))

    return documents.mapInArrow(run, documents.schema)
