"""Packing along a space-filling curve.

Every document gets a hashed bag-of-words vector, projected to a few dimensions
(the mean of hash-derived numbers over its words). The Hilbert key of the
quantised vector orders the documents by range over all tasks, so that
neighbours on the curve, such as copies and texts in one language, share
sequences. Each task then fills its sequences one after another and cuts
documents at the sequence ends, so only a task's last sequence is short; it is
cut again into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_memo import LibraryTokenizer
from .text_batches import Powers, Words, slices, texts_of
from .worker_cache import kept

SEQUENCE_TOKENS = 1024
DIMENSIONS, BITS = 4, 10
RANGES_PER_PARTITION = 3
#: Coordinates are means of numbers from -1 to 1; beyond this bound they are clipped to the outermost cell.
SPREAD = 0.5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (unsigned coordinates of ``bits`` bits each)."""
    x = cells.T.astype(np.uint64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the largest cube to the smallest
        p = np.uint64(q - 1)
        for i in range(dims):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, np.uint64(0)) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def document_cells(texts: list[bytes], powers: Powers, dims: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Quantised projections of the texts (A-Z lower-cased); a text without words lies in the middle."""
    w = Words([t.lower() for t in texts], powers)
    n = np.maximum(w.counts, 1)
    cells = np.empty((len(texts), dims), np.uint64)
    for d in range(dims):
        number = ((w.hashes >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) / 32767.5 - 1.0
        mean = np.bincount(w.rows, weights=number, minlength=len(texts)) / n
        scaled = (mean / SPREAD + 1.0) / 2.0 * (1 << bits)
        cells[:, d] = np.clip(scaled, 0, (1 << bits) - 1).astype(np.uint64)
    return cells


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Packer:
    """Fills sequences in order; holds the pieces of the open sequence (at most ``size`` tokens)."""

    def __init__(self, first_id: int, size: int):
        self.sequence, self.size, self.fill = first_id, size, 0
        self.open: list[tuple] = []  # (doc_id, start, doc_tokens, ids)
        self.done: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            n = min(self.size - self.fill, total - at)
            self.open.append((doc_id, at, total, ids[at : at + n]))
            self.fill += n
            at += n
            if self.fill == self.size:
                self._close(self.open)
                self.open, self.fill = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.done.append((doc_id, start, len(ids), total, self.sequence, offset, ids.tobytes()))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """Cut what is left into sequences whose lengths are powers of two."""
        rest, left = self.open, self.fill
        self.open, self.fill = [], 0
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            part: list[tuple] = []
            while want:
                doc_id, start, total, ids = rest.pop(0)
                if len(ids) > want:
                    rest.insert(0, (doc_id, start + want, total, ids[want:]))
                    ids = ids[:want]
                part.append((doc_id, start, total, ids))
                want -= len(ids)
            self._close(part)

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.done, strict=True)) or [[]] * 7
        self.done = []
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
            names=[x.split()[0] for x in PIECES.split(", ")],
        )


def pack_documents(
    documents: DataFrame, tokenizer_path: str, size: int = SEQUENCE_TOKENS, end_id: int = 0, partitions: int | None = None
) -> DataFrame:
    """Pieces of packed sequences: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    A document's tokens are its whole text's ids (no special tokens added) and ``end_id``; each token
    lies in one piece. ``ids`` are little-endian unsigned 32-bit integers. Sequences hold ``size``
    tokens, except those cut from the end of a task's range, whose lengths are powers of two; there
    is no padding. Null text: empty (one token). Repeated rows and ids are packed each for itself.
    Other columns are ignored. An empty table gives no rows.

    One shuffle, by range of (key, doc_id): equal keys, as of copies, are split by doc_id. The range
    bounds need a first pass over the texts, for the vectors only. The tokenizer file is broadcast (fixed size).
    """
    spark = documents.sparkSession
    # long texts lie close together on the curve, so ranges of equal row numbers differ in bytes: cut finer
    n = partitions or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in slices(batches, "text"):
            key = hilbert_keys(document_cells(texts_of(b.column("text")), powers), BITS)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("doc_id"), b.column("text")], names=["key", "doc_id", "text"])

    along = (
        rows.mapInArrow(keyed, "key long, doc_id long, text string")
        .repartitionByRange(n, "key", "doc_id")
        .sortWithinPartitions("key", "doc_id", "text")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept(("tokenizer", tokenizer_path, len(shared.value)), lambda: LibraryTokenizer(shared.value))
        packer = _Packer(TaskContext.get().partitionId() << 40, size)
        for b in slices(batches, "text"):
            encoded = tokenizer.encode_batch(b.column("text").to_pylist())
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoded, strict=True):
                packer.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4"))
            yield packer.take()
        packer.finish()
        yield packer.take()

    return along.mapInArrow(pack, PIECES)
