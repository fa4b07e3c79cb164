"""Shared pieces of the text operators: Arrow slices of bounded size, words and hashes.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` in UTF-8 bytes; ``bytes.lower``
changes A-Z only. Word hashes are 64-bit polynomial hashes over a fixed table of
random numbers, one per byte value; equality of 64-bit hashes (of words or of
word windows) is taken as equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_NUMBERS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        ends = np.cumsum(size)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


class Words:
    """The words of several texts: ``hashes``, ``starts`` and ``ends`` (in ``joined``), ``counts`` and ``rows`` (text numbers)."""

    def __init__(self, texts: list[bytes], powers: "Powers"):
        n = len(texts)
        self.joined = b" ".join(texts)
        self.buf = np.frombuffer(self.joined, np.uint8)
        self.offsets = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1, out=self.offsets[1:])
        self.blank = _BLANK[self.buf]
        edge = np.ones(len(self.buf) + 2, bool)
        edge[1:-1] = self.blank
        change = np.flatnonzero(edge[1:] != edge[:-1])
        self.starts, self.ends = change[0::2], change[1::2]
        first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(first)
        self.rows = np.repeat(np.arange(n), self.counts)
        up, down = powers.upto(len(self.buf))
        prefix = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(BYTE_NUMBERS[self.buf] * up[: len(self.buf)], out=prefix[1:])
        self.hashes = mix64((prefix[self.ends] - prefix[self.starts]) * down[self.starts])

    def word(self, k: int) -> bytes:
        return self.joined[self.starts[k] : self.ends[k]]


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown as needed (once per task)."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE_INVERSE, k, 1 << 64))])
        return self.up, self.down


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of every window of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h *= _STEP
        h += words[k : k + n]
    return h


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class HeldCounts:
    """Counts by key that a task adds up before handing them on; holds about ``limit`` distinct keys at most."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.parts, self.n = limit, [], 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Count every key once more; returns counts to hand on when there are too many."""
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.parts.append((keys[first], np.diff(np.append(first, len(keys)))))
        self.n += len(first)
        if self.n <= 2 * self.limit:
            return None
        held = self._merged()
        if len(held[0]) > self.limit:
            self.parts, self.n = [], 0
            return held
        self.parts, self.n = [held], len(held[0])
        return None

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return add_up(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        out = self._merged() if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.n = [], 0
        return out
