"""Byte-level BPE encoding of whole texts behind a memo of their pieces.

With byte-level pre-splitting, a single blank or line feed between two other characters that
are not white space always begins a pre-split word, so a text's ids are the ids of its
pieces, each with the blank or line feed before it. Pieces repeat, texts do not: pieces
are looked up by their 64-bit hash in arrays, new ones are encoded once per worker, and texts
where the rule does not hold (other white space beside a blank or line feed) are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from .text_batches import BYTE_NUMBERS, Powers, mix64

#: Pieces that a worker remembers before it starts again (about 40 bytes each).
MEMO_PIECES = 2_000_000
Encoder = Callable[[list[str]], list[bytes]]


class HashTable:
    """Open addressing from unsigned 64-bit hashes to consecutive numbers, on whole arrays."""

    def __init__(self, bits: int = 18):
        self.keys, self.values, self.n = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, np.int64)
        slot = hashes & mask
        open_ = np.arange(len(hashes))
        while len(open_):
            at = slot[open_].astype(np.int64)
            value = self.values[at]
            hit = (value >= 0) & (self.keys[at] == hashes[open_])
            out[open_[hit]] = value[hit]
            open_ = open_[(value >= 0) & ~hit]
            slot[open_] = (slot[open_] + np.uint64(1)) & mask
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number new distinct hashes consecutively."""
        if (self.n + len(hashes)) * 2 > len(self.keys):
            used = self.values >= 0
            keys, values = self.keys[used], self.values[used]
            size = len(self.keys)
            while (self.n + len(hashes)) * 2 > size:
                size *= 2
            self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self._put(keys, values)
        self._put(hashes, np.arange(self.n, self.n + len(hashes), dtype=np.int32))
        self.n += len(hashes)

    def _put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = hashes & mask
        open_ = np.arange(len(hashes))
        while len(open_):
            at = slot[open_].astype(np.int64)
            free = self.values[at] < 0
            self.values[at[free]] = values[open_[free]]  # of several, the last one stays
            won = free & (self.values[at] == values[open_])
            self.keys[at[won]] = hashes[open_[won]]
            open_ = open_[~won]
            slot[open_] = (slot[open_] + np.uint64(1)) & mask


class PieceMemo:
    """``encode_batch`` over ``pieces`` (encodes plain pieces) and ``whole`` (encodes any texts)."""

    def __init__(self, pieces: Encoder, whole: Encoder, line_feed: int):
        self.pieces, self.whole, self.line_feed = pieces, whole, line_feed
        self.powers = Powers()
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable()
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        """Remember new pieces; one that is not plain gets the length -1."""
        text = [p.decode() for p in raw]
        plain = [k for k, p in enumerate(text) if _plain(p)]
        packed = self.pieces([text[k] for k in plain])
        length = np.full(len(raw), -1, np.int32)
        length[plain] = [len(p) // 4 for p in packed]
        flat = np.frombuffer(b"".join(packed), "<u4")
        n = self.table.n
        self.table.add(hashes)
        self.start, self.length = _room(self.start, self.table.n), _room(self.length, self.table.n)
        self.ids = _room(self.ids, self.used + len(flat))
        size = np.maximum(length, 0)
        self.start[n : self.table.n] = self.used + np.cumsum(size) - size
        self.length[n : self.table.n] = length
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text as unsigned 32-bit numbers."""
        if self.table.n > MEMO_PIECES:
            self._clear()
        raw = [b"\n" + t.encode() for t in texts]  # as if every text came after a line feed
        joined = b"".join(raw)
        buf = np.frombuffer(joined, np.uint8)
        at = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
        end = np.append(at[1:], len(buf))
        up, down = self.powers.upto(len(buf) + 1)
        prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE_NUMBERS[buf] * up[: len(buf)], out=prefix[1:])
        hashes = mix64((prefix[end] - prefix[at]) * down[at])
        number = self.table.find(hashes)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            new, first = np.unique(hashes[lost], return_index=True)
            spots = lost[first]
            self._learn(new, [joined[a:z] for a, z in zip(at[spots].tolist(), end[spots].tolist(), strict=True)])
            number[lost] = self.table.find(hashes[lost])
        length = self.length[number].astype(np.int64)
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)), out=offsets[1:])
        piece_of = np.searchsorted(at, offsets)  # the first piece of each text
        odd = np.add.reduceat(length < 0, piece_of[:-1]) > 0 if len(raw) else np.zeros(0, bool)
        length = np.maximum(length, 0)
        done = np.cumsum(length)
        total = int(done[-1]) if len(done) else 0
        ids = self.ids[np.repeat(self.start[number] - (done - length), length) + np.arange(total)]
        bounds = np.append(0, done)[piece_of].tolist()
        out = [ids[a + 1 : z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]  # without the line feed before the text
        again = np.flatnonzero(odd).tolist()
        for k, packed in zip(again, self.whole([texts[k] for k in again]), strict=True):
            out[k] = np.frombuffer(packed, "<u4")
        return out


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def _plain(piece: str) -> bool:
    """No white space at the ends, but for the blank or line feed before the first character."""
    return len(piece) > 1 and not piece[1].isspace() and not piece[-1].isspace()


class LibraryTokenizer:
    """The tokenizers library, by pieces where its file allows it."""

    PIECES_PER_CALL = 1000

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(spec)
        split = config.get("pre_tokenizer") or {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not config.get("normalizer") and len(line) == 1
            and not any(
                t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"])
                for t in config.get("added_tokens", [])
            )
        )
        self.memo = PieceMemo(self._pieces, self._whole, line[0]) if by_piece else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Many pieces in one call, as the lines of a text: the line feeds' ids separate their ids."""
        calls = [pieces[k : k + self.PIECES_PER_CALL] for k in range(0, len(pieces), self.PIECES_PER_CALL)]
        out: list[bytes] = []
        for call, packed in zip(calls, self._whole(["".join(p if p[0] == "\n" else "\n" + p for p in c) for c in calls]), strict=True):
            at = (np.flatnonzero(np.frombuffer(packed, "<u4") == self.memo.line_feed) * 4).tolist()
            out += [packed[a if p[0] == "\n" else a + 4 : z] for p, a, z in zip(call, at, [*at[1:], len(packed)], strict=True)]
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, no special tokens added."""
        return self.memo.encode_batch(texts) if self.memo else [np.frombuffer(p, "<u4") for p in self._whole(texts)]
