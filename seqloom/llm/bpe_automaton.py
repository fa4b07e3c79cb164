"""Byte-level BPE as a deterministic automaton over token labels.

The automaton accepts exactly the correct token sequences. It starts as one
state with an arc per byte. Each merge rule ``(u, v)`` adds one merge gadget:

* the target ``p`` of the ``u`` arcs is copied without its ``v`` arc, and the
  ``u`` arcs now lead to the copy: ``u`` can no longer be followed by ``v``;
* every state with a ``u`` arc gets an arc ``uv`` to where ``v`` led from ``p``.

All arcs with one label lead to one state, so a transition is
``target[label]`` if the state has the arc. States form a tree of copies, each
lacking one label of its origin, which gives the transition table in linear
space: a label made after a state was copied is present where its left half
is; an older one is present where it is in the state's origin, unless it is the
one taken out. Looked-up transitions are kept in a table.

A word is encoded by running the automaton over its bytes: from each reached
position, every label that spells the next bytes and has an arc reaches a later
position. Each prefix has one correct token sequence, so each position is
reached once and the last one gives the ids. Decoding emits the arc labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_batches import slices
from .worker_cache import kept

# The published pattern that splits text before byte-level merges (white space as Unicode's White_Space).
_WS = r"\t-\r \x85\xa0  -     　"
PRE_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Entries of a worker's memo of pre-split words; further words are encoded each time they come.
MEMO_WORDS = 400_000


def byte_characters() -> dict[str, int]:
    """Character that stands for each byte in vocabulary files: printable Latin-1 itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_tokenizer(path: str) -> dict:
    """Vocabulary, merges and added tokens of a byte-level BPE file of the tokenizers library, as plain data."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or spec.get("normalizer") or split.get("add_prefix_space"):
        raise ValueError("only byte-level BPE without normalizer and prefix space")
    added = {}
    for t in spec.get("added_tokens", []):
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError("added tokens that take in neighbouring text are not supported")
        added[t["content"]] = t["id"]
    of = byte_characters()
    spell = lambda token: bytes(of[c] for c in token)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {
        "bytes": [model["vocab"][c] for c, b in sorted(of.items(), key=lambda x: x[1])],
        "merges": [(spell(u), spell(v)) for u, v in pairs],
        "ids": {spell(t): i for t, i in model["vocab"].items() if t not in added},
        "added": added,
    }


class MergeAutomaton:
    """The automaton of a tokenizer; ``encode_word`` and ``spell`` run it."""

    def __init__(self, spec: dict):
        self.labels: list[bytes] = [bytes([b]) for b in range(256)]
        self.ids: list[int] = list(spec["bytes"])
        self.left, self.made, self.target = [-1] * 256, [0] * 256, [0] * 256
        self.origin, self.lacks, self.born = [-1], [-1], [0]
        self.by_bytes: dict[bytes, int] = {w: k for k, w in enumerate(self.labels)}
        self._arcs: dict[tuple[int, int], bool] = {}
        for rule, (u, v) in enumerate(spec["merges"], 1):
            a, b = self.by_bytes.get(u), self.by_bytes.get(v)
            if a is not None and b is not None:
                self._merge(rule, a, b, spec["ids"][u + v])
        self.longest = max(map(len, self.labels))
        self.prefixes = {w[:n] for w in self.labels for n in range(1, len(w) + 1)}

    def _merge(self, rule: int, u: int, v: int, token_id: int) -> None:
        p = self.target[u]
        word = self.labels[u] + self.labels[v]
        if not self._has(p, v):
            return  # the pair cannot stand side by side any more
        if word in self.by_bytes:
            raise ValueError(f"two merges make the token {word!r}")
        self.by_bytes[word] = len(self.labels)
        self.labels.append(word)
        self.ids.append(token_id)
        self.left.append(u)
        self.made.append(rule)
        self.target.append(self.target[v])
        self.target[u] = len(self.origin)
        self.origin.append(p)
        self.lacks.append(v)
        self.born.append(rule)

    def _has(self, state: int, label: int) -> bool:
        origin, lacks, born, left, made = self.origin, self.lacks, self.born, self.left, self.made
        while state:
            if made[label] >= born[state]:
                label = left[label]
            elif lacks[state] == label:
                return False
            else:
                state = origin[state]
        return True

    def has_arc(self, state: int, label: int) -> bool:
        key = (state, label)
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) >= 2_000_000:
                self._arcs.clear()
            found = self._arcs[key] = self._has(state, label)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of the one path through the automaton that spells ``word``; time grows with the word's length."""
        n = len(word)
        state: list[int] = [-1] * (n + 1)
        came: list[int] = [-1] * (n + 1)
        state[0] = 0
        by_bytes, prefixes, target = self.by_bytes, self.prefixes, self.target
        for i in range(n):
            s = state[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = word[i:j]
                if piece not in prefixes:
                    break
                if state[j] < 0:
                    label = by_bytes.get(piece)
                    if label is not None and (s == 0 or self.has_arc(s, label)):
                        state[j], came[j] = target[label], label
        out = []
        while n:
            out.append(self.ids[came[n]])
            n -= len(self.labels[came[n]])
        return out[::-1]


class _Pieces(dict):
    """What stands between two single blanks (with the blank before it) -> packed ids; None if white space touches its ends."""

    def __init__(self, codec: "Codec"):
        self.codec = codec

    def __missing__(self, piece: str):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        value = self.codec.split_and_encode(" " + piece)
        if "\n" not in piece and len(self) < MEMO_WORDS and len(piece) < 100:
            self[piece] = value
        return value


class Codec:
    """Whole-text encoding to packed ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, spec: dict):
        self.automaton = MergeAutomaton(spec)
        self.pre_split = regex.compile(PRE_SPLIT)
        self.added = {text: int(i).to_bytes(4, "little") for text, i in spec["added"].items()}
        self.at_added = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        )
        self.words: dict[str, bytes] = {}
        self.pieces = _Pieces(self)
        self.spelling = dict(zip(self.automaton.ids, self.automaton.labels, strict=True))
        self.spelling |= {i: t.encode() for t, i in spec["added"].items()}

    def word(self, word: str) -> bytes:
        packed = self.words.get(word)
        if packed is None:
            packed = np.array(self.encode_word(word.encode()), "<u4").tobytes()
            if len(self.words) < MEMO_WORDS and len(word) < 100:
                self.words[word] = packed
        return packed

    def encode_word(self, word: bytes) -> list[int]:
        return self.automaton.encode_word(word)

    def split_and_encode(self, text: str) -> bytes:
        return b"".join(map(self.word, self.pre_split.findall(text)))

    def _ordinary(self, text: str) -> bytes:
        """A single blank between other characters always begins a pre-split word, so the text falls apart there."""
        head, *rest = text.split(" ")
        if head and not head[-1].isspace():
            try:
                return self.split_and_encode(head) + b"".join(map(self.pieces.__getitem__, rest))
            except TypeError:  # white space beside a blank
                pass
        return self.split_and_encode(text)

    def encode(self, text: str) -> bytes:
        if self.at_added is None or not any(t in text for t in self.added):
            return self._ordinary(text)
        return b"".join(self.added.get(x) or self._ordinary(x) for x in self.at_added.split(text) if x)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")


def codec_for(path: str, spec: dict) -> Codec:
    return kept(("bpe", path, len(spec["merges"])), lambda: Codec(spec))


def encode_documents(documents: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and ``ids``: each whole text's ids, packed as little-endian unsigned 32-bit integers.

    Strings of added tokens inside a text become their ids, as in the tokenizers library; no other
    special token is added. Null text: empty. One row per input row, also for repeated or null keys;
    other columns are ignored. Narrow; the tokenizer file is read on the driver and broadcast (its
    size is fixed).
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    rows = documents.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    out = rows.drop("__text").schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, shared.value)
        for b in slices(batches, "__text"):
            ids = pa.array([codec.encode(t) for t in b.column("__text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), ids], names=[*keys, "ids"])

    return rows.mapInArrow(run, f"{out},ids:binary")


def decode_documents(encoded: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """``keys`` and ``text``: the decoded text of the packed ``ids`` (null: empty); bytes that are not UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    rows = encoded.select(*keys)
    out = rows.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, shared.value)
        for b in slices(batches, "ids"):
            text = pa.array([codec.decode(x or b"") for x in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), text], names=[*keys, "text"])

    return rows.mapInArrow(run, f"{out},text:string")
