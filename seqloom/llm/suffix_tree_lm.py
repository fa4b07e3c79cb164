"""Language-model scoring by a probabilistic suffix tree over words.

A context is the sequence of the last words, up to ``DEPTH``; any word and the start of a text
may stand in it. A context becomes a node of the tree if it occurs ``MIN_COUNT`` times (an
absolute number, so the tree grows with the texts) and passes a divergence test: its distribution
of next words must differ from that of the context without its oldest word
by more than a penalty for its parameters, ``sum n ln(P/P_parent) > distinct/2 * ln N``; a
node's parent is a node. The distribution of a node is smoothed towards its parent's (weight: its
number of distinct next words), the root's by adding one. A token is scored at the longest
context that is a node. Where not even the last word is a node, a small tree over classes scores:
symbols are the ``SYMBOLS`` most frequent words, one symbol for any other word, and the end of
a text, and its contexts are up to two symbols with a share of all tokens. A word without a symbol
of its own gets there the probability of the symbol for other words times its own smoothed share.

Nodes stay in a table of additive terms. With ``P = (n + D P_parent) / (N + D)`` the log probability at the
longest node is the unigram's, plus ``log(D / (N + D))`` of every node passed on the way, plus
a term of every (node, next word) seen in the texts. So a text's score is a sum over keys, and keys
that are no term add nothing. The ``HOT`` most frequent terms are broadcast (fixed size), all others are joined.

Word counts are complete: each word of the learning texts is counted. The counts of
the ``FREQUENT`` most frequent words are broadcast (fixed size); all other words are
joined with the table of counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, scratch_path, shuffles_freed
from .text_batches import HeldCounts, Powers, Words, mix64, slices, texts_of

SYMBOLS = 254
OTHER, END = 254, 255
FREQUENT = 1 << 18
#: Smallest share of all tokens that a context of symbols must have; so the tree over symbols has at most 2 / MIN_SHARE + 1 nodes.
MIN_SHARE = 2e-4
#: Longest context in words, and how often a context of words must occur.
DEPTH, MIN_COUNT = 3, 1024
#: Terms of the word tree that are broadcast.
HOT = 1 << 21
#: Bits of the tables that rule out keys before they are counted or joined: 64 a key, within these bounds (16 MB at most).
FILTER_BITS = 16, 27
#: Bytes of text that are scored at once.
SCORED_BYTES = 1 << 19
#: Rows of counted pairs that a task hands on at once.
HANDED = 1 << 17
#: Stands before and after every text in the sequence of word hashes.
EDGE = 0x5851F42D4C957F2D


def pair_key(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    """Key of a window of words from the keys of the windows without its newest and without its oldest word."""
    return mix64(older * np.uint64(0xD1342543DE82EF95) + newer)
#: Factor of the penalty in the divergence test.
PENALTY = 1.0


class WordIndex:
    """Position of word hashes in a sorted list, -1 for those not in it."""

    def __init__(self, hashes: np.ndarray):
        bits = min(max((4 * len(hashes)).bit_length(), 10), 22)  # two buckets a hash at least, up to 16 MB of them
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.starts = np.full((1 << bits) + 1, len(hashes), np.int32)
        part = min(1 << bits, 1 << 18)
        for k in range(0, 1 << bits, part):
            self.starts[k : k + part] = np.searchsorted(hashes, np.arange(k, k + part, dtype=np.uint64) << self.shift)

    def find(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        bucket = (words >> self.shift).astype(np.int64)
        at, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            pos = at[open_]
            same = self.hashes[pos] == words[open_]
            out[open_[same]] = pos[same]
            at[open_] += 1
            open_ = open_[~same & (pos + 1 < end[open_])]
        return out


def _pairs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``h, n``: hash of every word (A-Z lower-cased) and its number of occurrences. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), HeldCounts()
        for b in slices(batches, text):
            full = held.add(Words([t.lower() for t in texts_of(b.column(text))], powers).hashes)
            if full is not None:
                yield _pairs(*full)
        yield _pairs(*held.rest())

    rows = documents.select(F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _symbols(w: Words, index: WordIndex, symbol: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token of every text (its words, then the end): text number, symbol, the two symbols before; and the found positions of the words."""
    found = index.find(w.hashes)
    of_word = symbol[found]
    first = np.cumsum(w.counts + 1) - (w.counts + 1)
    total = int(len(w.hashes) + n_texts)
    sym = np.full(total, END, np.int64)
    words_at = np.arange(len(w.hashes)) + w.rows
    sym[words_at] = of_word
    a, b = np.full(total, END, np.int64), np.full(total, END, np.int64)
    a[1:], b[2:] = sym[:-1], sym[:-2]
    if n_texts:
        a[first] = END
        b[first] = END
        second = first[w.counts >= 1] + 1
        b[second] = END
    rows = np.repeat(np.arange(n_texts), w.counts + 1)
    return rows, sym, a, b, found


def context_counts(documents: DataFrame, frequent: dict, text: str = "text") -> DataFrame:
    """``h, n``: occurrences of (older symbol, last symbol, next symbol), packed into 24 bits."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), HeldCounts()
        index, symbol = WordIndex(shared.value["hash"]), shared.value["symbol"]
        for b in slices(batches, text):
            texts = [t.lower() for t in texts_of(b.column(text))]
            _, x, last, older, _ = _symbols(Words(texts, powers), index, symbol, len(texts))
            full = held.add((older << 16 | last << 8 | x).astype(np.uint64))
            if full is not None:
                yield _pairs(*full)
        yield _pairs(*held.rest())

    rows = documents.select(F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def key_filter(keys: DataFrame) -> np.ndarray | None:
    """Bit table over the 64-bit keys ``h``, as words of 32 bits (a power of two of them); None without a key."""
    n = keys.count()
    if not n:
        return None
    bits = min(max(math.ceil(math.log2(64 * n)), FILTER_BITS[0]), FILTER_BITS[1])
    at = F.col("h").bitwiseAND((1 << bits) - 1)
    found = (
        keys.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 AS INT)))").alias("set")).toArrow()  # at most 2^22 rows
    )
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[found.column("w").to_numpy()] = found.column("set").to_numpy().astype(np.uint32)
    return words


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether ``key_filter`` may have seen the keys; never false for one that it has."""
    at = keys & np.uint64(32 * len(table) - 1)
    return (table[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)


class _Contexts:
    """Keys of the contexts before every token (the words of every text, then its end)."""

    def __init__(self, w: Words, n_texts: int, depth: int):
        total = len(w.hashes) + n_texts * (depth + 1)
        self.seq = np.full(total, EDGE, np.uint64)
        self.seq[np.arange(len(w.hashes)) + w.rows * (depth + 1) + depth] = w.hashes
        tokens = np.repeat(np.arange(n_texts), w.counts + 1)
        self.at = np.arange(len(tokens)) + (tokens + 1) * depth
        self.keys = [self.seq]

    def windows(self, width: int, back: int, use: np.ndarray) -> np.ndarray:
        """Key of the ``width`` words from ``back`` words before the tokens ``use``."""
        while len(self.keys) < width:
            self.keys.append(pair_key(self.keys[-1][:-1], self.keys[-1][1:]))
        return self.keys[width - 1][self.at[use] - back]


def _with_key(pairs: DataFrame) -> DataFrame:
    """``pairs`` with their key ``e``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = pair_key(*(b.column(c).to_numpy().view(np.uint64) for c in ("s", "pe")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e.view(np.int64))], names=[*b.schema.names, "e"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("e", T.LongType())]))


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counted pairs ``s, pe, n`` put together, each pair once; empties ``parts``. Their key follows from them and is not kept."""
    s, pe, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    parts.clear()
    e = pair_key(s, pe)
    order = np.argsort(e)
    e = e[order]
    first = np.flatnonzero(np.append(True, e[1:] != e[:-1])[: len(e)])
    del e
    n = n[order]
    n = np.add.reduceat(n, first) if len(first) else n
    at = order[first]
    del order, first
    return s[at], pe[at], n


def _handed_on(s: np.ndarray, pe: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs in batches of ``HANDED`` rows: a batch is held by the task and by Spark at the same time."""
    for k in range(0, max(len(s), 1), HANDED):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + HANDED].view(np.int64)) for x in (s, pe, n)], names=["s", "pe", "n"])


def pair_counts(documents: DataFrame, level: int, depth: int, shared, text: str = "text") -> DataFrame:
    """``s, pe, n``: occurrences of every (context of ``level`` words, next word), for contexts that the broadcast table lets through.

    ``s`` is the key of the context, ``pe`` of the pair without the oldest word (for one word: the next word's hash).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, allowed, parts, held = Powers(), shared.value, [], 0
        for b in slices(batches, text):
            texts = [t.lower() for t in texts_of(b.column(text))]
            c = _Contexts(Words(texts, powers), len(texts), depth)
            every = np.arange(len(c.at))
            s = c.windows(level, level, every)
            use = np.flatnonzero(may_hold(allowed, s))
            parts.append(_merged([(s[use], c.windows(level, level - 1, use), np.ones(len(use), np.int64))]))
            held += len(parts[-1][0])
            if held > 2_000_000:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > 1_250_000:
                    yield from _handed_on(*parts[0])
                    parts, held = [], 0
        if parts:
            yield from _handed_on(*_merged(parts))

    rows = documents.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "s long, pe long, n long")
    return rows.groupBy("s", "pe").agg(F.sum("n").alias("n"))


def word_tree(
    documents: DataFrame, counts: DataFrame, n_texts: int, norm: float, text: str, depth: int, min_count: int, penalty: float
) -> DataFrame | None:
    """Terms ``h, n, v, node`` of the nodes over words (key, occurrences, log10 value, the node's own term); None without any context.

    A context occurs as often as the pair that it is made of, so the pairs counted at one level say
    which contexts the next level has. Counts of contexts, tests and smoothing are Spark aggregates and joins.
    """
    spark = documents.sparkSession
    written: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "tree")
        df.write.parquet(path)
        written.append(path)
        return spark.read.parquet(path)

    def release(paths: list[str]) -> None:
        """Delete tables that nothing reads any more."""
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            written.remove(path)

    # a row made by Spark: one from the driver's Python would start Python workers of another kind
    edge = spark.range(1).select(F.lit(EDGE).cast("long").alias("h"), F.lit(n_texts).cast("long").alias("n"))
    words = counts.select("h", "n").unionByName(edge)
    often = words.where(F.col("n") >= min_count).select("h")
    parent = words.select(F.col("h").alias("pe"), ((F.col("n") + 1) / F.lit(norm)).alias("q"), F.lit(None).cast("long").alias("ps"))
    p = (F.col("n") + F.col("d") * F.col("q")) / (F.col("whole") + F.col("d"))
    levels = []
    for level in range(1, depth + 1):
        often = kept(often)
        allowed = key_filter(often)
        if allowed is None:
            break
        shared = spark.sparkContext.broadcast(allowed)
        pairs = pair_counts(documents, level, depth, shared, text)
        stored = kept(pairs.join(parent, "pe").select("s", "pe", "ps", "n", "q"))
        shared.unpersist()
        # sum n ln(n / whole / q), with the part of whole taken out: the pairs are added up without a join
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("q")))
        log_whole = F.log(F.col("whole").cast("double"))
        tests = kept(
            stored.groupBy("s").agg(F.first("ps").alias("ps"), F.sum("n").alias("whole"), F.count("*").alias("d"), gain.alias("gain"))
            .where(F.col("whole") >= min_count)
            .withColumn("passed", F.col("gain") - F.col("whole") * log_whole > F.lit(penalty / 2) * F.col("d") * log_whole)
            .drop("gain")
        )
        levels.append((stored, tests))
        often = _with_key(stored.where(F.col("n") >= min_count).select("s", "pe")).select(F.col("e").alias("h"))
        full = stored.join(tests.select("s", "whole", "d"), "s").withColumn("p", p)
        parent = _with_key(full.select("s", "pe", "p")).select(F.col("e").alias("pe"), F.col("p").alias("q"), F.col("s").alias("ps"))
    terms, below = None, None
    for stored, tests in reversed(levels):
        nodes = kept(tests.where("passed") if below is None else tests.join(
            below.select(F.col("ps").alias("s"), F.lit(True).alias("child")).distinct(), "s", "left"
        ).where("passed OR child"))
        weight = F.log10(F.col("d") / (F.col("whole") + F.col("d")))
        own = nodes.select(F.bitwise_not("s").alias("h"), F.col("whole").alias("n"), weight.alias("v"), F.lit(True).alias("node"))
        value = (F.log10(p) - F.log10("q") - weight).alias("v")
        seen = _with_key(stored.join(nodes.select("s", "whole", "d"), "s").select("s", "pe", "n", value)).select(F.col("e").alias("h"), "n", "v", F.lit(False).alias("node"))
        terms = own.unionByName(seen) if terms is None else terms.unionByName(own).unionByName(seen)
        below = nodes
    if terms is None:
        return None
    steps = list(written)
    terms = kept(terms)
    release(steps)
    return terms


def _smoothed(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    weight = np.maximum((counts > 0).sum(axis=-1, keepdims=True), 1)
    return (counts + weight * parent) / (counts.sum(axis=-1, keepdims=True) + weight)


def most_frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, by count and then hash; at most ``limit``."""
    found = _top_classes(counts, limit)
    if found is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = found.toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    n = found.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((h, -n))
    return h[order], n[order]


def _top_classes(counts: DataFrame, limit: int) -> DataFrame | None:
    """The rows of the highest classes of counts, at most ``limit``; None if there are no rows.

    A histogram of the counts (at most some 8,000 classes) gives the smallest class of counts that still fits as
    a whole, so no task and no partition hands more than the words chosen to the driver.
    """
    exact = 4096
    level = F.when(F.col("n") <= exact, F.col("n")).otherwise(
        F.lit(exact + 1) + F.floor(F.log2(F.col("n") / exact) * 64)
    ).cast("long")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True)
    total, least = 0, None
    for r in levels:
        total += r["words"]
        if total > limit:
            break
        least = r["level"]
    if not levels or limit < 1:
        return None
    if least is not None:
        return counts.where(level >= least)
    # the highest class alone is too large: a part of it by a hash, as many of its buckets as fit
    bits = math.ceil(math.log2(16 * levels[0]["words"] / limit))
    top = counts.where(level == levels[0]["level"]).withColumn("__at", F.shiftrightunsigned(F.xxhash64("h"), 64 - bits))
    total, upto = 0, 0
    for r in sorted(top.groupBy("__at").agg(F.count("*").alias("words")).collect()):
        total += r["words"]
        if total > limit:
            break
        upto = r["__at"] + 1
    return top.where(F.col("__at") < upto).drop("__at")


class SuffixTree:
    """Learned model: ``counts`` (table of all words), ``terms`` (table of the word tree, or None), and as plain arrays in ``state`` all else."""

    def __init__(self, counts: DataFrame, terms: DataFrame | None, state: dict):
        self.counts, self.terms, self.state = counts, terms, state
        self._shared = None

    def shared(self):
        """The broadcast ``state``."""
        if self._shared is None:
            self._shared = self.counts.sparkSession.sparkContext.broadcast(self.state)
        return self._shared

    def release(self) -> None:
        """Take the broadcast from the executors; it is sent again if it is needed."""
        if self._shared is not None:
            self._shared.unpersist()


def learn(
    documents: DataFrame, text: str = "text", min_share: float = MIN_SHARE, penalty: float = PENALTY, frequent: int = FREQUENT,
    depth: int = DEPTH, min_count: int = MIN_COUNT, hot: int = HOT,
) -> SuffixTree:
    """Learn from every row of ``documents`` (null text: empty, an end only).

    Passes over the texts for words, for contexts of symbols and for each length of a context of words; each shuffles
    sums per key. The driver receives the ``frequent`` most frequent words, at most 2^16 counts of one-symbol contexts, at
    most ``1 / min_share`` two-symbol contexts of up to 256 counts each and the ``hot`` most frequent terms of the word
    tree; none of these grows with the data. The word tree itself does, and stays in a table.
    """
    spark = documents.sparkSession
    checkpoint_dir(spark)
    with shuffles_freed(spark):
        counts = word_counts(documents, text).checkpoint()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_texts = documents.count()
    h, n = most_frequent(counts, frequent)
    order = np.argsort(h)
    rank = np.arange(len(h))
    symbol = np.where(rank < SYMBOLS, rank, OTHER)
    # the last symbol stands for words that were not found (position -1)
    known = {"hash": h[order], "n": n[order], "symbol": np.append(symbol[order], OTHER)}
    words, distinct = int(sums["n"] or 0), int(sums["v"] or 0)
    total = words + n_texts
    state = {
        **known, "total": total, "distinct": distinct + (1 if n_texts else 0), "texts": n_texts,
        "other_total": words - int(n[:SYMBOLS].sum()), "other_distinct": distinct - min(SYMBOLS, len(n)),
    }
    with shuffles_freed(spark):
        triples = context_counts(documents, known, text).select(
            F.shiftright("h", 16).alias("b"), F.shiftright("h", 8).bitwiseAND(255).alias("a"), F.col("h").bitwiseAND(255).alias("x"), "n"
        ).checkpoint()
    one = np.zeros((256, 256))
    for r in triples.groupBy("a", "x").agg(F.sum("n").alias("n")).collect():
        one[r["a"], r["x"]] = r["n"]
    root_counts = one.sum(axis=0)
    root = (root_counts + 1) / (root_counts.sum() + 256)
    first = _smoothed(one, root[None, :])
    size = one.sum(axis=1)
    least = max(2.0, min_share * total)

    def differs(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
        whole = counts.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(counts > 0, counts * np.log(counts / whole[:, None] / parent), 0.0).sum(axis=1)
            return (whole >= least) & (gain > penalty / 2 * (counts > 0).sum(axis=1) * np.log(whole))

    pairs = (
        triples.groupBy("b", "a").agg(F.sum("n").alias("whole"), F.collect_list(F.struct("x", "n")).alias("next"))
        .where(F.col("whole") >= least).select("b", "a", "next").collect()
    )
    two = np.zeros((len(pairs), 256))
    for k, r in enumerate(pairs):
        for x, c in r["next"]:
            two[k, x] = c
    last = np.array([r["a"] for r in pairs], np.int64)
    keep2 = differs(two, first[last]) if len(pairs) else np.zeros(0, bool)
    keep1 = differs(one, np.broadcast_to(root, one.shape)) & (size > 0)
    keep1[last[keep2]] = True  # a node's parent is a node
    node = np.zeros(1 << 16, np.int32)
    table = [root]
    for a in np.flatnonzero(keep1):
        node[np.arange(256) << 8 | a] = len(table)
        table.append(first[a])
    for k in np.flatnonzero(keep2):
        node[pairs[k]["b"] << 8 | pairs[k]["a"]] = len(table)
        table.append(_smoothed(two[k], first[last[k]]))
    state |= {"node": node, "log": np.log10(np.stack(table)), "depth": depth}
    norm = float(state["total"] + state["distinct"] + 1)
    with shuffles_freed(spark):
        terms = word_tree(documents, counts, n_texts, norm, text, depth, min_count, penalty)
        state |= _hot_terms(terms, hot)
    return SuffixTree(counts, terms, state)


def _hot_terms(terms: DataFrame | None, limit: int) -> dict:
    """The most frequent terms as arrays; filters of the keys of pairs (``cold``) and of nodes if some of them are not among these.

    Nodes have a filter of their own: they are few and frequent, and most contexts are no node, so in a full
    table of pairs most of the keys that it wrongly lets through would be theirs.
    """
    top = None if terms is None else _top_classes(terms, limit)
    out = {"hot": np.zeros(0, np.uint64), "value": np.zeros(0), "cold": None, "cold_nodes": None}
    if terms is None:
        return out
    nodes = 0
    if top is not None:
        found = top.select("h", "v", "node").toArrow()
        h, order = (x := found.column("h").to_numpy().view(np.uint64)), np.argsort(x)
        out |= {"hot": h[order], "value": found.column("v").to_numpy()[order]}
        nodes = int(found.column("node").to_numpy().sum())
        del found, h, x, order  # the filters below are collected as well
    every = terms.agg(F.count("*").alias("terms"), F.count_if("node").alias("nodes")).first()
    if every["nodes"] > nodes:
        out["cold_nodes"] = key_filter(terms.where("node").select("h"))
    if every["terms"] - every["nodes"] > len(out["hot"]) - nodes:
        out["cold"] = key_filter(terms.where("NOT node").select("h"))
    return out


def _tree_terms(
    c: _Contexts, of: np.ndarray, by_class: np.ndarray, hot: WordIndex, s: dict
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token the sum of the broadcast terms (``by_class`` without a node); and (text, key, value if no term) to be joined."""
    more = np.zeros(len(of))
    rows, keys, alts = [], [], []

    def later(use: np.ndarray, key: np.ndarray, alt: np.ndarray) -> None:
        rows.append(of[use])
        keys.append(key)
        alts.append(alt)

    use = np.arange(len(of))
    for level in range(1, s["depth"] + 1):
        node = ~c.windows(level, level, use)
        at = hot.find(node)
        here = at >= 0
        more[use[here]] += s["value"][at[here]]
        perhaps = ~here & may_hold(s["cold_nodes"], node) if s["cold_nodes"] is not None else np.zeros(len(use), bool)
        later(use[perhaps], node[perhaps], by_class[use[perhaps]] if level == 1 else np.zeros(int(perhaps.sum())))
        if level == 1:
            none = use[~here & ~perhaps]
            more[none] += by_class[none]
        use = use[here | perhaps]
        pair = c.windows(level + 1, level, use)
        at = hot.find(pair)
        here = at >= 0
        more[use[here]] += s["value"][at[here]]
        if s["cold"] is not None:
            there = ~here & may_hold(s["cold"], pair)
            later(use[there], pair[there], np.zeros(int(there.sum())))
    return more, *(np.concatenate(x) for x in (rows, keys, alts))


def _sums(row: np.ndarray, key: np.ndarray, alt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal (row, key) once: row, key, how often, and the sum of ``alt``."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)])
    m = np.diff(np.append(first, len(row))).astype(np.int64)
    return row[first], key[first], m, np.add.reduceat(alt[order], first) if len(first) else alt


HEAD = T.StructType().add("n_tokens", "long").add("known", "long").add("base", "double").add("score", "double")


def score_texts(
    documents: DataFrame, model: SuffixTree, keys: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``keys, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the tree's. Null text: empty (one
    token, the end). Repeated rows are returned as often as they come; other columns are ignored.

    Words beyond the broadcast ones are joined with the counts by hash and summed per text (two shuffles of
    one narrow row per rare word of a text). Words in the broadcast list cannot be hot keys there.
    """
    rows = documents.select(*keys, F.xxhash64(*keys).alias("__id"), F.col(text).cast("string").alias("__text"))
    shared = model.shared()
    given = [f for f in rows.schema.fields if f.name in keys]
    head = T.StructType([*given, *HEAD.fields])
    schema = T.StructType().add("row", "long").add("h", "long").add("m", "long").add("alt", "double").add("head", head)
    key_names = [f.name for f in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        powers, index, hot = Powers(), WordIndex(s["hash"]), WordIndex(s["hot"])
        base_norm = np.log10(s["total"] + s["distinct"] + 1)
        other_norm = np.log10(s["other_total"] + s["other_distinct"] + 1)
        log_n = np.log10(s["n"] + 1.0)
        end_base = np.log10(s["texts"] + 1.0) - base_norm
        for b in slices(batches, "__text", SCORED_BYTES):
            texts = [t.lower() for t in texts_of(b.column("__text"))]
            n = len(texts)
            w = Words(texts, powers)
            of, x, last, older, found = _symbols(w, index, s["symbol"], n)
            hit = found >= 0
            base = end_base + np.bincount(w.rows[hit], weights=log_n[found[hit]] - base_norm, minlength=n)
            # what the tree over symbols adds to the unigram, where no word context is a node
            by_class = s["log"][s["node"][older << 8 | last], x]
            words_at = np.arange(len(w.hashes)) + w.rows
            own_symbol = s["symbol"][found] != OTHER
            by_class[words_at[own_symbol]] -= log_n[found[own_symbol]] - base_norm
            by_class[words_at[~own_symbol]] -= other_norm - base_norm
            by_class[x == END] -= end_base
            more, tree_row, tree_h, alt = _tree_terms(_Contexts(w, n, s["depth"]), of, by_class, hot, s)
            score = base + np.bincount(of, weights=more, minlength=n)
            known = np.bincount(w.rows[hit], minlength=n) + (1 if s["texts"] else 0)
            # one row per rare word of a text; a text's first row carries what is known so far
            rare_row, rare_h = w.rows[~hit], w.hashes[~hit]
            order = np.lexsort((rare_h, rare_row))
            rare_row, rare_h = rare_row[order], rare_h[order]
            new = np.ones(len(rare_row), bool)
            new[1:] = (rare_row[1:] != rare_row[:-1]) | (rare_h[1:] != rare_h[:-1])
            first = np.flatnonzero(new)
            m = np.diff(np.append(first, len(rare_row)))
            rare_row, rare_h = rare_row[first], rare_h[first]
            none = np.setdiff1d(np.arange(n), rare_row)
            row = np.concatenate([rare_row, none])
            times = np.concatenate([m, np.zeros(len(none), np.int64)])
            own = b.column("__id").to_numpy(zero_copy_only=False).view(np.uint64)
            own = mix64(own ^ np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, n))
            hashes = np.concatenate([rare_h, mix64(own[none])])  # without rare words: a key of its own, times 0
            tree_row, tree_h, tree_m, alt = _sums(tree_row, tree_h, alt)
            lead = np.ones(len(row) + len(tree_row), bool)
            lead[1 : len(rare_row)] = rare_row[1:] != rare_row[:-1]
            lead[len(row) :] = False
            no_alt = np.arange(len(lead)) < len(row)
            alt = np.concatenate([np.zeros(len(row)), alt])
            row, hashes = np.concatenate([row, tree_row]), np.concatenate([hashes, tree_h])
            times = np.concatenate([times, tree_m])
            take = pa.array(np.where(lead, row, 0), mask=~lead)
            parts = [b.column(k).take(take) for k in key_names]
            parts += [
                pa.array(v).take(take)
                for v in (w.counts.astype(np.int64) + 1, known.astype(np.int64), base.astype(float), score.astype(float))
            ]
            names = [*key_names, "n_tokens", "known", "base", "score"]
            heads = pa.StructArray.from_arrays(parts, names=names, mask=pa.array(~lead))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[row].view(np.int64)), pa.array(hashes.view(np.int64)), pa.array(times), pa.array(alt, mask=no_alt), heads],
                names=["row", "h", "m", "alt", "head"],
            )

    # equal keys and text mean repeated rows: they are summed together and divided by their number
    tokens = rows.mapInArrow(run, schema)
    s = model.state
    norm = float(np.log10(s["total"] + s["distinct"] + 1))
    known = model.counts.select("h", F.col("n").alias("c"), F.lit(None).cast("double").alias("v"))
    if s["cold"] is not None or s["cold_nodes"] is not None:  # keys of words and of terms are 64-bit hashes of different things
        known = known.unionByName(model.terms.select("h", F.lit(None).cast("long").alias("c"), "v"))
    # keys are unique in ``known`` and evenly dealt, so a partition of it is small; the tokens need no sort
    joined = tokens.join(known.hint("shuffle_hash"), "h", "left")
    word = F.col("alt").isNull()
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))
    per_text = joined.groupBy("row").agg(
        F.sum(F.when(word & F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("known"),
        F.sum(F.when(word, F.col("m") * (log_c - F.lit(norm))).otherwise(0.0)).alias("base"),
        F.sum(F.when(word, F.col("m") * (log_c - F.lit(norm))).otherwise(F.coalesce(F.col("m") * F.col("v"), "alt"))).alias("score"),
        F.count("head").alias("copies"),
        *[F.first(F.col("head")[f.name], ignorenulls=True).alias(f"one_{f.name}") for f in given],
        # numbers one by one, as an aggregate of structs would sort all tokens by text
        *[F.max(F.col("head")[f.name]).alias(f"one_{f.name}") for f in HEAD.fields],
    )
    each = per_text.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(
        *[F.col(f"`one_{k}`").alias(k) for k in key_names],
        F.col("one_n_tokens").alias("n_tokens"),
        (F.col("one_known") + F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(int(s["total"])).cast("long").alias("train_tokens"),
        (F.col("one_base") + F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("one_score") + F.col("score") / F.col("copies")).alias("score"),
    )

