"""Ranked lexical search over classes of equal bags.

Of a document, a ranking needs only how often it holds each term of the items, and its length
in the form of the number ``m``. Documents that agree in both are one class: they are
hashed and compared, and the class is scored once; its members follow by ascending doc_id.

1. One pass over the texts turns every document into its bag, restricted to the items' vocabulary, and its
   number of terms. The bags are written to the shared folder; the statistics N, L and df are sums over them.
2. Equal (bag, m) are grouped by a 64-bit hash and then by their bytes. A class keeps its ``k`` smallest
   doc_ids, more of which no item can show.
3. Classes are scored in blocks against the items' postings, in 64-bit integers. A task keeps the ``k`` best
   classes of each item; a window takes the best of all tasks, and members are merged by doc_id.

Items are taken in blocks of about ITEM_BYTES of text; each has a pass over the documents of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .text_batches import slices, texts_of
from .worker_cache import kept

#: Text of the items that one pass holds (expected; items are dealt to blocks by a hash, and an item is never cut).
ITEM_BYTES = 16 << 20
#: Terms end at ASCII characters other than letters and digits; A-Z are lower-cased.
_APART = bytes(ord(chr(c).lower()) if c < 0x80 and chr(c).isalnum() else c if c >= 0x80 else 0x20 for c in range(256))
_TEXT_CHUNK, _CLASS_ROWS, _ENTRIES = 1 << 20, 2048, 1 << 21
_PAIR_BYTES = 8


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of about a megabyte."""
    at = 0
    while at < len(text):
        end = at + _TEXT_CHUNK
        part = text[at:end].translate(_APART)
        if end < len(text):
            cut = part.rfind(b" ")
            while cut <= 0 and end < len(text):  # a term longer than a chunk
                end = min(len(text), 2 * end - at)
                part = text[at:end].translate(_APART)
                cut = part.rfind(b" ")
            if end < len(text):
                part, end = part[:cut], at + cut
        yield part.split()
        at = end


class ItemBlock:
    """Vocabulary and postings of a block of items, as plain data.

    ``words`` are the distinct terms in order; ``ids`` the item_ids in order (null last); term t occurs ``times[p]`` times
    in item ``owners[p]`` for p in ``starts[t]`` to ``starts[t + 1]``.
    """

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        bags: dict[int | None, Counter] = {}
        for item, text in rows:
            bag = bags.setdefault(item, Counter())
            for part in terms((text or "").encode()):
                bag.update(part)
        self.ids = sorted(bags, key=lambda i: (i is None, i or 0))
        self.words = sorted(set().union(*bags.values()))
        number = {w: k for k, w in enumerate(self.words)}
        found = sorted((number[w], k, n) for k, i in enumerate(self.ids) for w, n in bags[i].items())
        posting = np.array(found, np.int64).reshape(-1, 3)
        self.starts = np.searchsorted(posting[:, 0], np.arange(len(self.words) + 1))
        self.owners, self.times = posting[:, 1].copy(), posting[:, 2].copy()


def bag_of(text: bytes, number: dict[bytes, int]) -> tuple[int, bytes]:
    """Number of terms, and (term, occurrences) of the known ones as little-endian unsigned 32-bit pairs in order."""
    n, found = 0, Counter()
    for part in terms(text):
        n += len(part)
        found.update(map(number.get, part))
    found.pop(None, None)
    if not found:
        return n, b""
    pairs = np.array(sorted(found.items()), "<u4")
    return n, pairs.tobytes()


def document_bags(documents: DataFrame, words, name: str) -> DataFrame:
    """``doc_id, n, bag`` of every document; narrow. ``words`` is a broadcast list of the vocabulary."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = kept(("ranked_search", name), lambda: {w: k for k, w in enumerate(words.value)})
        for b in slices(batches, "text"):
            found = [bag_of(t, number) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())],
                names=["doc_id", "n", "bag"],
            )

    return rows.mapInArrow(run, "doc_id long, n long, bag binary")


def document_frequencies(bags: DataFrame, n_words: int) -> np.ndarray:
    """Documents that hold each term; a task sends one row per term of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_words, np.int64)
        for b in batches:
            held += np.bincount(np.frombuffer(b"".join(b.column("bag").to_pylist()), "<u4")[0::2], minlength=n_words)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "df"])

    out = np.zeros(n_words, np.int64)
    for r in bags.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def bag_classes(bags: DataFrame, documents: int, all_terms: int, k: int) -> DataFrame:
    """``bag, m, ids``: one row per distinct (bag, m) with a term of the vocabulary, and its ``k`` smallest doc_ids (null last).

    A class with any share of the rows sends k rows from each task. m is 100 - 75 + (75 * n * N) div L.
    """
    m = F.expr(f"25 + (CAST(75 * n AS DECIMAL(38, 0)) * {documents}) div {all_terms}")
    rows = bags.where(F.octet_length("bag") > 0).select("doc_id", "bag", m.alias("m"))
    rows = rows.withColumn("h", F.xxhash64("bag", "m"))
    order = Window.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    # collect_list leaves nulls out, so ids travel in a struct
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"])
    return first.groupBy("h", "m", "bag").agg(members.alias("ids")).drop("h")


class _Best:
    """The k best classes of every item, by (score, smallest doc_id)."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item = self.score = self.first = np.zeros(0, np.int64)
        self.ids: list = []

    def add(self, scores: np.ndarray, first: np.ndarray, ids: list) -> None:
        """scores: classes x items."""
        bound = self.least
        if len(scores) > self.k:  # what is not among the k best of the block is not among the k best
            bound = np.maximum(bound, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, item = np.nonzero(scores >= bound)
        if not len(row):
            return
        held = len(self.ids)
        all_item = np.concatenate([self.item, item])
        all_score = np.concatenate([self.score, scores[row, item]])
        all_first = np.concatenate([self.first, first[row]])
        order = np.lexsort((all_first, -all_score, all_item))
        start = np.searchsorted(all_item[order], all_item[order], side="left")
        order = order[np.arange(len(order)) - start < self.k]
        self.ids = [self.ids[j] if j < held else ids[row[j - held]] for j in order]
        self.item, self.score, self.first = all_item[order], all_score[order], all_first[order]
        size = np.bincount(self.item, minlength=len(self.least))
        last = np.cumsum(size) - 1
        full = size >= self.k
        self.least[full] = np.maximum(self.least[full], self.score[last[full]])


def score_block(bags: list[bytes], m: np.ndarray, block: dict, n_items: int) -> np.ndarray:
    """Scores (classes x items): the sum over an item's terms of w * ((10^9 tf) div (1000 tf + 8 m))."""
    pairs = np.frombuffer(b"".join(bags), "<u4").astype(np.int64).reshape(-1, 2)
    row = np.repeat(np.arange(len(bags)), [len(b) // _PAIR_BYTES for b in bags])
    term, tf = pairs[:, 0], pairs[:, 1]
    value = block["weights"][term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    size = block["starts"][term + 1] - block["starts"][term]
    scores = np.zeros(len(bags) * n_items, np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(row):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _ENTRIES, side="right")))
        n = size[at:upto]
        which = np.repeat(np.arange(at, upto), n)
        posting = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + block["starts"][term[which]]
        np.add.at(scores, row[which] * n_items + block["owners"][posting], value[which] * block["times"][posting])
        at = upto
    return scores.reshape(len(bags), n_items)


def _search_block(documents: DataFrame, rows: list[tuple[int | None, str | None]], k: int) -> DataFrame | None:
    spark = documents.sparkSession
    items = ItemBlock(rows)
    if not items.words:
        return None
    path = scratch_path(spark, "bags")
    words = spark.sparkContext.broadcast(items.words)
    document_bags(documents, words, path).write.parquet(path)
    bags = spark.read.parquet(path)
    r = bags.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.sum("n").alias("L")).first()
    if not r["L"]:
        return None
    df = document_frequencies(bags, len(items.words))
    weights = np.array([term_weight(r["N"], int(x)) for x in df], np.int64)
    shared = spark.sparkContext.broadcast({"weights": weights, "starts": items.starts, "owners": items.owners, "times": items.times})
    n_items, ids = len(items.ids), pa.array(items.ids, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block = _Best(n_items, k), shared.value
        rows_at_once = max(1, min(_CLASS_ROWS, (8 << 20) // n_items))
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                members = b.column("ids").to_pylist()
                first = np.array([(1 << 63) - 1 if x[0] is None else x[0] for x in members], np.int64)
                scores = score_block(b.column("bag").to_pylist(), b.column("m").to_numpy(), block, n_items)
                best.add(scores, first, members)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
        columns = (ids.take(pa.array(best.item)), pa.array(best.score), pa.array(best.ids, kinds[2]))
        yield pa.RecordBatch.from_arrays(list(columns), names=["item_id", "score", "ids"])

    found = bag_classes(bags, r["N"], r["L"], k).mapInArrow(run, "item_id long, score long, ids array<long>")
    key = F.struct("item_id")  # null is an item_id of its own
    place = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("ids")[0].asc_nulls_last())
    best = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    members = best.select("item_id", "score", F.explode("ids").alias("doc_id"))
    rank = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return members.select("item_id", F.row_number().over(rank).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


RESULT = "item_id long, rank int, doc_id long, score long"


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents with the highest score above 0, equal scores by ascending doc_id.

    Every document row counts, also repeated ones, and those with a null doc_id (they come last among
    equals). Rows of one item_id make one item with all their terms; a null item_id is one too. Null and empty
    texts have no terms. Other columns are ignored. No item or no document with a term: no rows.

    Texts of any length are cut into terms by the megabyte. The broadcast (vocabulary, postings, weights) has the
    size of a block of items, and there are as many passes over the documents as blocks.
    """
    spark = documents.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // item_bytes)
    out = None
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found = _search_block(documents, [(r["item_id"], r["text"]) for r in own], k) if own else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RESULT) if out is None else out
