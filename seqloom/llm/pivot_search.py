"""Exact top-k search by inner product with a pivot-distance index.

Inner products become distances by one added component: with ``M`` the largest
norm, ``v' = (v, sqrt(M^2 - |v|^2))`` and ``q' = (q, 0)`` give
``|q' - v'|^2 = |q|^2 + M^2 - 2 q.v``, so the largest products are the nearest
vectors. The index keys every vector by its nearest pivot and its distance to
it; the distances of a pivot are cut into rings.

A query first looks through its own ring; its k-th best score gives a search radius.
Then the rings (annuli) of all pivots are taken that the triangle inequality
allows inside the radius, and inside a ring the sorted distances are
passed in order while the radius keeps shrinking. Scores are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow_kernels import TOKENS, list_parts, row_lengths, row_slices
from ..session import checkpoint_dir, shuffles_freed

PIVOTS, RINGS = 48, 16
#: Rows from which pivots and ring bounds are chosen, in the order of a hash of vec_id (the index holds every row).
SAMPLE_ROWS = 4096
#: Vectors of a block that one task compares with at most QUERY_CHUNK queries; larger rings are dealt over more blocks.
RING_SPLIT, QUERY_CHUNK = 20_000, 8192
#: Vectors and queries that are multiplied in one go, and (query, block) rows that are handed on at once.
TILE, VISITS = 1024, 1 << 14
#: Products are exact below these in 32-bit and 64-bit floats.
EXACT_32, EXACT = 2.0**24, 2.0**52
#: (block, query chunk) pairs up to which the directory of who asks for which block is broadcast (4 bytes each).
ASKED_BROADCAST = 1 << 22
#: Tasks of a search at most; further blocks and chunks share them.
TASKS = 1 << 13


def integer_vectors(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """``vec_id, vec, dim, norm2``: floor(scale * x) of every component as packed integers (``_matrix`` reads them).

    One row per row that takes part, also for repeated vec_ids; rows with a null vec_id or vector, or with a null or
    non-finite component, take no part. Components beyond 2^62 in size are held to it.
    """
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in row_slices(b, row_lengths(b.column("embedding")), TOKENS):
                x, sizes = list_parts(part.column("embedding"))
                x = x.astype(np.float64)
                of = np.repeat(np.arange(len(sizes)), sizes)
                whole = np.bincount(of[~np.isfinite(x)], minlength=len(sizes)) == 0
                x, sizes, of = x[whole[of]], sizes[whole], of[whole[of]]
                x = np.clip(np.floor(scale * x), -(2.0**62), 2.0**62)
                norm = np.bincount(of, weights=x * x, minlength=len(whole))[whole].astype(np.float64)
                ids = part.column("vec_id").filter(pa.array(whole))
                yield pa.RecordBatch.from_arrays(
                    [ids, _packed(x, sizes), pa.array(sizes.astype(np.int32)), pa.array(norm)], names=["vec_id", "vec", "dim", "norm2"]
                )

    return rows.mapInArrow(run, "vec_id long, vec binary, dim int, norm2 double")


def _packed(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Vectors (``x`` end to end, whole numbers) as bytes: one with the width, then integers of the width that all of them need."""
    most = np.abs(x).max(initial=0.0)
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    raw = x.astype(f"<i{width}").tobytes()
    ends = np.cumsum(sizes, dtype=np.int64) * width
    if len(sizes) and (sizes == sizes[0]).all():
        raw = np.column_stack([np.full(len(sizes), width, np.uint8), np.frombuffer(raw, np.uint8).reshape(len(sizes), -1)]).tobytes()
        offsets = np.arange(len(sizes) + 1, dtype=np.int64) * (1 + int(sizes[0]) * width)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw)])
    return pa.array([bytes([width]) + raw[z - n * width : z] for z, n in zip(ends, sizes, strict=True)], pa.binary())


def _integers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1)


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    """Packed integers as rows of floats; shorter vectors are filled up with zeros."""
    out = np.zeros((len(packed), dim))
    packed = packed.cast(pa.binary())
    size = pc.binary_length(packed).to_numpy(zero_copy_only=False)
    if len(size) and (size == size[0]).all() and size[0] > 1:
        start = int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])
        raw = np.frombuffer(packed.buffers()[2], np.uint8)[start : start + len(size) * size[0]].reshape(len(size), size[0])
        if (raw[:, 0] == raw[0, 0]).all():
            v = np.ascontiguousarray(raw[:, 1:]).view(f"<i{raw[0, 0]}")
            out[:, : v.shape[1]] = v
            return out
    for k, p in enumerate(packed.to_pylist()):
        v = _integers(p)
        out[k, : len(v)] = v
    return out


def _added(m: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - np.einsum("ij,ij->i", m, m), 0.0))


def _distances(m: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of (m, extra) to the pivots (whose last column is the added component)."""
    full = np.column_stack([m, extra])
    d2 = np.einsum("ij,ij->i", full, full)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(d2, 0.0))


class PivotIndex:
    """Pivots, the directory of rings (ring number -> smallest and largest distance, rows) and ``rows``, the index table.

    A row of the table has a number of its own, ``row``; vec_ids may repeat. Ring ``c`` belongs to pivot ``c // per``.
    """

    def __init__(
        self, rows: DataFrame, pivots: np.ndarray, dim: int, top: float, per: int, rings: dict[int, tuple[float, float, int]]
    ):
        self.rows, self.pivots, self.dim, self.top, self.per, self.rings = rows, pivots, dim, top, per, rings


def _spread_pivots(m: np.ndarray, count: int) -> np.ndarray:
    """Greedy choice: each next pivot is the sample vector farthest from those chosen."""
    chosen = [0]
    near = np.linalg.norm(m - m[0], axis=1)
    while len(chosen) < min(count, len(m)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(m - m[chosen[-1]], axis=1))
    return m[chosen]


def build_index(vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE_ROWS) -> PivotIndex:
    """Index of all rows of ``integer_vectors``. The driver sees the sample and one line per ring (pivots x rings)."""
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    vectors = vectors.checkpoint()
    facts = vectors.agg(F.max("dim").alias("dim"), F.max("norm2").alias("top")).first()
    dim, top = int(facts["dim"] or 0), float(facts["top"] or 0.0)
    taken = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").select("vec").limit(sample).collect()
    m = _matrix(pa.array([bytes(r["vec"]) for r in taken], pa.binary()), dim)
    full = np.column_stack([m, _added(m, top)]) if len(m) else np.zeros((1, dim + 1))
    at = _spread_pivots(full, pivots)
    d = _distances(full[:, :dim], full[:, dim], at)
    near = d.argmin(axis=1)
    cuts = np.stack([
        np.quantile(d[near == p, p] if (near == p).any() else [0.0], np.arange(1, rings) / rings) for p in range(len(at))
    ])
    shared = spark.sparkContext.broadcast((at, cuts, dim, top))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cuts, dim, top = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("vec"), dim)
            d = _distances(m, _added(m, top), at)
            p = d.argmin(axis=1)
            own = d[np.arange(len(p)), p]
            ring = (cuts[p] <= own[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((p * (cuts.shape[1] + 1) + ring).astype(np.int32)), pa.array(own), b.column("vec_id"), b.column("vec")],
                names=["cell", "d", "vec_id", "vec"],
            )

    keyed = vectors.select("vec_id", "vec").mapInArrow(key, "cell int, d double, vec_id long, vec binary")
    keyed = keyed.withColumn("row", F.monotonically_increasing_id()).checkpoint()  # fixed once it is written
    found = keyed.groupBy("cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).collect()
    return PivotIndex(keyed, at, dim, top, rings, {r["cell"]: (r["lo"], r["hi"], r["n"]) for r in found})


VISIT = "query_id long, vec_id long, score long"
#: A row of the index that asks: its row number, vector and ring, and the worst of the k best so far (null with fewer).
ASKS = ["row", "id", "vec", "cell", "least", "last"]


def _blocks(index: PivotIndex) -> dict[int, tuple[int, int]]:
    """Ring -> its first block and how many it is dealt over. Rings that follow each other share a block of RING_SPLIT rows
    at most, or fewer where that gives the cores too few; a larger ring has blocks of its own."""
    cores = index.rows.sparkSession.sparkContext.defaultParallelism
    room = max(1, min(RING_SPLIT, sum(n for *_, n in index.rings.values()) // (4 * cores)))
    places, block, held = {}, 0, 0
    for cell in sorted(index.rings):
        n = index.rings[cell][2]
        parts = -(-n // RING_SPLIT)
        if held and (parts > 1 or held + n > room):
            block, held = block + 1, 0
        places[cell] = block, parts
        held += n
        if parts > 1:
            block, held = block + parts, 0
    return places


def _radius(norm2: np.ndarray, least: np.ndarray, top: float) -> np.ndarray:
    """Distance within which the vectors with ``least`` or a higher score lie: sqrt(|q|^2 + M^2 - 2 score)."""
    return np.sqrt(np.maximum(0.0, norm2 + top - 2.0 * least))


def _scores_so_far(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)


def _visits(queries: DataFrame, index: PivotIndex, places: dict[int, tuple[int, int]], home: bool) -> DataFrame:
    """(query, block) pairs: the blocks of the query's own ring, or those with another ring inside its radius."""
    shared = queries.sparkSession.sparkContext.broadcast((index.pivots, index.rings, index.dim, index.top, index.per, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rings, dim, top, per, places = shared.value
        cells = np.array(sorted(rings), np.int64)
        lo, hi = (np.array([rings[c][j] for c in cells]) for j in (0, 1))
        # a column per (ring, block of it); columns of one block stand side by side
        ring, block = np.array([(k, places[c][0] + p) for k, c in enumerate(cells) for p in range(places[c][1])], np.int64).reshape(-1, 2).T
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        slack = 1e-6 * (1.0 + np.sqrt(top))
        step = max(1, VISITS // max(1, len(edges)))
        for whole in batches:
            for at in range(0, whole.num_rows if len(cells) else 0, step):
                b = whole.slice(at, step)
                own = b.column("cell").to_numpy()[:, None] == cells
                if home:
                    mine = own
                else:
                    m = _matrix(b.column("vec"), dim)
                    to = _distances(m, np.zeros(len(m)), pivots)[:, cells // per]
                    reach = _radius(np.einsum("ij,ij->i", m, m), _scores_so_far(b.column("least")), top) + slack
                    mine = (np.maximum(to - hi, lo - to) <= reach[:, None]) & ~own
                query, found = np.nonzero(np.logical_or.reduceat(mine[:, ring], edges, axis=1))
                goes = b.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([pa.array(block[edges][found].astype(np.int32)), *goes.columns], names=["block", *ASKS])

    return queries.select(*ASKS).mapInArrow(run, "block int, row long, id long, vec binary, cell int, least long, last long")


def _search(queries: DataFrame, index: PivotIndex, k: int, query_chunks: int, home: bool) -> DataFrame:
    """Best ``k`` per query and block that it visits."""
    spark = index.rows.sparkSession
    places = _blocks(index)
    blocks = max((first + parts for first, parts in places.values()), default=1)
    chunk = F.pmod(F.xxhash64("row"), F.lit(query_chunks)).cast("int").alias("chunk")
    visits = _visits(queries, index, places, home)
    # a row of the index goes to the chunks of queries that ask for its block, and to no other
    asked = visits.select("block", chunk).distinct().groupBy("block").agg(F.collect_list("chunk").alias("chunks"))
    if blocks * query_chunks <= ASKED_BROADCAST:
        asked = F.broadcast(asked)
    of_cell = F.broadcast(spark.createDataFrame([(c, *at) for c, at in places.items()], "cell int, first int, parts int"))
    block = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int").alias("block")
    v = index.rows.join(of_cell, "cell").select("cell", block, "d", F.col("vec_id").alias("id"), "vec").join(asked, "block")
    v = v.select("block", F.explode("chunks").alias("chunk"), F.lit(1).alias("kind"), "cell", "d", "id", "vec")
    wanted = visits.select("block", chunk, F.lit(0).alias("kind"), "cell", "id", "vec", "least", "last")
    task = F.col("block").cast("long") * query_chunks + F.col("chunk")
    tasks = min(TASKS, blocks * query_chunks)
    both = v.unionByName(wanted, allowMissingColumns=True).withColumn("task", task)
    both = both.repartitionById(tasks, F.pmod("task", F.lit(tasks)).cast("int")).sortWithinPartitions("task", "kind", "cell", "d")
    pivots, dim, top, per = index.pivots, index.dim, index.top, index.per
    shared = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_ = None, None
        for b in batches:
            keys = np.column_stack([b.column(c).to_numpy() for c in ("task", "kind", "cell")]) if b.num_rows else np.zeros((0, 3), int)
            keys[keys[:, 1] == 0, 2] = 0  # queries of all rings are asked together
            bounds = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for a, z in zip([0, *bounds], [*bounds, len(keys)], strict=True):
                if a == z:
                    continue
                if keys[a][0] != group:
                    if open_ is not None:
                        yield open_.best()
                    group, open_ = keys[a][0], _Open(k, shared.value, dim, top, per, home)
                if keys[a][1] == 0:
                    open_.ask(b.slice(a, z - a))
                else:
                    open_.compare(int(keys[a][2]), b.slice(a, z - a))
        if open_ is not None:
            yield open_.best()

    return both.select("task", "kind", "cell", "d", "id", "vec", "least", "last").mapInArrow(run, VISIT)


class _Open:
    """Queries that visit one block, with their best scores so far.

    The best ``k`` of query ``j`` are ordered by score, then vec_id; with ``k`` of them, a vector must have a score above
    ``least[j]``, or that score and a vec_id below ``last[j]``. What passes is gathered and merged from time to time.
    """

    def __init__(self, k: int, pivots: np.ndarray, dim: int, top: float, per: int, home: bool):
        self.k, self.pivots, self.dim, self.top, self.per, self.home = k, pivots, dim, top, per, home
        self.asked: list[pa.RecordBatch] = []
        self.ids = np.zeros(0, np.int64)
        self.best_so_far = tuple(np.zeros(0, np.int64) for _ in range(3))  # query, score, vec_id
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def ask(self, b: pa.RecordBatch) -> None:
        self.asked.append(b)

    def _begin(self) -> None:
        t = pa.Table.from_batches(self.asked).combine_chunks().to_batches()[0]
        self.asked = []
        self.ids, self.cell, self.packed = t.column("id").to_numpy(), t.column("cell").to_numpy(), t.column("vec")
        self.m = _matrix(self.packed, self.dim)
        self.norm2 = np.einsum("ij,ij->i", self.m, self.m)
        self.bound = np.sqrt(self.norm2 * self.top)
        self.m32 = self.m.astype(np.float32) if self.bound.max() < EXACT_32 else None
        self.away = _distances(self.m, np.zeros(len(self.m)), self.pivots)
        self.least = _scores_so_far(t.column("least")).copy()
        self.last = t.column("last").fill_null(0).to_numpy(zero_copy_only=False).copy()
        self.full = t.column("least").is_valid().to_numpy(zero_copy_only=False)
        self.exact = t.column("least").fill_null(0).to_numpy(zero_copy_only=False).copy()  # least as a whole number, where full
        self.slack = 1e-6 * (1.0 + np.sqrt(self.top))
        self.r = _radius(self.norm2, self.least, self.top) + self.slack

    def compare(self, cell: int, b: pa.RecordBatch) -> None:
        """Rows of one ring, in the order of their distances to its pivot."""
        if self.asked:
            self._begin()
        if not len(self.ids):
            return
        of_ring = (self.cell == cell) == self.home
        away = self.away[:, cell // self.per]
        for at in range(0, b.num_rows, TILE):
            part = b.slice(at, TILE)
            d = part.column("d").to_numpy()
            active = np.flatnonzero(of_ring & (away - self.r <= d[-1]) & (d[0] <= away + self.r))
            if not len(active):
                continue
            ids = part.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, packed = ids[order], part.column("vec").take(pa.array(order))
            m = _matrix(packed, self.dim)
            m32 = None if self.m32 is None else m.astype(np.float32)
            for some in range(0, len(active), TILE):
                self._look(active[some : some + TILE], ids, packed, m, m32)

    def _look(self, asking: np.ndarray, ids: np.ndarray, packed: pa.Array, m: np.ndarray, m32: np.ndarray | None) -> None:
        """Scores of some queries with some vectors, which stand in the order of their ``ids``."""
        least = self.least[asking]
        if m32 is not None:
            scores, least = self.m32[asking] @ m32.T, least.astype(np.float32)
        elif self.bound[asking].max() < EXACT:
            scores = self.m[asking] @ m.T
        else:  # too large for exact doubles: Python integers, held to 64 bits
            scores = self._large(self.packed.take(pa.array(asking)).to_pylist(), packed.to_pylist())
        hits = scores >= least[:, None]
        many = np.flatnonzero(np.count_nonzero(hits, axis=1) > 4 * self.k)
        if len(many):  # the best k of these rows; the own vector takes no place
            other = ids[None, :] != self.ids[asking[many]][:, None]
            hits[many] &= other
            s = np.where(hits[many], scores[many], -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min)
            edge = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k][:, None]
            above, equal = hits[many] & (s > edge), hits[many] & (s == edge)
            free = self.k - np.count_nonzero(above, axis=1)
            hits[many] = above | (equal & (np.cumsum(equal, axis=1) <= free[:, None]))
        row, at = np.nonzero(hits)
        query, score, vec = asking[row], scores[row, at].astype(np.int64), ids[at]
        # those equal to the last of the k best come after it
        late = self.full[query] & (score == self.exact[query]) & (vec >= self.last[query])
        use = (vec != self.ids[query]) & ~late
        if use.any():
            self.new.append((query[use], score[use], vec[use]))
            self.pending += int(use.sum())
            if self.pending > max(1 << 16, 2 * self.k * len(self.ids)):
                self._merge()

    def _merge(self) -> None:
        query, score, vec = (np.concatenate(x) for x in zip(self.best_so_far, *self.new, strict=True))
        order = np.lexsort((vec, ~score, query))
        query, score, vec = query[order], score[order], vec[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
        full = rank == self.k - 1
        j = query[full]
        self.full[j], self.exact[j], self.least[j], self.last[j] = True, score[full], score[full], vec[full]
        self.r[j] = np.minimum(self.r[j], _radius(self.norm2[j], self.least[j], self.top) + self.slack)
        self.best_so_far = tuple(x[rank < self.k] for x in (query, score, vec))
        self.new, self.pending = [], 0

    def _large(self, queries: list[bytes], vectors: list[bytes]) -> np.ndarray:
        q = [_integers(x).tolist() for x in queries]
        v = [_integers(x).tolist() for x in vectors]
        whole = [[sum(a * b for a, b in zip(x, y, strict=False)) for y in v] for x in q]
        return np.array([[max(-(2**63), min(2**63 - 1, s)) for s in row] for row in whole], np.int64)

    def best(self) -> pa.RecordBatch:
        if self.new:
            self._merge()
        query, score, vec = self.best_so_far
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (self.ids[query], vec, score)], names=["query_id", "vec_id", "score"]
        )


def top_k(index: PivotIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of every query, ties to the smaller vec_id.

    ``queries`` holds vec_ids of indexed vectors. Candidates are all rows of the index but those with the query's own
    vec_id; rows that share a vec_id are candidates each, and a vec_id that is asked for and names several rows
    gets the best products of all of them. Scores beyond 64 bits are held to them. With fewer candidates, all are returned; an empty index gives no rows.

    A query's vector goes once to every block of rings that it visits, and a row of the index once to every chunk of
    queries that visit its block. Large rings are dealt over blocks and the rows that ask over chunks by their row number,
    so neither a vector that many rows share, nor a vec_id, nor many queries meet in one task.
    """
    asked = index.rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id").select(
        "row", F.col("vec_id").alias("id"), "vec", "cell"
    ).checkpoint()
    chunks = max(1, -(-asked.count() // QUERY_CHUNK))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    none = F.lit(None).cast("long")
    with shuffles_freed(index.rows.sparkSession):
        first = _search(asked.withColumn("least", none).withColumn("last", none), index, k, chunks, True)
        first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).checkpoint()
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"), F.col("vec_id").alias("last"))
    rest = _search(asked.join(kth, "id", "left"), index, k, chunks, False)
    ranked = first.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
