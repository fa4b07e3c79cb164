"""Jaccard join of documents on word shingles by an inverted index with set-relation skipping.

A document's set holds its distinct shingles of four words (of fewer words: the
whole sequence). Two sets link when ``100 * |A & B| >= 85 * |A | B|``.

1. Copies: equal sets form one class; only classes take part below.
2. Order: a fixed-size table of hashed shingle counts over all documents gives one
   global order, rare shingles first. Any order is exact; this one keeps lists short.
3. Index: by the prefix principle, linked sets share one of their first
   ``n - ceil(0.85 n) + 1`` shingles. Each of these has a list of sets with size
   and position. Size and position bound the overlap of a pair whose first common
   shingle this is; a list is passed in blocks ordered by position, whose bounds skip
   pairs of blocks, and members without any possible partner leave the index.
4. Answers from similar sets: the member with the smallest position leads a list.
   Every set is first compared with the leader that it meets most often. A set linked
   to a leader takes over the leader's answers: its component. Only pairs of members
   of different components that pass the bounds are still open; they are compared too,
   unless the sets' signatures (parities of hashed shingles) already differ too much.
5. Components of all links found are the result.

No pair within a component is emitted, so groups of near copies cost one comparison
per member. Lists longer than ``BLOCK`` are dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .components import connected_components
from .text_batches import Powers, Words, mix64, slices, texts_of, window_hashes

WIDTH = 4
PERCENT = 85
SKETCH_BITS, CHUNK = 22, 1 << 16
BLOCK = 4096
BLOOM_BITS = 24


def shingle_sets(texts: list[bytes], powers: Powers, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased); empty without words."""
    w = Words([t.lower() for t in texts], powers)
    h = mix64(window_hashes(w.hashes, width))
    first = np.cumsum(w.counts) - w.counts
    out = []
    for at, n in zip(first.tolist(), w.counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(h[at : at + n - width + 1]))
        elif n:
            whole = window_hashes(w.hashes[at : at + n], n) + np.uint64(n)
            out.append(mix64(mix64(whole)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else 0


def _signature(s: np.ndarray) -> bytes:
    """512 bits: bit ``k`` is the parity of the number of shingles that hash to ``k``.

    Every shingle in only one of two sets changes one bit of the difference, so the number of differing bits is
    at most the number of these shingles: a bound that never rules out a link.
    """
    bits = np.bincount(((s >> np.uint64(40)) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 8)


def _close(sig1: np.ndarray, sig2: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Can sets with these signatures and sizes link?"""
    differ = np.bitwise_count(sig1 ^ sig2).sum(axis=1, dtype=np.int64)
    return (100 + percent) * differ <= (100 - percent) * (n1 + n2)


def shingle_counts(rows: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Hashed counts of all shingles (2^22 numbers of 16 bits, whatever the data): each task adds up its own table."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = Powers(), np.zeros(size, np.uint32)
        for b in slices(batches, "text"):
            w = Words([t.lower() for t in texts_of(b.column("text"))], powers)
            h = mix64(window_hashes(w.hashes, width))
            inside = w.rows[: len(h)] == w.rows[width - 1 :]
            total += np.bincount((h[inside] & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32)
        small = np.minimum(total, 255).astype(np.uint8)
        used = [k for k in range(0, size, CHUNK) if small[k : k + CHUNK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k // CHUNK for k in used], pa.int32()), pa.array([small[k : k + CHUNK].tobytes() for k in used], pa.binary())],
            names=["chunk", "n"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(n, np.uint8).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([np.minimum(v, 65535).astype("<u2").tobytes() for v in held.values()], pa.binary())],
            names=["chunk", "n"],
        )

    table = np.zeros(size, np.uint16)
    summed = rows.select("text").mapInArrow(count, "chunk int, n binary").repartition("chunk").mapInArrow(add, "chunk int, n binary")
    for r in summed.collect():  # at most 64 rows of 128 KB
        table[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["n"], "<u2")
    return table


def _prefixes(rows: DataFrame, counts, percent: int, width: int) -> DataFrame:
    """Per document: row key, set id, set size, signature and the first shingles of its set in the global order, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = Powers(), counts.value
        for b in slices(batches, "text"):
            ids, sizes, signs, packed = [], [], [], []
            for s in shingle_sets(texts_of(b.column("text")), powers, width):
                # an order key holds the count in its upper 16 bits; it serves as the shingle's name in the index
                key = (table[(s & np.uint64(len(table) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16))
                n = len(s)
                ids.append(_set_id(s))
                sizes.append(n)
                signs.append(_signature(s))
                packed.append(np.sort(key)[: prefix_length(n, percent)].tobytes() if n else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("row"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(signs, pa.binary()), pa.array(packed, pa.binary()),
                ],
                names=["doc_id", "row", "set_id", "n", "sig", "prefix"],
            )

    return rows.mapInArrow(run, "doc_id long, row long, set_id long, n long, sig binary, prefix binary")


def _entries(classes: DataFrame) -> DataFrame:
    """Index entries ``token, set_id, n, pos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "prefix", 1 << 20):
            prefix = [np.frombuffer(p, np.int64) for p in b.column("prefix").to_pylist()]
            length = np.array([len(p) for p in prefix], np.int64)
            total = int(length.sum())
            token = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            pos = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
            rep = [np.repeat(b.column(c).to_numpy(), length) for c in ("set_id", "n")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(rep[0]), pa.array(rep[1].astype(np.int32)), pa.array(pos.astype(np.int32))],
                names=["token", "set_id", "n", "pos"],
            )

    return classes.select("set_id", "n", "prefix").mapInArrow(run, "token long, set_id long, n int, pos int")


def _possible(n1, p1, n2, p2, percent: int):
    """Can sets of these sizes link if their first common shingle stands at these positions?"""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    overlap = 1 + np.minimum(n1 - 1 - p1, n2 - 1 - p2)
    return (100 * small >= percent * large) & ((100 + percent) * overlap >= percent * (n1 + n2))


SHARED = "token long, set_id long, n int, pos int, leader long, near boolean"


def _shared_entries(entries: DataFrame, percent: int) -> DataFrame:
    """Entries of lists with at least two members, with the list's leader; ``near``: the leader is a possible partner.

    The lists are sorted by position. Members of a list of up to 512 that have no possible partner are left out.
    """
    by_list = Window.partitionBy("token").orderBy("pos", "n", "set_id")
    head = F.first(F.struct("set_id", "n", "pos")).over(by_list)
    listed = (
        entries.repartition("token")
        .select("*", head.alias("head"), F.row_number().over(by_list).alias("k"), F.lead("set_id").over(by_list).alias("more"))
        .where((F.col("k") > 1) | F.col("more").isNotNull())
        .select(
            "token", "set_id", "n", "pos", F.col("head.set_id").alias("leader"), F.col("head.n").alias("leader_n"), F.col("head.pos").alias("leader_pos")
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, ids, n, pos, leader, leader_n, leader_pos), whole in _runs(batches):
            near = _possible(n, pos, leader_n, leader_pos, percent) & (ids != leader)
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(start, len(token)))
            keep = np.ones(len(token), bool)
            two = start[size == 2]
            if whole:
                keep[two] = keep[two + 1] = _possible(n[two], pos[two], n[two + 1], pos[two + 1], percent)
                for at, m in zip(start[(size > 2) & (size <= 512)].tolist(), size[(size > 2) & (size <= 512)].tolist(), strict=True):
                    i, p = n[at : at + m], pos[at : at + m]
                    ok = _possible(i[:, None], p[:, None], i[None, :], p[None, :], percent)
                    np.fill_diagonal(ok, False)
                    keep[at : at + m] = ok.any(axis=1)
            if keep.any():
                cols = [token[keep], ids[keep], n[keep].astype(np.int32), pos[keep].astype(np.int32), leader[keep], near[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in SHARED.split(", ")])

    return listed.mapInArrow(run, SHARED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of consecutive batches, cut where the first column changes.

    ``whole`` is false for pieces of a run (list) that alone exceeds ``BLOCK`` rows; such pieces hold one run only.
    """
    held: list[np.ndarray] | None = None
    going: int | None = None  # the run that is coming in pieces
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cols = [c.astype(np.int64) for c in cols]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        key = cols[0]
        if going is not None:
            end = int(np.searchsorted(key != going, True)) if (key != going).any() else len(key)
            if end:
                yield [c[:end] for c in cols], False
                cols = [c[end:] for c in cols]
                key = cols[0]
            if len(key):
                going = None
        if not len(key):
            held = None
            continue
        cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
        if cut:
            yield [c[:cut] for c in cols], True
            cols = [c[cut:] for c in cols]
        held = cols
        if len(cols[0]) > BLOCK:
            yield cols, False
            going, held = int(cols[0][0]), None
    if held is not None:
        yield held, True


def _possible_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose signatures leave a link possible."""
    both = pairs.join(reps.select(F.col("set_id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").join(
        reps.select(F.col("set_id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = _close(
                _signatures(b.column("sa")), _signatures(b.column("sb")), b.column("na").to_numpy(), b.column("nb").to_numpy(), percent
            )
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _open_pairs(shared: DataFrame, labels: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b`` of list members in different components that positions, sizes and signatures allow."""
    named = shared.select("token", "set_id", "n", "pos").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.withColumn("label", F.coalesce("label", "set_id"))
    mixed = named.groupBy("token").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")
    ).where("lo <> hi").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    # a list of several blocks is compared block by block; its members are repeated once per block
    dealt = (
        named.join(mixed, "token").join(reps.select("set_id", "sig"), "set_id")
        .withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set_id", "label", "n", "pos", "own", "sig")
    )
    ordered = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "pos", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _blocks(batches):
            ids, label, n, pos, own, sig = group
            cross = own[0] != own[-1] or (own != own[0]).any()
            found_a, found_b = [], []
            for at in range(0, len(ids), 256):  # block-skipping: rows are in order of position
                k = slice(at, at + 256)
                ok = (label[k, None] != label[None, at:]) & _possible(
                    n[k, None], pos[k, None], n[None, at:], pos[None, at:], percent
                )
                if cross:
                    ok &= own[k, None] != own[None, at:]
                x, y = np.nonzero(ok)
                x, y = at + x[y > x], at + y[y > x]
                near = _close(sig[x], sig[y], n[x], n[y], percent)
                found_a.append(ids[x[near]])
                found_b.append(ids[y[near]])
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Members (set_id, label, n, pos, own, sig) of each (token, i, j); about two blocks at most."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:-1]] + [_signatures(b.columns[-1])]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        change = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        bounds = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            yield [c[a:z] for c in cols[3:]]
        held = [c[bounds[-1] :] for c in cols]
    if held is not None:
        yield [c for c in held[3:]]


def _bloom(keys: DataFrame) -> np.ndarray:
    """Bit table of fixed size (2 MB) that holds every ``row`` key at two positions."""
    mask = (1 << BLOOM_BITS) - 1
    bits = keys.select(F.explode(F.array(F.col("row").bitwiseAND(mask), F.shiftrightunsigned("row", 30).bitwiseAND(mask))).alias("at"))
    words = bits.groupBy(F.shiftright("at", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 AS INT)))").alias("set"))
    table = np.zeros(1 << (BLOOM_BITS - 5), np.int64)
    found = words.toArrow()  # at most 2^19 rows
    table[found.column("w").to_numpy()] = found.column("set").to_numpy()
    return np.unpackbits(table.astype("<u4").view(np.uint8), bitorder="little").astype(bool)


def _sets_of(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``row, shingles`` (sorted hashes) of the rows in ``wanted(row)``: a pass over the texts that shingles these
    (and the few others that the bit table lets through). A task hands on a repeated row once."""
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    shared = rows.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), shared.value
        done: set[int] = set()
        for b in batches:
            key = b.column("row").to_numpy().view(np.uint64)
            use = bits[(key & mask).astype(np.int64)] & bits[((key >> np.uint64(30)) & mask).astype(np.int64)]
            for k in np.flatnonzero(use).tolist():
                use[k] = int(key[k]) not in done
                done.add(int(key[k]))
            for part in slices(iter([b.filter(pa.array(use))]), "text"):
                sets = shingle_sets(texts_of(part.column("text")), powers, width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["row", "shingles"]
                )

    return rows.select("row", "text").mapInArrow(run, "row long, shingles binary")


#: Sets compared with one set in one task.
PARTNERS = 2000


def _linked(pairs: DataFrame, reps: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs ``a, b`` of sets that link, compared exactly; ``reps(set_id, row)`` names a row for each set.

    Every ``b`` meets its partners, dealt over as many parts as there are thousands of them: first ``b``'s set,
    then the partners' sets, one after another.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    partner = (
        pairs.join(parts, "b").join(reps.withColumnRenamed("set_id", "a"), "a")
        .select("row", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
    )
    head = parts.join(reps.withColumnRenamed("set_id", "b"), "b").select(
        "row", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a")
    )
    roles = partner.unionByName(head).checkpoint()
    sets = _sets_of(rows, roles.select("row"), width)
    met = (
        sets.join(roles, "row").select("b", "part", "a", "shingles")
        .repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        own = np.zeros(0, np.uint64)
        for big in batches:
            for batch in slices(iter([big]), "shingles", 8 << 20):
                found: list[tuple[int, int]] = []
                for b, part, a, packed in zip(*(batch.column(c).to_pylist() for c in ("b", "part", "a", "shingles")), strict=True):
                    mine = np.frombuffer(packed, np.uint64)
                    if a is None:
                        group, own = (b, part), mine
                    elif group == (b, part):
                        merged = np.sort(np.concatenate([own, mine]))
                        same = int((merged[1:] == merged[:-1]).sum())
                        if 100 * same >= percent * (len(own) + len(mine) - same):
                            found.append((a, b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
                )

    return met.mapInArrow(run, "a long, b long")


def jaccard_components(documents: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, row, n_shingles, component_id, first_row`` for every row of ``documents``.

    ``component_id`` is the smallest doc_id reachable by links, the own one included; ``row`` a hash of (doc_id, text)
    and ``first_row`` the ``row`` of one row with the smallest doc_id of the component (null ids come last).
    Null or empty texts and texts without words have no shingles and link with nothing. Rows with a null doc_id
    take part; a component of such rows only has a null id. Repeated rows are returned as often as they come.
    Other columns are ignored. An empty table gives no rows.

    Passes over the texts: shingle counts, prefixes, and twice the shingles of the sets to compare. Only tables of fixed size
    (shingle counts, bit table) reach the driver; links and components stay in Spark.
    """
    spark = documents.sparkSession
    checkpoint_dir(spark)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    counts = spark.sparkContext.broadcast(shingle_counts(rows, width))
    docs = _prefixes(rows, counts, percent, width).checkpoint()
    some = docs.where("n > 0")
    classes = some.groupBy("set_id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    shared = _shared_entries(_entries(classes), percent).checkpoint()

    meets = shared.where("near").groupBy("set_id", "leader").agg(F.count("*").alias("times"))
    stars = meets.groupBy("set_id").agg(F.max_by("leader", F.struct("times", "leader")).alias("b")).select(
        F.col("set_id").alias("a"), "b"
    )
    reps = (
        some.groupBy("set_id").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .join(shared.select("set_id").distinct(), "set_id", "left_semi").checkpoint()
    )
    rows_of = reps.select("set_id", "row")
    first = _linked(_possible_pairs(stars, reps, percent).checkpoint(), rows_of, rows, percent, width).checkpoint()
    labels = connected_components(first)
    more = _linked(_open_pairs(shared, labels, reps, percent).checkpoint(), rows_of, rows, percent, width).checkpoint()
    # sets of one component count as one from here on
    named = labels.select(F.col("node"), F.col("label"))
    lifted = (
        more.join(named.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        .join(named.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    upper = connected_components(lifted).select(F.col("node").alias("label"), F.col("label").alias("top"))
    of_set = labels.join(upper, "label", "full_outer").select(
        F.coalesce("node", "label").alias("set_id"), F.coalesce("top", "label").alias("label")
    )
    # a set that met others only in the second round is its own label there
    of_set = of_set.unionByName(upper.select(F.col("label").alias("set_id"), F.col("top").alias("label"))).groupBy("set_id").agg(
        F.min("label").alias("label")
    )
    smallest = some.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("own"))
    joined = smallest.join(of_set, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    heads = joined.groupBy("label").agg(F.min("own").alias("head"))
    of_class = joined.select("set_id", "label").join(heads, "label").select(
        "set_id", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("first_row")
    )
    result = some.select("doc_id", "row", "set_id", F.col("n").alias("n_shingles")).join(of_class, "set_id").drop("set_id")
    alone = docs.where("n = 0").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("row").alias("first_row")
    )
    return result.unionByName(alone).select("doc_id", "row", "n_shingles", "component_id", "first_row")


def one_per_component(documents: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row of each component, with all columns: one with the smallest doc_id. Texts without words all stay."""
    found = jaccard_components(documents, percent, width)
    first = found.where("n_shingles > 0 AND row = first_row").select(F.col("row").alias("__row")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_words = text.rlike(r"[^\x20\x09-\x0D]")
    keyed = documents.where(has_words).withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), text))
    kept = keyed.join(first, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
    return kept.unionByName(documents.where(~has_words))
