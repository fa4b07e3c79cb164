"""Vocabulary, encoding, packing, masking, pack report, next-token pairs, lookup.

Everything stays one row per *document* or per *document piece*; nothing is
exploded to one row per token except the vocabulary count and the encode
lookup, which run inside the partition that holds the document.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.arrow_kernels import list_offsets, list_parts, row_lengths, row_slices
from ..functions.ordinal import exclusive_prefix_sum, natural_ordinal
from ..functions.portable import uniform_int
from ..functions.skew import HEAVY_KEYS, heavy_hitter_join, heavy_keys
from ..session import checkpoint_dir, scratch_path, shuffles_freed

# Fixed special-token ids of our vocabulary (ours, not a library's).
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
UNK_ID = 3
MASK_ID = 4
SPECIALS = ["<pad>", "<bos>", "<eos>", "<unk>", "<mask>"]
MAX_BROADCAST_VOCAB = 1_000_000  # beyond this the relational encode (a join) is used


def words(text: Column) -> Column:
    """Split on a literal blank, empty pieces dropped (``array_remove`` is code-generated;
    a lambda ``filter`` would be interpreted per element)."""
    return F.array_remove(F.split(text, " "), "")


def build_vocab(df: DataFrame, size: int = 32000, text: str = "text", specials: list[str] = SPECIALS) -> DataFrame:
    """T1 (vocabulary): ``(token, token_id, count)`` for the ``size - len(specials)`` most frequent words.

    Rank by ``(count desc, token)``; ids start after the specials. The text is scanned once: word counts (a
    map-side-combined aggregate) go to the shared checkpoint folder. A histogram of the counts (exact up to 4,096, then
    64 classes per doubling: a few thousand rows to the driver) tells the lowest class that can hold one of the most
    frequent words. Words of this class and above are numbered in their order by ranges with a count per range, so neither
    a huge class of equal counts nor a large vocabulary is sorted in one task. Evaluated when called.
    """
    k = int(size) - len(specials)
    if k <= 0:
        raise ValueError("size must exceed the number of special tokens")
    exact = 4096
    level = F.when(F.col("count") <= exact, F.col("count")).otherwise(
        F.lit(exact + 1) + F.floor(F.log2(F.col("count") / exact) * 64)
    )
    spark = df.sparkSession
    checkpoint_dir(spark)
    counts = (
        df.select(F.explode(words(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("__level", level.cast("bigint"))
        .checkpoint()
    )
    lowest, before = 0, 0
    for r in sorted(counts.groupBy("__level").count().collect(), reverse=True):
        lowest, before = r["__level"], before + r["count"]
        if before >= k:
            break
    ranked = natural_ordinal(
        counts.where(F.col("__level") >= lowest).select((-F.col("count")).alias("__less"), "token", "count"), ["__less", "token"], name="__rank"
    )
    regular = ranked.where(F.col("__rank") < k).select(
        "token", (F.col("__rank") + len(specials)).cast("int").alias("token_id"), F.col("count").cast("bigint")
    )
    special_rows = spark.createDataFrame(
        [(t, i, 0) for i, t in enumerate(specials)], "token string, token_id int, count bigint"
    )
    return special_rows.unionByName(regular)


def encode(
    df: DataFrame,
    vocab: DataFrame,
    keys: list[str],
    text: str = "text",
    out: str = "ids",
    add_bos: bool = True,
    unk_id: int = UNK_ID,
    bos_id: int = BOS_ID,
    specials: int = len(SPECIALS),
    max_broadcast: int = MAX_BROADCAST_VOCAB,
) -> DataFrame:
    """T1 (encode): words -> ids with one begin token in front, no end token, no truncation.

    Narrow: each Arrow batch is split, looked up (hash lookup against the
    vocabulary) and rebuilt as list arrays inside its task, some megabytes of text at a time, so the documents are
    neither exploded to token rows nor exchanged. The vocabulary is bounded by
    its ``size`` (checked here) and shipped once per executor as a broadcast; one of more than
    ``max_broadcast`` words is joined instead (``encode_relational``), with the same result.
    Unknown words map to ``unk_id``; an empty text encodes to ``[bos]``.
    ``encode_relational`` is the same operator in pure DataFrame form.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.arrow_kernels import encode_batches

    regular = vocab.where(F.col("token_id") >= specials).select("token_id", "token")
    # one bounded fetch as Arrow: at most max_broadcast + 1 rows reach the driver
    tbl = regular.orderBy("token_id").limit(max_broadcast + 1).toArrow()
    if tbl.num_rows > max_broadcast:
        return encode_relational(df, vocab, keys, text, out, add_bos, unk_id, bos_id, specials)
    ids = tbl.column("token_id").to_numpy()
    if len(ids) and not (ids == np.arange(specials, specials + len(ids))).all():
        raise ValueError("vocabulary ids must be dense after the specials")
    sc = df.sparkSession.sparkContext
    bvocab = sc.broadcast(tbl.column("token").combine_chunks().cast(pa.string()))
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(key_fields + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    bos = bos_id if add_bos else None

    def run(it):
        yield from encode_batches(it, keys, text, out, bvocab.value, specials, unk_id, bos)

    return df.select(*keys, text).mapInArrow(run, schema)


def encode_relational(
    df: DataFrame,
    vocab: DataFrame,
    keys: list[str],
    text: str = "text",
    out: str = "ids",
    add_bos: bool = True,
    unk_id: int = UNK_ID,
    bos_id: int = BOS_ID,
    specials: int = len(SPECIALS),
) -> DataFrame:
    """T1 (encode), DataFrame form: ``posexplode`` + a join on the vocabulary, whose strategy the planner
    chooses by its size, + ``collect_list`` regrouped by row (sorted by position). Regular words are those
    with ``token_id >= specials``, as in ``encode``; rows with equal keys stay apart."""
    numbered = df.select(*keys, text, F.monotonically_increasing_id().alias("__row"))
    toks = numbered.select("__row", *keys, F.posexplode_outer(words(F.col(text))).alias("__pos", "token"))
    v = vocab.where(F.col("token_id") >= specials).select("token", "token_id")
    looked = toks.join(v, "token", "left").select(
        "__row",
        *keys,
        F.when(
            F.col("__pos").isNotNull(),
            F.struct(F.col("__pos").alias("p"), F.coalesce(F.col("token_id"), F.lit(unk_id)).alias("t")),
        ).alias("__pt"),
    )
    grouped = looked.groupBy("__row", *keys).agg(F.array_sort(F.collect_list("__pt")).alias("__pts"))
    ids = F.transform(F.col("__pts"), lambda x: x["t"])
    if add_bos:
        ids = F.concat(F.array(F.lit(bos_id)), ids)
    return grouped.select(*keys, ids.alias(out))


#: Vectors that a task of the lookup holds in memory, in bytes (more lie in a temporary file), tokens whose vectors it
#: hands on at once, and tokens of a block that are worth another block.
LOOKUP_BYTES, LOOKUP_TOKENS, LOOKUP_BLOCK = 64 << 20, 1 << 15, 1 << 26


def lookup(
    df: DataFrame, table: DataFrame, ids: str, key: str, id_col: str = "token_id", vec: str = "vec", heavy: int = HEAVY_KEYS,
    held_bytes: int = LOOKUP_BYTES, element: str | None = None,
) -> DataFrame:
    """Token id -> vector, order kept; an unknown id raises. ``table`` has one row per id; one row per ``key``.
    The components come out as ``element`` (a wider type than they are moved in), where that is given.

    One counting pass over the ids (combined before the shuffle) gives the distinct ids, which are checked against
    the table, and the heavy ones: an id that holds more than ``1/heavy`` of all tokens takes its vector from a
    broadcast of fewer than ``heavy`` rows, the others meet the table by id.

    A vector is many times the size of its id, so no row per token is exchanged: the rows of ``df`` are dealt by ``key`` to
    blocks, each block gets the vectors of its distinct ids once, and its task puts them in place. The more blocks, the more
    often a vector is moved, and a large table has many ids in every block: blocks are few, and a task whose vectors take
    more than ``held_bytes`` keeps them in a temporary file that it maps. A ``key`` in several rows gets the vectors of
    all of them by position, then by vector, and so does an id with several vectors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "lookup")
    with shuffles_freed(spark):
        df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).where(F.size(ids) > 0).write.parquet(path)
        rows = spark.read.parquet(path)
        counts = rows.select(F.explode("ids").alias(id_col)).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).checkpoint()
        missing = counts.join(table.select(id_col), id_col, "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"id {missing[0][id_col]} has no vector")
        repeated = not rows.groupBy("key").count().where("count > 1").isEmpty()
        blocks, everywhere = _lookup_blocks(counts, table, vec, held_bytes)
    if not repeated:
        rows = rows.withColumn("pos", F.lit(None).cast("array<int>"))
    else:
        places = F.flatten(F.transform("all", lambda a: F.sequence(F.lit(0), F.size(a) - 1)))
        rows = rows.groupBy("key").agg(F.collect_list("ids").alias("all")).select(
            "key", F.flatten("all").alias("ids"), F.when(F.size("all") > 1, places).alias("pos")
        )
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    if everywhere:  # most blocks have most ids: no pass over the tokens to tell which
        need = counts.select(id_col)
    else:
        need = dealt.select("block", F.explode(F.array_distinct("ids")).alias(id_col)).distinct()
    met = heavy_hitter_join(need, table.select(id_col, vec), id_col, heavy_keys(counts, id_col, limit=heavy))
    if everywhere:
        met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    vectors = met.select("block", F.lit(0).alias("kind"), F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    both = vectors.unionByName(dealt.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    placed = both.repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    kinds = rows.schema
    held_type = table.schema[vec].dataType
    held_type = _elements_as(held_type, element) if element else held_type
    arrow = to_arrow_type(held_type) if element else None
    out = T.StructType().add(key, kinds["key"].dataType).add("pos", kinds["pos"].dataType).add("vectors", T.ArrayType(held_type))
    out = placed.mapInArrow(lambda batches: _place_vectors(batches, held_bytes, arrow), out)
    by_place = F.transform(F.array_sort(F.arrays_zip("pos", "vectors")), lambda x: x["vectors"])
    return out.select(key, F.when(F.col("pos").isNull(), F.col("vectors")).otherwise(by_place).alias("vectors"))


def _elements_as(kind: T.DataType, element: str) -> T.DataType:
    return T.ArrayType(_elements_as(kind.elementType, element)) if isinstance(kind, T.ArrayType) else T.DataType.fromDDL(element)


def _lookup_blocks(counts: DataFrame, table: DataFrame, vec: str, held_bytes: int) -> tuple[int, bool]:
    """Blocks of rows, and whether a block is expected to need more than half of all ids.

    Two blocks per core, or one where all vectors moved would weigh more than the ids (4 bytes each); twice as many as long as a
    block is expected to need more than ``held_bytes`` of vectors or has more than LOOKUP_BLOCK tokens, but only while all
    vectors moved weigh half of the ids at most."""
    kind = table.schema[vec].dataType
    width = table.agg(F.max(F.size(vec))).first()[0] if isinstance(kind, T.ArrayType) else 1
    size = {T.FloatType(): 4, T.ShortType(): 2, T.ByteType(): 1, T.IntegerType(): 4}.get(getattr(kind, "elementType", kind), 8)
    cores = counts.sparkSession.sparkContext.defaultParallelism
    tried = [cores << i for i in range(14)]
    n = F.col("n")
    ids, tokens, *expected = counts.agg(F.count(n), F.sum(n), *[F.sum(1 - F.pow(F.lit(1 - 1 / b), n)) for b in tried]).first()
    share = [(each or 0) / max(1, ids) for each in expected]
    weigh = [b * (each or 0) * (width or 1) * size for b, each in zip(tried, expected)]
    tokens = tokens or 0
    at = 1 if weigh[1] <= 4 * tokens or weigh[1] <= LOOKUP_BYTES else 0
    while at and at + 1 < len(tried) and weigh[at + 1] <= 2 * tokens and (weigh[at] > tried[at] * held_bytes or tokens > tried[at] * LOOKUP_BLOCK):
        at += 1
    return tried[at], share[at] > 0.5


def _place_vectors(batches: Iterator[pa.RecordBatch], held_bytes: int, as_type: pa.DataType | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ids to rows of vectors; the vectors of a block (``kind`` 0) come before its rows (``kind`` 1)."""
    block, parts, held = None, None, None
    for batch in batches:
        of = batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column("kind").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
        for at, upto in zip(edges[:-1], edges[1:]):
            run = batch.slice(at, upto - at)
            if of[at] // 2 != block:
                block, parts, held = of[at] // 2, _Vectors(held_bytes), None
            if of[at] % 2 == 0:
                parts.add(run.column("id"), run.column("vec"))
                continue
            if held is None:
                held, parts = parts.held(), None
            for rows in _vectors_of(run, *held):
                if as_type is not None:
                    lists = rows.column("vectors")
                    lists = pa.ListArray.from_arrays(lists.offsets, lists.values.cast(as_type))
                    rows = pa.RecordBatch.from_arrays([*rows.columns[:2], lists], names=rows.schema.names)
                yield rows


class _Vectors:
    """The vectors of one block. Beyond ``limit`` bytes, lists of numbers go to a temporary file without a name; nulls stay in memory."""

    def __init__(self, limit: int):
        self.limit, self.size, self.file, self.kind = limit, 0, None, None
        self.parts, self.filed, self.lengths = [], [], []

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        self.parts.append((ids, vectors))
        self.size += vectors.nbytes
        if self.size > self.limit:
            self._put()

    def _put(self) -> None:
        kept = []
        for ids, vectors in self.parts:
            kind = vectors.type
            plain = (pa.types.is_list(kind) or pa.types.is_large_list(kind)) and (pa.types.is_floating(kind.value_type) or pa.types.is_integer(kind.value_type))
            if not plain or vectors.null_count or vectors.flatten().null_count:
                kept.append((ids, vectors))
                continue
            numbers = vectors.flatten().to_numpy()
            if self.file is None:
                self.file, self.kind = tempfile.TemporaryFile(), kind
            self.file.write(np.ascontiguousarray(numbers))
            self.filed.append(ids)
            self.lengths.append(row_lengths(vectors) - 1)
        self.parts = kept
        self.size = 0

    def held(self) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray | None]:
        """Distinct ids, all vectors, where the vectors of each id begin and how many they are, and their order (None: as they are)."""
        ids, vectors = self.filed + [x for x, _ in self.parts], [x for _, x in self.parts]
        if self.file is not None:
            self.file.flush()
            ends = np.cumsum(np.concatenate([[0], *self.lengths]), dtype=np.int64)
            values = pa.array([], self.kind.value_type)
            if ends[-1]:
                # mapped: its pages belong to the system, and the file goes with the last reference
                raw = pa.py_buffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ))
                values = pa.Array.from_buffers(self.kind.value_type, int(ends[-1]), [None, raw])
            mapped = pa.LargeListArray.from_arrays(pa.array(ends), values)
            vectors = [mapped] + [x.cast(mapped.type) for x in vectors]
            self.file.close()
        ids, vectors = pa.concat_arrays(ids), vectors[0] if len(vectors) == 1 else pa.concat_arrays(vectors)
        names = ids.unique()
        code = pc.index_in(ids, value_set=names).to_numpy(zero_copy_only=False)
        many = np.bincount(code, minlength=len(names))
        order = np.argsort(code, kind="stable") if len(names) < len(ids) else None
        return names, vectors, np.cumsum(many) - many, many, order


def _vectors_of(
    rows: pa.RecordBatch, names: pa.Array, vectors: pa.Array, first: np.ndarray, many: np.ndarray, order: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    alone = bool((many == 1).all())
    for wide in row_slices(rows, row_lengths(rows.column("ids")), 32 * LOOKUP_TOKENS):
        column = wide.column("ids")
        code = pc.index_in(column.flatten().cast(names.type), value_set=names).to_numpy(zero_copy_only=False)
        code_of = pa.ListArray.from_arrays(pa.array(list_offsets(pc.list_value_length(column).to_numpy())), pa.array(code, pa.int32()))
        wide = wide.append_column("code", code_of)
        for part in row_slices(wide, row_lengths(code_of), LOOKUP_TOKENS):
            at, sizes = list_parts(part.column("code"))
            pos = part.column("pos")
            if not alone:
                row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                given = np.repeat(pos.is_valid().to_numpy(zero_copy_only=False), sizes)
                place[given] = pos.flatten().to_numpy(zero_copy_only=False)
                copies = many[at]
                nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                sizes = np.bincount(row, weights=copies, minlength=len(sizes)).astype(np.int64)
                at = np.repeat(first[at], copies) + nth
                at = at if order is None else order[at]
                pos = pa.ListArray.from_arrays(pa.array(list_offsets(sizes)), pa.array(np.repeat(place, copies), pa.int32()))
            found = vectors.take(pa.array(at))
            if pa.types.is_large_list(found.type):
                found = found.cast(pa.list_(found.type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(list_offsets(sizes)), found)
            yield pa.RecordBatch.from_arrays([part.column("key"), pos, lists], names=["key", "pos", "vectors"])


def pack(
    df: DataFrame,
    seq_len: int,
    ids: str = "ids",
    ordinal: str = "ordinal",
    group_docs: int = 1000,
    max_sequences: int | None = None,
) -> DataFrame:
    """T3 (+M4): concatenate each group of ``group_docs`` consecutive documents, cut into
    chunks of ``seq_len + 1`` tokens, drop the group's tail.

    A group with fewer tokens than one chunk yields nothing; no separator is
    added between documents. Work is one row per *document piece*: each
    document is split at the chunk boundaries it crosses (``sequence`` over the
    chunk indices it touches), and pieces are reassembled per chunk sorted by
    their offset. One exchange (by group) carries the encoded documents; the
    chunk regroup and the seq-id join reuse that partitioning.

    Output: ``seq_id`` (dense, in (group, chunk) order), ``group_id``, ``chunk``, ``input_ids``.
    """
    C = int(seq_len) + 1
    G = int(group_docs)
    d = df.select(F.col(ordinal).alias("__ord"), F.col(ids).alias("__ids"))
    d = d.withColumn("group_id", F.floor(F.col("__ord") / F.lit(G)).cast("bigint")).withColumn(
        "__n", F.size("__ids").cast("bigint")
    )
    run = Window.partitionBy("group_id").orderBy("__ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("group_id")
    d = d.withColumn("__start", F.sum("__n").over(run) - F.col("__n")).withColumn(
        "__chunks", F.floor(F.sum("__n").over(whole) / F.lit(C)).cast("bigint")
    )
    groups = d.groupBy("group_id").agg(F.first("__chunks").alias("__chunks"))
    offsets = exclusive_prefix_sum(groups, "group_id", "__chunks", "__seq_off")
    live = d.where((F.col("__n") > 0) & (F.col("__start") < F.col("__chunks") * C))
    first = F.floor(F.col("__start") / F.lit(C))
    last = F.least(F.floor((F.col("__start") + F.col("__n") - 1) / F.lit(C)), F.col("__chunks") - 1)
    pieces = live.select("group_id", "__start", "__n", "__ids", F.explode(F.sequence(first, last)).alias("chunk"))
    lo = F.greatest(F.col("chunk") * C, F.col("__start"))
    hi = F.least((F.col("chunk") + 1) * C, F.col("__start") + F.col("__n"))
    pieces = pieces.select(
        "group_id",
        "chunk",
        F.struct(
            lo.alias("o"), F.slice("__ids", (lo - F.col("__start") + 1).cast("int"), (hi - lo).cast("int")).alias("p")
        ).alias("__pc"),
    )
    # sort_array orders the pieces by offset; "__pcs.p" extracts the arrays without a lambda
    seqs = pieces.groupBy("group_id", "chunk").agg(F.sort_array(F.collect_list("__pc")).alias("__pcs"))
    seqs = seqs.join(offsets.select("group_id", "__seq_off"), "group_id").select(
        (F.col("__seq_off") + F.col("chunk")).cast("bigint").alias("seq_id"),
        "group_id",
        F.col("chunk").cast("bigint").alias("chunk"),
        F.flatten(F.col("__pcs.p")).alias("input_ids"),
    )
    if max_sequences is not None:
        seqs = seqs.where(F.col("seq_id") < F.lit(int(max_sequences)))
    return seqs


CONTINUOUS = "chunk long, offset int, ids array<int>"


def pack_continuous(
    df: DataFrame, seq_len: int, ids: str = "ids", ordinal: str = "ordinal", lead: list[int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """All documents as one run of tokens in ``ordinal`` order, after the tokens ``lead``, cut into chunks of ``seq_len + 1``.

    Returns ``(chunk, input_ids)`` with the complete chunks, and ``(chunk, ids)`` with the unfinished last one
    (no row if the run ends with a chunk). Token counts are the carry, and they add up associatively: the documents are
    dealt out by ranges of the ordinal, one count per range gives each range its place in the run, and every
    task cuts its own chunks. Only what is left before the first and after the last boundary of a range (less than a chunk
    each) is put together by chunk. No task sees more than its range, however long the run is. Null arrays count as empty.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    C = int(seq_len) + 1
    lead = list(lead or [])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.select(F.col(ordinal).alias("__ord"), F.col(ids).cast("array<int>").alias("ids"))
    ranged = rows.repartitionByRange(parts, "__ord").sortWithinPartitions("__ord").checkpoint()
    ranged = ranged.select("ids", F.spark_partition_id().alias("part"))
    sizes = F.sum(F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(0))
    counted = ranged.groupBy("part").agg(sizes.cast("bigint").alias("n")).collect()  # one row per range
    starts, total = {}, len(lead)
    for r in sorted(counted, key=lambda r: r["part"]):
        starts[r["part"]] = total
        total += r["n"]
    places = spark.sparkContext.broadcast(starts)

    def cut(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, np.zeros(0, np.int32)

            def piece(tokens):
                return _chunk_rows(np.array([at // C]), np.array([at % C]), tokens, np.array([len(tokens)]))

            for b in batches:
                if not b.num_rows:
                    continue
                at = places.value[b.column("part")[0].as_py()] if at is None else at
                column = b.column("ids")
                held = np.concatenate([held, column.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False)])
                first = -at % C
                if len(held) < first:
                    continue
                if first:
                    if not whole:
                        yield piece(held[:first])
                    at, held = at + first, held[first:]
                n = len(held) // C
                if whole and n:
                    yield _chunk_rows(at // C + np.arange(n), np.zeros(n), held[: n * C], np.full(n, C))
                at, held = at + n * C, held[n * C :].copy()
            if len(held) and not whole:
                yield piece(held)

        return run

    whole = ranged.mapInArrow(cut(True), CONTINUOUS).select("chunk", F.col("ids").alias("input_ids"))
    pieces = ranged.mapInArrow(cut(False), CONTINUOUS)
    if lead:
        pieces = pieces.unionByName(spark.createDataFrame([(0, 0, lead)], CONTINUOUS))
    # two pieces per range at most
    joined = pieces.groupBy("chunk").agg(F.flatten(F.array_sort(F.collect_list(F.struct("offset", "ids")))["ids"]).alias("ids"))
    done = joined.where(F.size("ids") == C).select("chunk", F.col("ids").alias("input_ids"))
    return whole.unionByName(done), joined.where(F.size("ids") < C)


def _chunk_rows(chunk: np.ndarray, offset: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(tokens, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.int64()), pa.array(offset.astype(np.int32)), lists], names=["chunk", "offset", "ids"]
    )


def pack_groups(df: DataFrame, seq_len: int, ids: str = "ids", ordinal: str = "ordinal", group_docs: int = 1000) -> DataFrame:
    """Per-group token accounting used by ``pack_report``: tokens in, kept, chunks."""
    C = int(seq_len) + 1
    return (
        df.select(F.floor(F.col(ordinal) / F.lit(int(group_docs))).cast("bigint").alias("group_id"), F.size(ids).alias("n"))
        .groupBy("group_id")
        .agg(F.sum("n").cast("bigint").alias("tokens_in"), F.count(F.lit(1)).alias("docs"))
        .withColumn("chunks", F.floor(F.col("tokens_in") / F.lit(C)).cast("bigint"))
        .withColumn("tokens_kept", F.col("chunks") * F.lit(C))
    )


def reference_mask_id(vocab_size: int, mask_token_id: int | None = None, end_id: int = EOS_ID) -> int:
    """The reference's mask-id rule, kept as an option (our default is ``MASK_ID``):
    the tokenizer's own mask token, else 128000 when the vocabulary is larger
    than 128000 (which in that vocabulary is the begin token, so it collides),
    else the end token."""
    if mask_token_id is not None:
        return int(mask_token_id)
    if vocab_size > 128000:
        return 128000
    return int(end_id)


def mask_pairs(
    df: DataFrame,
    p: float = 0.15,
    mask_id: int = MASK_ID,
    seed: int = 42,
    ids: str = "input_ids",
    key: str = "seq_id",
) -> DataFrame:
    """T4: ``target_ids`` = clean copy; ``context_ids`` = each position independently
    replaced by ``mask_id`` with probability ``p`` (every position eligible).

    The draw is ``uniform_int(seed, seq_id, position)``, a pure function of the
    row's key and position, so masking is reproducible and partition-independent
    (the reference's masking is unseeded). One draw per token is the hottest
    expression of the chain, so it runs vectorised on slices of each Arrow batch (a narrow
    map, no shuffle); ``mask_pairs_sql`` is the same operator as a column
    expression. Never ``rand()`` inside a lambda.
    """
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must be in [0, 1]")
    from ..functions.arrow_kernels import mask_batches

    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("context_ids", T.ArrayType(T.IntegerType())),
            T.StructField("target_ids", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(it):
        yield from mask_batches(it, key, ids, float(p), int(mask_id), int(seed))

    return df.select(key, F.col(ids).cast("array<int>").alias(ids)).mapInArrow(run, schema)


def mask_pairs_sql(
    df: DataFrame, p: float = 0.15, mask_id: int = MASK_ID, seed: int = 42, ids: str = "input_ids", key: str = "seq_id"
) -> DataFrame:
    """T4 as a column expression: the draws and so the masks of ``mask_pairs`` (interpreted per element; slower)."""
    k = F.col(key)
    ctx = F.transform(F.col(ids), lambda t, i: F.when(uniform_int(seed, k, i) < F.lit(p), F.lit(mask_id)).otherwise(t))
    return df.select(key, ctx.alias("context_ids"), F.col(ids).alias("target_ids"))


def pack_report(groups: DataFrame, pairs: DataFrame, seq_len: int, mask_id: int = MASK_ID) -> DataFrame:
    """T5: one-row report. Sequences, total tokens = sequences x (seq_len + 1), seq length,
    measured mask rate; plus tokens in, tokens dropped in tails, groups dropped.

    The mask rate counts context positions holding ``mask_id``: exact for a
    dedicated mask token, an upper bound if real tokens can carry that id."""
    C = int(seq_len) + 1
    g = groups.agg(
        F.sum("tokens_in").cast("bigint").alias("tokens_in"),
        F.sum("tokens_kept").cast("bigint").alias("tokens_kept"),
        F.count(F.lit(1)).cast("bigint").alias("groups"),
        F.sum(F.when(F.col("chunks") == 0, 1).otherwise(0)).cast("bigint").alias("groups_dropped"),
    )
    masked = F.aggregate(F.col("context_ids"), F.lit(0).cast("bigint"), lambda a, t: a + F.when(t == mask_id, 1).otherwise(0))
    s = pairs.agg(
        F.count(F.lit(1)).cast("bigint").alias("sequences"),
        F.coalesce(F.sum(masked), F.lit(0)).cast("bigint").alias("masked_tokens"),
    )
    # both sides are one-row aggregates: an equi-join on a constant key
    r = s.withColumn("__k", F.lit(1)).join(g.withColumn("__k", F.lit(1)), "__k")
    return r.select(
        "sequences",
        (F.col("sequences") * F.lit(C)).cast("bigint").alias("total_tokens"),
        F.lit(int(seq_len)).cast("bigint").alias("seq_len"),
        F.when(F.col("sequences") > 0, F.col("masked_tokens") / (F.col("sequences") * F.lit(C))).alias("mask_rate"),
        "tokens_in",
        (F.col("tokens_in") - F.col("tokens_kept")).cast("bigint").alias("tokens_dropped"),
        "groups",
        "groups_dropped",
    )


def next_token_pairs(df: DataFrame, key: str, col: str, score: str = "score", label: str = "label") -> DataFrame:
    """Element ``i`` of ``col`` against element ``i+1`` (positions 0..L-2 vs 1..L-1)."""
    n = F.size(col) - 1
    zipped = F.arrays_zip(F.slice(col, 1, n).alias(score), F.slice(col, 2, n).alias(label))
    return df.where(F.size(col) >= 2).select(key, F.posexplode(zipped).alias("pos", "__z")).select(
        key, F.col("pos").cast("bigint").alias("pos"), F.col(f"__z.{score}").alias(score), F.col(f"__z.{label}").alias(label)
    )
