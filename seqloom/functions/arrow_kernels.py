"""Vectorised per-batch helpers for ``mapInArrow`` (Arrow compute + numpy, no per-row Python).

Used where the work is one small operation per *token* and a relational
formulation would either explode every token into a row or evaluate an
interpreted lambda per element. Spark still partitions and schedules the
work; these functions only transform one Arrow record batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .portable import _MIX_MULT, _P31

#: Bytes of text and tokens that a kernel works on at once. Its arrays take several times that, the whole batch only what
#: it holds already, so a task's memory does not follow from the rows that Spark puts in a batch.
TEXT_BYTES, TOKENS = 4 << 20, 1 << 18


def row_slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``sizes`` add up to ``limit`` at most; a larger row stands alone."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def row_lengths(arr: pa.Array) -> np.ndarray:
    """Bytes of strings or elements of lists, 0 for null, and 1 for the row itself."""
    length = pc.list_value_length if pa.types.is_list(arr.type) or pa.types.is_large_list(arr.type) else pc.binary_length
    return length(arr).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def mix31(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> 16)
    x = (x * _MIX_MULT) % _P31
    x = x ^ (x >> 16)
    x = (x * _MIX_MULT) % _P31
    return x ^ (x >> 16)


def uniform_int(seed: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """numpy twin of ``portable.uniform_int`` (bit-identical)."""
    a = a.astype(np.int64)
    b = b.astype(np.int64)
    h = mix31(np.int64(int(seed) % _P31))
    h = mix31(h ^ (a % _P31))
    h = mix31(h ^ ((a >> 31) % _P31))
    h = mix31(h ^ (b % _P31))
    return h.astype(np.float64) / float(_P31)


def list_parts(arr: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, per-row lengths) of a list array, respecting slicing and nulls."""
    lengths = pc.list_value_length(arr).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return arr.flatten().to_numpy(zero_copy_only=False), lengths


def list_offsets(lengths: np.ndarray) -> np.ndarray:
    """32-bit list offsets of consecutive lists; raises where a batch holds more elements than these can count."""
    ends = np.cumsum(lengths, dtype=np.int64)
    if len(ends) and ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("more than 2^31 - 1 elements in one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return np.concatenate([[0], ends]).astype(np.int32)


def mask_batches(
    batches: Iterator[pa.RecordBatch], key: str, ids: str, p: float, mask_id: int, seed: int, limit: int = TOKENS
) -> Iterator[pa.RecordBatch]:
    """``mask_batch`` over slices of ``limit`` tokens."""
    for batch in batches:
        for part in row_slices(batch, row_lengths(batch.column(ids)), limit):
            yield mask_batch(part, key, ids, p, mask_id, seed)


def mask_batch(batch: pa.RecordBatch, key: str, ids: str, p: float, mask_id: int, seed: int) -> pa.RecordBatch:
    seq = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
    col = batch.column(ids)
    flat, lengths = list_parts(col)
    starts = np.cumsum(lengths) - lengths
    pos = np.arange(flat.shape[0], dtype=np.int64) - np.repeat(starts, lengths)
    u = uniform_int(seed, np.repeat(seq, lengths), pos)
    ctx = np.where(u < p, np.int32(mask_id), flat.astype(np.int32))
    offsets = pa.array(list_offsets(lengths))
    context = pa.ListArray.from_arrays(offsets, pa.array(ctx, pa.int32()))
    target = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32), pa.int32()))
    return pa.RecordBatch.from_arrays([batch.column(key), context, target], names=[key, "context_ids", "target_ids"])


def encode_batches(
    batches: Iterator[pa.RecordBatch],
    keys: list[str],
    text: str,
    out: str,
    value_set: pa.Array,
    first_id: int,
    unk_id: int,
    bos_id: int | None,
    limit: int = TEXT_BYTES,
) -> Iterator[pa.RecordBatch]:
    """``encode_batch`` over slices of ``limit`` bytes of text, or as many as the vocabulary has (each slice hashes it anew)."""
    limit = max(limit, value_set.nbytes)
    for batch in batches:
        for part in row_slices(batch, row_lengths(batch.column(text)), limit):
            yield encode_batch(part, keys, text, out, value_set, first_id, unk_id, bos_id)


def encode_batch(
    batch: pa.RecordBatch,
    keys: list[str],
    text: str,
    out: str,
    value_set: pa.Array,
    first_id: int,
    unk_id: int,
    bos_id: int | None,
) -> pa.RecordBatch:
    """Split on a literal blank, drop empty pieces, look words up in ``value_set``
    (the vocabulary in id order, ids from ``first_id``), put ``bos_id`` in front."""
    parts = pc.split_pattern(batch.column(text), pattern=" ")
    lengths = pc.list_value_length(parts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    counts = np.bincount(rows[keep], minlength=len(lengths)).astype(np.int64)
    idx = pc.index_in(pc.filter(flat, pa.array(keep)), value_set=value_set)
    ids = (idx.to_numpy(zero_copy_only=False) if idx.null_count == 0 else pc.fill_null(idx, -1).to_numpy(zero_copy_only=False))
    ids = np.where(ids < 0, unk_id, ids + first_id).astype(np.int32)
    extra = 1 if bos_id is not None else 0
    sizes = counts + extra
    offsets = list_offsets(sizes)
    if extra:
        outv = np.empty(int(offsets[-1]), dtype=np.int32)
        heads = offsets[:-1]
        outv[heads] = bos_id
        body = np.ones(outv.shape[0], dtype=bool)
        body[heads] = False
        outv[body] = ids
    else:
        outv = ids
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(outv, pa.int32()))
    cols = [batch.column(k) for k in keys] + [lists]
    return pa.RecordBatch.from_arrays(cols, names=list(keys) + [out])
