"""Scans with memory: decayed scan, read-before-write, surprise, final state,
momentum scan, readout scoring (E1-E6).

Recurrence per key in ``order``: ``h_t = d * h_{t-1} + g * x_t`` with ``h_{-1} = 0``
(``g = 1 - d`` for the decayed scan, ``g = 1`` for momentum); ``x`` is a number or an
``array<double>``, then ``h`` is an array of that length.

One exchange, whatever the keys look like:

1. the rows are range-partitioned and sorted by ``(key, order)``, so that a key holding
   most rows is spread over many tasks, and written to the shared folder, which fixes
   the partitions;
2. a pass over the key and value columns yields one row per partition: its first and last key,
   their row counts and the last key's state when it starts from zero;
3. the states carried from partition to partition follow on the driver (one step per
   partition, independent of the number of rows and keys);
4. a second pass over the partitions runs the recurrence itself, starting each
   partition's first key from the carried state.

Inside a batch the recurrence is solved for all rows at once by doubling: after the step with
stride s every state holds the last 2s terms of its key, so log2 of the longest run of a key steps
suffice (``h_t += d^s * h_{t-s}``). Nothing is truncated: a stride whose power of d is no longer a number
above 0 has nothing to add to finite values, and runs with an infinite or NaN value, a null, or vectors of
differing lengths take the recurrence as written. Across batches and partitions ``h = d^n * carried + own``.
Keys are equal as Spark's grouping has them: null equals null, NaN equals NaN, -0.0 equals 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DECAY = 0.9
DEFAULT_MOMENTUM = 0.95


def _same(a, b) -> bool:
    """Equality of key values as in Spark's grouping."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (a != a and b != b)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


class _Runs:
    """Rows of one partition in key order, as runs of equal keys; a run may go on in the next batch."""

    def __init__(self, batches: Iterator[pa.RecordBatch], key: str, value: str):
        self.batches, self.key, self.value = batches, key, value

    def __iter__(self):
        """(batch, keys, first row of each run, whether the first run starts a new key, values) per batch."""
        last = None
        for b in self.batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(self.key)
            keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
            change = np.zeros(n, bool)
            if n > 1:
                a, z = keys.slice(0, n - 1), keys.slice(1)
                if pa.types.is_nested(keys.type):
                    change[1:] = [not _same(x, y) for x, y in zip(a.to_pylist(), z.to_pylist(), strict=True)]
                else:
                    differ = pc.fill_null(pc.not_equal(a, z), False)
                    if pa.types.is_floating(keys.type):
                        nan = pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(z)), False)
                        differ = pc.and_not(differ, nan)
                    change[1:] = pc.or_(differ, pc.xor(a.is_null(), z.is_null())).to_numpy(zero_copy_only=False)
            fresh = last is None or not _same(last[0], keys[0].as_py())
            change[0] = True
            last = (keys[n - 1].as_py(),)
            yield b, keys, np.flatnonzero(change), fresh, _Values(b.column(self.value))


class _Values:
    """A value column: ``x`` as an array (rows, or rows x elements) if every row has a value of one length, else None."""

    def __init__(self, column: pa.Array):
        self.column, self.x = column, None
        self.is_list = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
        if self.is_list:
            sizes = pc.list_value_length(column)
            low, high = pc.min_max(sizes).as_py().values() if len(column) else (0, 0)
            flat = column.flatten()
            if not column.null_count and low == high and not flat.null_count:
                self.x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), low)
        elif not column.null_count:
            self.x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        if self.x is not None and not np.isfinite(self.x).all():
            self.x = None

    def plain(self) -> list:
        if self.is_list:
            return [None if v is None else np.array(v, np.float64) for v in self.column.to_pylist()]
        return self.column.cast(pa.float64()).to_pylist()


def _step(d: float, g: float, h, x):
    """One step; a null value makes the state null from there on, as arithmetic on null does."""
    if h is None or x is None:
        return None
    return d * h + g * x


def _zero(x):
    return np.zeros(len(x)) if isinstance(x, np.ndarray) else 0.0


def _finite(h) -> bool:
    return h is not None and bool(np.isfinite(h).all())


def segmented_recurrence(x: np.ndarray, starts: np.ndarray, d: float, g: float, carried=None) -> np.ndarray:
    """``h_t = d * h_{t-1} + g * x_t`` over rows, from zero at each of ``starts`` (the first one from ``carried``)."""
    n = len(x)
    sizes = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, sizes)  # rows of the run before each row
    h = g * x
    longest = int(sizes.max()) if n else 0
    stride, power = 1, d
    while stride < longest and power > 0.0:
        at = np.flatnonzero(place >= stride)
        h[at] += power * h[at - stride]
        stride, power = 2 * stride, power * power
    if carried is not None:
        weight = np.power(d, np.arange(1.0, sizes[0] + 1))
        h[: sizes[0]] += (weight[:, None] if h.ndim == 2 else weight) * np.asarray(carried)
    return h


def _states(values: _Values, starts: np.ndarray, d: float, g: float, k: int, h):
    """States after the rows of a batch, and before them. The first run goes on after ``k`` rows with state ``h`` (k = 0: anew)."""
    n = len(values.column)
    if values.x is not None and (k == 0 or (_finite(h) and np.shape(h) == values.x.shape[1:])):
        after = segmented_recurrence(values.x, starts, d, g, h if k else None)
        before = np.zeros_like(after)
        before[1:] = after[:-1]
        before[starts] = 0.0
        if k:
            before[0] = h
        return after, before
    after, before, new = [], [], set(starts.tolist())
    for t, v in enumerate(values.plain()):
        if t in new and (t or not k):
            h = 0.0 if v is None else _zero(v)
        before.append(h)
        h = _step(d, g, h, v)
        after.append(h)
    assert len(after) == n
    return after, before


def _linear_scan(
    df: DataFrame, key: str, order: list[str], value: str, decay: float, gain: float, out: str, prev: str | None
) -> DataFrame:
    from ..session import checkpoint_dir

    d, g = float(decay), float(gain)
    if not 0.0 <= d <= 1.0:
        raise ValueError("decay must be in [0, 1]")
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    is_array = isinstance(df.schema[value].dataType, T.ArrayType)
    state = T.ArrayType(T.DoubleType()) if is_array else T.DoubleType()
    arrow_state = pa.list_(pa.float64()) if is_array else pa.float64()
    ranged = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).checkpoint()
    # the number of the written partition, also where the result is part of a larger stage
    ranged = ranged.withColumn("__part", F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        rows, one, h = 0, True, None
        for b, keys, starts, fresh, values in _Runs(batches, key, value):
            part = b.column("__part")[0].as_py()
            first = keys.slice(0, 1) if first is None else first
            if fresh or len(starts) > 1:
                one = one and len(starts) == 1 and last is None
            after, _ = _states(values, starts, d, g, 0 if fresh else rows, h)
            h = after[len(after) - 1]
            rows = b.num_rows - int(starts[-1]) + (rows if len(starts) == 1 and not fresh else 0)
            last = keys.slice(b.num_rows - 1, 1)
        if first is not None:
            plain = None if h is None else np.asarray(h).tolist() if is_array else float(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), first, last, pa.array([one]), pa.array([rows], pa.int64()), pa.array([plain], arrow_state)],
                names=["part", "first", "last", "one", "rows", "h"],
            )

    kind = df.schema[key].dataType
    fields = T.StructType().add("part", "long").add("first", kind).add("last", kind).add("one", "boolean").add("rows", "long").add("h", state)
    found = sorted(ranged.select(key, value, "__part").mapInArrow(ends, fields).collect(), key=lambda r: r["part"])  # one row per partition
    carried: dict[int, tuple] = {}  # partition -> (rows of its first key before it, state)
    for before, r in zip(found[:-1], found[1:], strict=True):
        if _same(before["last"], r["first"]):
            n, h = before["rows"], before["h"]
            if before["one"] and before["part"] in carried:
                m, earlier = carried[before["part"]]
                n = m + before["rows"]
                if h is None or earlier is None:
                    h = None
                else:
                    h = np.array(h) + d ** before["rows"] * np.array(earlier)
                    h = h.tolist() if is_array else float(h)
            carried[r["part"]] = (n, h)
    shared = spark.sparkContext.broadcast(carried)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, h, begun = 0, None, False
        for b, _, starts, fresh, values in _Runs(batches, key, value):
            if not begun:
                k, h = shared.value.get(b.column("__part")[0].as_py(), (0, None))
                h = np.array(h) if is_array and h is not None else h
                begun = True
            elif fresh:
                k = 0
            after, before = _states(values, starts, d, g, k, h)
            n = b.num_rows
            index = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            index[: starts[1] if len(starts) > 1 else n] += k
            k, h = int(index[-1]) + 1, after[n - 1]
            extra, names = [pa.array(index, pa.int64()), _arrow(after, arrow_state)], ["k", out]
            if prev:
                extra.append(_arrow(before, arrow_state))
                names.append(prev)
            own = b.schema.names[:-1]  # without the partition number
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], names=[*own, *names])

    kept = [f for f in df.schema.fields if f.name not in ("k", out, prev)]
    result = T.StructType(list(kept)).add("k", "long").add(out, state)
    result = result.add(prev, state) if prev else result
    return ranged.select(*[f.name for f in kept], "__part").mapInArrow(scan, result)


def _arrow(states, kind: pa.DataType) -> pa.Array:
    if isinstance(states, np.ndarray):
        if states.ndim == 1:
            return pa.array(states, kind)
        ends = pa.array(np.arange(len(states) + 1, dtype=np.int32) * states.shape[1])
        return pa.ListArray.from_arrays(ends, pa.array(states.ravel()))
    if pa.types.is_list(kind):  # the state before a key's first null is null, not a number
        return pa.array([y.tolist() if isinstance(y, np.ndarray) else None for y in states], kind)
    return pa.array(states, kind)


def decay_scan(
    df: DataFrame,
    key: str,
    order: list[str],
    value: str,
    decay: float = DEFAULT_DECAY,
    out: str = "h",
    emit_previous: str | None = None,
) -> DataFrame:
    """E1 (+E2 with ``emit_previous``): ``h_t = d*h_{t-1} + (1-d)*x_t`` per key, for numbers or vectors.

    Adds ``k`` (row index in the key), ``out`` (the state after row t) and,
    if ``emit_previous`` is given, the read-before-write value ``h_{t-1}``
    (0 at the first row) under that name. d=0 gives h=x; d=1 gives h=0. A null value makes the
    key's state null from that row on.
    """
    return _linear_scan(df, key, order, value, decay, 1.0 - float(decay), out, emit_previous)


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y.cast("double")) * (x - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def surprise(df: DataFrame, prev: str, value: str, readout: Column | None = None) -> DataFrame:
    """Mean over all rows of ``(readout(h_{t-1}) - x_t)^2`` (not a mean of per-key means); vectors: over all elements."""
    r = readout if readout is not None else F.col(prev)
    if isinstance(df.schema[value].dataType, T.ArrayType):
        return df.agg(
            (F.sum(_squared(r, F.col(value))) / F.sum(F.size(value))).alias("surprise"), F.count(F.lit(1)).cast("bigint").alias("rows")
        )
    sq = F.pow(r - F.col(value).cast("double"), 2)
    return df.agg(F.avg(sq).alias("surprise"), F.count(F.lit(1)).cast("bigint").alias("rows"))


def final_state(scanned: DataFrame, key: str, out: str = "h", index: str = "k") -> DataFrame:
    """The state after each key's last row, the hand-off from history to step mode.

    ``max_by`` is a streaming aggregate with partial aggregation: no key is
    collected into memory.
    """
    return scanned.groupBy(key).agg(
        F.max_by(out, index).alias(out), (F.max(index) + 1).cast("bigint").alias("rows")
    )


def momentum_scan(
    df: DataFrame,
    key: str,
    order: list[str],
    grad: str,
    momentum: float = DEFAULT_MOMENTUM,
    lookahead: bool = True,
) -> DataFrame:
    """E5: ``buf = m*buf + g`` (no ``1-m``); output ``g + m*buf`` (look-ahead) or ``buf``."""
    res = _linear_scan(df, key, order, grad, momentum, 1.0, "buf", None)
    if not lookahead:
        return res.withColumn("update", F.col("buf"))
    m = F.lit(float(momentum))
    if isinstance(df.schema[grad].dataType, T.ArrayType):
        return res.withColumn("update", F.zip_with(F.col(grad), F.col("buf"), lambda x, b: x.cast("double") + m * b))
    return res.withColumn("update", F.col(grad).cast("double") + m * F.col("buf"))


def mlp_readout(col: Column, w1: list[list[float]], w2: list[list[float]], spark=None) -> Column:
    """``W2 . silu(W1 . h)`` with no bias for an ``array<double>`` state ``h`` (null: null).

    ``w1`` is width x dim, ``w2`` is dim x width. The weights are shipped once per executor as a
    broadcast and applied by an Arrow ``pandas_udf`` with one numpy matrix product per batch.
    """
    from pyspark.sql import SparkSession

    session = spark or SparkSession.getActiveSession()
    bw = session.sparkContext.broadcast((np.asarray(w1, dtype=np.float64), np.asarray(w2, dtype=np.float64)))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def readout(h: pd.Series) -> pd.Series:
        out: list = [None] * len(h)
        there = np.flatnonzero(h.notna().to_numpy())
        if len(there):
            a, b = bw.value
            z = np.stack(h.iloc[there].to_numpy()).astype(np.float64) @ a.T
            for k, row in zip(there, (z / (1.0 + np.exp(-z))) @ b.T, strict=True):
                out[k] = row
        return pd.Series(out, dtype=object)

    return readout(col.cast("array<double>"))
