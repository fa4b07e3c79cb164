"""Column standardising, truncation, weighted interleave, seeded shuffle, take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import natural_ordinal, shuffled_ordinal
from ..functions.portable import uniform

#: Rows below which the bucket of ``take_unordered`` that holds the n-th row is sorted as a whole.
CROSSING_ROWS = 10_000


def standardize(df: DataFrame, keep: tuple[str, ...] = (), out: str = "text") -> DataFrame:
    """One text column chosen *by schema*: ``content`` if present, else ``text``, else "".

    A present-but-null ``content`` stays null (the choice is on presence, not on
    value), so this is deliberately not a ``coalesce``. Other columns are
    dropped except the ``keep`` columns (row identity, which the reference lacks).
    """
    cols = set(df.columns)
    if "content" in cols:
        text = F.col("content")
    elif "text" in cols:
        text = F.col("text")
    else:
        text = F.lit("")
    return df.select(*[F.col(k) for k in keep], text.cast("string").alias(out))


def truncate(df: DataFrame, cols: list[str], seq_len: int) -> DataFrame:
    """Keep the first ``seq_len`` elements of each array column; shorter rows untouched."""
    return df.withColumns({c: F.slice(F.col(c), 1, int(seq_len)) for c in cols})


@dataclass
class Source:
    """One input of ``interleave``: a frame and the columns giving its row order."""

    df: DataFrame
    order: list[str]
    name: str


def interleave(
    sources: list[Source],
    weights: list[float],
    seed: int = 42,
    out_cols: list[str] | None = None,
    block: int = 1 << 16,
) -> DataFrame:
    """M1: weighted interleave, stopping at the first exhausted source.

    Draw ``d = 0, 1, ...`` picks source ``s(d)`` by the cumulative weights at
    ``uniform(seed, 'draw', d)``; it emits the next unread row of that source.
    The output ends just before the first draw that finds its source empty.
    ``sum(n) + 1`` draws always reach that point (pigeonhole), so the draw
    table is bounded by the input. The rank of a draw within its source is a
    prefix count computed per block of draws (no per-source single task).

    Only the order columns are numbered and written. Where they identify the rows, the rows then meet their
    draw by a join on them, so everything else (the text) is exchanged once; a source whose order columns
    repeat is numbered with its whole rows instead and joined on ``(source, rank)``.

    Output: ``draw`` (dense 0-based interleaved position), ``source`` and ``out_cols``.
    """
    if len(sources) != len(weights) or not sources:
        raise ValueError("one weight per source")
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    spark = sources[0].df.sparkSession
    out_cols = out_cols or [c for c in sources[0].df.columns]
    total = float(sum(weights))
    cum, acc = [], 0.0
    for w in weights:
        acc += w / total
        cum.append(acc)

    ranks, sizes, unique = [], [], []
    for s in sources:
        # natural_ordinal checkpoints the order columns: the counts read that, not the input
        o = natural_ordinal(s.df.select(*s.order), s.order, name="__rank")
        ranks.append(o)
        sizes.append(o.count())
        repeats = o.groupBy(*s.order).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
        unique.append(repeats.isEmpty())
    n_draws = sum(sizes) + 1

    u = uniform(seed, F.lit("draw"), F.col("id"))
    pick = F.lit(len(sources) - 1)
    for i in reversed(range(len(sources) - 1)):
        pick = F.when(u < F.lit(cum[i]), F.lit(i)).otherwise(pick)
    draws = (
        spark.range(n_draws)
        .withColumnRenamed("id", "draw")
        .withColumn("id", F.col("draw"))
        .withColumn("source", pick.cast("int"))
        .withColumn("__blk", F.floor(F.col("draw") / F.lit(block)).cast("bigint"))
        .drop("id")
    )
    per_block = draws.groupBy("__blk", "source").agg(F.count(F.lit(1)).alias("__n"))
    wb = Window.partitionBy("source").orderBy("__blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_block = per_block.withColumn("__off", F.sum("__n").over(wb) - F.col("__n")).drop("__n")
    wr = Window.partitionBy("__blk", "source").orderBy("draw")
    ranked = draws.join(per_block, ["__blk", "source"]).withColumn(
        "__rank", (F.row_number().over(wr) - 1 + F.col("__off")).cast("bigint")
    )
    size_case = F.lit(None).cast("bigint")
    for i, n in enumerate(sizes):
        size_case = F.when(F.col("source") == i, F.lit(int(n))).otherwise(size_case)
    # the first draw that finds its source exhausted ends the interleave (one scalar)
    cut = ranked.where(F.col("__rank") >= size_case).agg(F.min("draw")).first()[0]
    live = ranked.where(F.col("draw") < F.lit(int(cut))).select("draw", "source", "__rank")
    out = None
    for i, s in enumerate(sources):
        mine = live.where(F.col("source") == i).select("draw", "__rank")
        if unique[i]:
            # order columns may be null: a struct of them compares nulls as equal
            at = ranks[i].join(mine, "__rank").select("draw", F.struct(*s.order).alias("__key"))
            rows = s.df.select(F.struct(*s.order).alias("__key"), *[F.col(c) for c in out_cols]).join(at, "__key")
        else:
            rows = natural_ordinal(s.df, s.order, name="__rank").join(mine, "__rank")
        rows = rows.select("draw", F.lit(s.name).alias("source"), *out_cols)
        out = rows if out is None else out.unionByName(rows)
    return out


def shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "ordinal", buckets: int | None = None) -> DataFrame:
    """M2: seeded full permutation; adds a dense ``name`` ordinal in shuffled order.

    The reference shuffles within a 10,000-row buffer; this is a full, keyed,
    partition-independent permutation (same seed and key give the same order
    at any partition count and after executor loss).
    """
    return shuffled_ordinal(df, key, seed, name=name, buckets=buckets)


def take_unordered(df: DataFrame, key: str, n: int, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """M2+M3 without numbering: the rows ``take(shuffle(df, key, seed), n)`` keeps,
    as a filter on the unshuffled input (no exchange of the rows).

    The shuffle order is ``(uniform(seed, key), key)``, so the first ``n`` rows
    are those up to a threshold pair. Counts per bucket (one row per bucket) give
    the bucket that holds the n-th row; it is divided again until it is small, so no
    task sorts a share of all rows. ``n <= 0`` gives no rows. Use it
    for passes that need the selected set but not its order (e.g. vocabulary counts).
    """
    from ..functions.ordinal import default_buckets

    if n <= 0:
        return df.limit(0)
    B = buckets or default_buckets(df)
    u = uniform(seed, F.col(key))
    low, high, before = 0.0, 1.0, 0
    inside = df.select(u.alias("__u"), F.col(key).alias("__k"))
    while True:
        # cut [low, high) into B parts and find the part that holds the n-th row; at most B rows to the driver
        part = F.least(F.floor((F.col("__u") - F.lit(low)) / F.lit((high - low) / B)), F.lit(B - 1)).cast("int")
        counts = sorted(
            (r[0], r[1]) for r in inside.where((F.col("__u") >= F.lit(low)) & (F.col("__u") < F.lit(high))).groupBy(part.alias("b")).count().collect()
        )
        if not counts or before + sum(c for _, c in counts) < n or before + sum(c for _, c in counts) == n and high == 1.0:
            return df  # fewer rows than asked for, or just as many
        for b, c in counts:
            if before + c >= n:
                break
            before += c
        width = (high - low) / B
        edge = low + b * width
        if c <= CROSSING_ROWS or width <= 1e-15:
            low, high = edge - width, edge + 2 * width  # a margin against rounding at the part's ends
            break
        low, high = edge, edge + width
    # few rows are left: the n-th row is among them (one row to the driver)
    near = inside.where((F.col("__u") >= F.lit(low)) & (F.col("__u") < F.lit(high)))
    first = inside.where(F.col("__u") < F.lit(low)).count()
    last = near.orderBy("__u", "__k").offset(n - first - 1).limit(1).first()
    tu, tk = last["__u"], last["__k"]
    return df.where((u < F.lit(tu)) | ((u == F.lit(tu)) & (F.col(key) <= F.lit(tk))))


def take(df: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """M3: first ``n`` rows by ``ordinal`` (fewer if the input is short).

    A filter on a dense ordinal, not ``orderBy().limit(n)``, which would funnel
    a large ``n`` through one task.
    """
    return df.where(F.col(ordinal) < F.lit(int(n)))


def cap(df: DataFrame, max_rows: int | None, ordinal: str = "seq_id") -> DataFrame:
    """M4: keep rows with ``ordinal < max_rows``; ``None`` keeps everything."""
    return df if max_rows is None else df.where(F.col(ordinal) < F.lit(int(max_rows)))
