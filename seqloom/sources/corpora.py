"""Sources and sinks: multi-corpus scan, pair-directory scan, pair sink, artefact listing."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mixing import Source, interleave, standardize
from ..functions.ordinal import natural_ordinal

log = logging.getLogger("seqloom")


@dataclass
class Corpus:
    """A named corpus on a file system: ``fmt`` is any Spark file source."""

    name: str
    path: str
    fmt: str = "parquet"
    weight: float = 1.0
    optional: bool = False
    order: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    rename: dict = field(default_factory=dict)  # columns renamed when the corpus is opened


def open_corpus(spark: SparkSession, c: Corpus) -> DataFrame | None:
    try:
        return spark.read.format(c.fmt).options(**c.options).load(c.path).withColumnsRenamed(c.rename)
    except AnalysisException as e:
        if c.optional:
            log.warning("corpus %s unavailable (%s); continuing without it", c.name, str(e).splitlines()[0])
            return None
        raise


def scan_corpora(spark: SparkSession, corpora: list[Corpus]) -> list[tuple[Corpus, DataFrame]]:
    """S1 (+C1): open every corpus and standardise it to ``text``.

    An optional corpus that cannot be opened (missing path, unreadable
    schema) is skipped with a warning, decided at analysis time; the others go on.
    """
    out = []
    for c in corpora:
        df = open_corpus(spark, c)
        if df is None:
            continue
        out.append((c, standardize(df, keep=tuple(c.order))))
    if not out:
        raise ValueError("no corpus could be opened")
    return out


def mixed_corpus(spark: SparkSession, corpora: list[Corpus], seed: int = 42) -> DataFrame:
    """S1 + C1 + M1: ``(draw, source, text)``. Two or more corpora are interleaved by
    weight; a single surviving corpus is used alone, without interleaving."""
    opened = scan_corpora(spark, corpora)
    if len(opened) == 1:
        c, df = opened[0]
        return natural_ordinal(df, c.order, name="draw").select("draw", F.lit(c.name).alias("source"), "text")
    sources = [Source(df, c.order, c.name) for c, df in opened]
    return interleave(sources, [c.weight for c, _ in opened], seed=seed, out_cols=["text"])


PAIR_COLUMNS = ("context_ids", "target_ids")


def canonical_path(path: str) -> Column:
    """Path column in one spelling: the file listing and the reader write the scheme differently (``file:/`` and ``file:///``)."""
    return F.regexp_replace(path, "^([a-zA-Z0-9+.-]+):/+", "$1:/")


def _pair_reader(spark: SparkSession):
    return spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet")


def _check_files(spark: SparkSession, path: str, cols: tuple[str, ...]) -> DataFrame:
    """One row per file with a readable footer: ``file``, ``footer_rows``, ``rows`` that could be read, ``ok`` (arrays of one length).

    A scan without columns counts by the footers alone; a scan of every column stops where a file breaks.
    """
    df = _pair_reader(spark).parquet(path)
    name = F.col("_metadata.file_path").alias("__file")
    footers = df.select(name).groupBy(F.col("__file").alias("file")).agg(F.count(F.lit(1)).alias("footer_rows"))
    others = [c for c in df.columns if c not in cols]
    whole = df.select(*df.columns, name).groupBy("__file").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"__{c}_n") for c in others],
        *[f(F.size(c)).alias(f"__{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max))],
    )
    sizes = [F.col(f"__{c}_{n}") for c in cols for n in ("min", "max")]
    ok = F.lit(True)
    for x in sizes[1:]:
        ok = ok & x.eqNullSafe(sizes[0])
    for c in others:  # always true, but it keeps the column in the scan, so that a break in it shows
        ok = ok & (F.col(f"__{c}_n") <= F.col("rows"))
    return footers.join(whole.select(F.col("__file").alias("file"), "rows", ok.alias("ok")), "file", "left").select(
        "file", "footer_rows", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("ok", F.lit(True)).alias("ok")
    )


def scan_pairs(spark: SparkSession, path: str, cols: tuple[str, ...] = PAIR_COLUMNS) -> DataFrame:
    """Read a directory of pair parquet files in sorted file-name order.

    * no parquet file -> error;
    * an unreadable file is skipped (``ignoreCorruptFiles``) and the rest continues;
    * a file that breaks off half-way (fewer rows can be read than its footer counts, in whichever column) and a file
      whose arrays in one column are not all one length are left out as a whole.

    The check reads the directory once before the scan itself. Adds ``file`` (full path) and ``row`` (row index inside the
    file). ``scan_pairs_report`` names the files left out.
    """
    try:
        df = _pair_reader(spark).parquet(path)
    except AnalysisException as e:
        raise ValueError(f"no parquet files found in {path}") from e
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    good = _check_files(spark, path, cols).where(F.col("ok") & (F.col("rows") == F.col("footer_rows"))).select("file")
    return df.join(good, "file", "left_semi")


def scan_pairs_report(spark: SparkSession, path: str, cols: tuple[str, ...] = PAIR_COLUMNS) -> DataFrame:
    """S2, report: one row per parquet file of the directory with ``rows`` read and why it is left out, if it is.

    ``unreadable``: the file has no readable footer (or no row); ``broken``: fewer rows can be read than the footer counts;
    ``ragged``: its arrays differ in length. ``name`` is the file's name, ``path`` tells equal names in several folders apart.
    """
    listed = scan_artifacts(spark, path, "*.parquet").select(canonical_path("path").alias("path"))
    files = _check_files(spark, path, cols).withColumn("path", canonical_path("file"))
    why = (
        F.when(F.col("ok").isNull(), "unreadable")
        .when(F.col("rows") < F.col("footer_rows"), "broken")
        .when(~F.col("ok"), "ragged")
    )
    return listed.join(files, "path", "left").select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.coalesce("rows", F.lit(0)).alias("rows"), why.alias("skipped"), "path"
    )


def write_pairs(
    df: DataFrame, path: str, files: int | None = None, key: str = "seq_id", mode: str = "overwrite", file_rows: int = 10_000
) -> str:
    """S3: write ``context_ids``, ``target_ids`` (and the key) as parquet files.

    Range-partitioned on the key and sorted inside each file, so that sorted
    file names give the rows in key order and a loader has several shards
    (the reference writes one file). Without ``files`` their number follows from the rows
    (about ``file_rows`` per file, at least one per shuffle partition up to the rows). The directory is created if missing.
    """
    if files is None:
        rows = df.count()
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        files = max(1, min(rows, parts), -(-rows // file_rows))
    (
        df.repartitionByRange(int(files), key)
        .sortWithinPartitions(key)
        .write.mode(mode)
        .parquet(path)
    )
    return path


def write_pair_shards(df: DataFrame, path: str, file_rows: int = 10_000, key: str = "seq_id", mode: str = "overwrite") -> str:
    """S3 for a key that counts from 0 without gaps: file ``n`` holds the keys from ``n * file_rows`` on, ``file_rows`` of them.

    The files follow from the keys alone, so the input is evaluated once, without a count. Each lies in a folder
    ``shard=<n>`` with ``n`` padded to 12 digits: sorted paths give the rows in key order. One exchange, by shard (ranges
    would evaluate the input once more for their bounds); a task writes its shards one after the other.
    """
    shard = F.format_string("%012d", F.floor(F.col(key) / F.lit(int(file_rows))).cast("bigint"))
    (
        df.withColumn("shard", shard)
        .repartition("shard")
        .sortWithinPartitions("shard", key)
        .write.mode(mode)
        .partitionBy("shard")
        .parquet(path)
    )
    return path


def scan_artifacts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """List files matching ``glob`` with modification time and length.

    ``binaryFile`` with only metadata columns selected: file contents are pruned.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "modificationTime", "length")
    )
