"""URL filters by a sort-merge range join (DataFrame functions only).

A rule ``(host, path)`` fits its host and all subdomains when the url's path
starts with the rule's path. The canonical key of a rule is the reversed host
followed by the path (``example.com`` + ``/en/`` -> ``com.example./en/``), so
"starts with" becomes the key interval ``[key, key + U+10FFFF)``. A url has one
key per suffix of its host (its own labels, the parent's, ...) with as many labels
as some rule's host, so a rule fits exactly when one of these keys lies in the
rule's interval, and a host of very many labels costs no more than a short one.

Intervals of prefixes nest. In key order, the stack of active rules changes
only at interval bounds: a start puts its rule on top, an end restores the
rule that encloses it. The bounds are merged with the url keys, sorted by
range over all tasks, and the last bound before a url key names the top of the
stack there. A partition whose first url comes before any bound of its own
takes over the last bound of earlier partitions (one row per partition).

Hot hosts are no problem: the range partitioning is on (key, kind), the
distinct keys of one host differ in their paths, and equal keys are merged first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

LAST = "\U0010ffff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``? #`` or the end; null or no ``://``: empty."""
    rest = _after_scheme(url)
    return F.coalesce(F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\."))


def _suffix_keys(host: Column, path: Column, counts: list[int]) -> Column:
    """Keys of the host's suffixes of as many labels as some rule's host has; no other suffix can meet a rule."""
    labels = _labels(host)
    fits = F.filter(F.array(*[F.lit(c) for c in counts]).cast("array<int>"), lambda n: n <= F.size(labels))
    return F.transform(fits, lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."), path))


def label_counts(rules: DataFrame) -> list[int]:
    """Numbers of labels that occur among the rules' hosts, ascending: at most as many as the longest host has labels."""
    sizes = rules.where(F.coalesce(F.col("host"), F.lit("")) != "").select(F.size(_labels(F.col("host"))).alias("n")).distinct()
    return sorted(r["n"] for r in sizes.collect())


def rule_bounds(rules: DataFrame) -> DataFrame:
    """Bounds ``(key, top)`` of the nested rule intervals; ``top`` is the rule on top of the stack from ``key`` on.

    Rules with a null or empty host fit nothing; a null path counts as empty; of equal rules with
    different verdicts, ``block`` holds.
    """
    r = (
        rules.select(
            F.translate(F.col("host"), UPPER, LOWER).alias("host"),
            F.coalesce(F.col("path"), F.lit("")).alias("path"),
            F.col("verdict").alias("verdict"),
        )
        .where(F.coalesce(F.col("host"), F.lit("")) != "")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", F.concat(reversed_host(F.col("host")), F.col("path")))
        .withColumn(
            "rule",
            F.struct(
                F.length("host").alias("host_len"), F.length("path").alias("path_len"),
                F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"),
            ),
        )
    )
    # the enclosing rule: the longest other rule whose key is a proper prefix
    prefixes = r.select(
        F.col("key").alias("inner"), F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("n")
    ).select("inner", F.col("inner").substr(F.lit(1), F.col("n")).alias("key"), "n")
    parents = prefixes.join(r.select("key", "rule"), "key").groupBy("inner").agg(F.max_by("rule", "n").alias("outer"))
    nested = r.join(parents, F.col("key") == F.col("inner"), "left")
    starts = nested.select("key", F.struct(F.col("rule").alias("on")).alias("top"))
    ends = nested.select(F.concat("key", F.lit(LAST)).alias("key"), F.struct(F.col("outer").alias("on")).alias("top"))
    return starts.unionByName(ends)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``.

    Among the rules that fit, the one with the longest host wins, then the longest path.
    ``rule`` is ``host + path`` of the winner or null; without one, ``verdict`` is ``default``.
    Null urls and urls without ``://`` have empty host and path and no rule. Repeated rows stay
    repeated; equal (host, path) pairs are judged once. Existing columns named host, path, rule or
    verdict are replaced. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    u = F.col(url).cast("string")
    judged = pages.withColumns({"__host": host_of(u), "__path": path_of(u)})
    pairs = judged.select("__host", "__path").distinct()
    keys = (
        pairs.where(F.col("__host") != "")
        .select(F.explode(_suffix_keys(F.col("__host"), F.col("__path"), label_counts(rules))).alias("key"), "__host", "__path")
    )
    bounds = rule_bounds(rules)
    top_type = bounds.schema["top"].dataType
    events = bounds.select(
        "key", F.lit(0).alias("kind"), "top", F.lit("").alias("__host"), F.lit("").alias("__path")
    ).unionByName(keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast(top_type).alias("top"), "__host", "__path"))
    # the written copy fixes the range partitions, so their numbers can be used as block ids
    ranged = events.repartitionByRange(parts, "key", "kind", "__host", "__path").checkpoint().withColumn(
        "block", F.spark_partition_id()
    )
    lasts = ranged.where("kind = 0").groupBy("block").agg(F.max_by("top", "key").alias("last"))
    blocks = ranged.select("block").distinct().join(lasts, "block", "left")  # one row per partition
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("block", F.last("last", ignorenulls=True).over(before).alias("carry"))
    sweep = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = (
        ranged.withColumn("seen", F.last("top", ignorenulls=True).over(sweep))
        .where("kind = 1")
        .join(F.broadcast(carried), "block")
        .select("__host", "__path", F.coalesce("seen", "carry")["on"].alias("on"))
    )
    best = active.where("`on` IS NOT NULL").groupBy("__host", "__path").agg(F.max("on").alias("__best"))
    out = judged.join(best, ["__host", "__path"], "left")
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(
        *keep,
        F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"),
        F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"),
    )
