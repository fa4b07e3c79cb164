"""Session helpers.

``local_session`` is for tests, benches and the driver smoke run; on a cluster
the caller owns the session. ``checkpoint_dir`` returns the shared folder named
by ``spark.checkpoint.dir``. Without one, a local session gets a folder of its own under /tmp that
goes when the process ends; on any other master it raises.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

_CONF_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "seqloom") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", os.environ.get("SEQLOOM_TZ", "UTC"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SEQLOOM_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the session's setting, else a local one (tests only)."""
    sc = spark.sparkContext
    path = spark.conf.get(_CONF_KEY, None) or sc.getConf().get(_CONF_KEY, None)
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path
    current = sc.getCheckpointDir()
    if current:
        # a directory set programmatically: its parent is the user-facing root
        return current.rstrip("/").rsplit("/", 1)[0]
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_CONF_KEY} to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="seqloom-ckpt-", dir="/tmp")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    try:
        spark.conf.set(_CONF_KEY, path)
    except Exception:  # noqa: BLE001 - some sessions reject core confs at run time
        pass
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir for written tables."""
    root = checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go as soon as its result is written; else they stay until the driver collects garbage.

    For chains of tables that are each written once and read from there: their shuffles would add up on disk.
    """
    before = spark.conf.get(_FREE_KEY)
    spark.conf.set(_FREE_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_KEY, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Inside, a Python task is handed ``rows`` rows at once at most. Spark and the worker both hold a whole batch: some 25 MB each of usual texts."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)
