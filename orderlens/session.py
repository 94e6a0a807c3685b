"""Session helpers.

On a cluster the session (master, memory, shuffle partitions, checkpoint
folder) is configured by whoever submits the job; these helpers only fill in
settings that are unset, so local runs and tests get sane defaults.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Tasks a core that list folders and files.
LISTING_TASKS = 4
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

# Defaults applied only when a setting is absent from the active session.
_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of unreferenced DataFrames are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "orderlens") -> SparkSession:
    """Build (or reuse) a local session for tests, benches and examples."""
    parts = str(shuffle_partitions or (os.cpu_count() if cores == "*" else cores) or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names that folder; only when it is unset (local runs, tests)
    do we create one under the system temp folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="orderlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def bound_listing(spark: SparkSession) -> None:
    """Let folders and files be listed by a few tasks a core, each of which lists
    many.  Spark's own bound is 10,000 tasks on any cluster, and every one of them
    reads the Hadoop configuration anew, which takes longer than to list a folder.
    A bound that the session sets is kept."""
    if spark.conf.get(_LISTING, None) is None:
        spark.conf.set(_LISTING, str(LISTING_TASKS * spark.sparkContext.defaultParallelism))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """In this block, the shuffle files of an action are deleted when it ends.  Else
    they stay until the driver happens to collect its garbage, so that a job of many
    checkpointed steps holds those of all its steps at once.  What a step needs again
    has to be checkpointed; the session's own setting holds again after the block."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for ``name``."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own under the checkpoint folder, on its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
