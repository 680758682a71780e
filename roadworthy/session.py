"""Session helpers.

``local_session`` is for tests and the benchmark only; on a cluster the
caller owns the session.  ``shared_dir`` returns the shared checkpoint folder
the cluster names in ``spark.checkpoint.dir``.  Only a ``local`` master, whose
one process sees every file, gets a folder of its own when the setting is absent.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "roadworthy") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Session settings the library relies on (idempotent)."""
    # Compact dates are produced from timestamps; pin the zone so every
    # executor formats the same calendar day.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Shuffled bytes that one task is given, unless the session names a size: the rows are short texts that unpack to
    # about eight times that, and a ranking sorts them up to four times in one task.
    if spark.conf.get(ADVISORY, None) is None:
        spark.conf.set(ADVISORY, "16m")
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        configured = tempfile.mkdtemp(prefix="roadworthy-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on the file system that holds it."""
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jp, True)  # type: ignore[union-attr]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the file system of its path."""
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    return bool(jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jp))  # type: ignore[union-attr]


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """Hold a session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def temporary_dir(spark: SparkSession, name: str):
    """A fresh shared sub-folder that is deleted at the end of the block."""
    path = shared_dir(spark, name)
    try:
        yield path
    finally:
        remove_path(spark, path)
