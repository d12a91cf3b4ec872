"""Session settings for tests, the bench and small jobs; a cluster brings its own session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", app: str = "countermill", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects: UTC, ANSI and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("COUNTERMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def require_utc(spark: SparkSession) -> SparkSession:
    """Stored times carry no zone and mean UTC, so casts to TIMESTAMP must run in a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder path for tables that a query writes and reads again.

    It is under ``spark.checkpoint.dir``, which driver and executors share. Where that is unset, a
    temporary folder stands in under a ``local`` master only, where all work is on one machine; any
    other master is refused. What a session made is removed when its JVM ends.
    """
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4()}"


def _session_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.gettempdir()
        folder = f"{shared.rstrip('/')}/countermill-{context.applicationId}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[context.applicationId] = folder
    return _FOLDERS[context.applicationId]


_FOLDERS: dict[str, str] = {}
