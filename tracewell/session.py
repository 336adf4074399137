"""Session helper and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects; used by tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in a local run without one a temporary folder, removed at the end.

    On a cluster without that setting this raises: executors don't see each other's local folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, _FALLBACK[app], ignore_errors=True)
    return _FALLBACK[app]


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tracewell/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder, in this application's part of it, that nothing else uses."""
    return f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; frames that still read from it end with that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs one file read and not the whole plan before it.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
