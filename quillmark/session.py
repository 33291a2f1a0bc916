"""Session settings shared by tests, the benchmark and jobs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings that hold at any size.  AQE sizes the shuffle partitions from the
#: data, so the initial number only has to be large enough.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Files of a checkpoint go when nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, app: str = "quillmark", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    n = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g"} | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, of ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary one, which goes when
    Python ends; on a cluster its absence is an error, since a machine-local
    folder wouldn't survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillmark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder to a new place; False if there is none."""
    fs, p = _at(spark, source)
    if not fs.exists(p):
        return False
    _, q = _at(spark, target)
    fs.mkdirs(q.getParent())
    return fs.rename(p, q)
