"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only where the session names none and has no other machines (a local test) a
    temporary folder is used; on a cluster that would lose rows, so it raises.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(spark, "_lotline_dir", None):
        spark._lotline_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return spark._lotline_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read from there.

    This cuts lineage: later steps re-read files instead of recomputing, and
    survive lost executors. Its shuffles are deleted once it is written, and not
    only when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lotline_path = path
    _held(spark).add(path)
    return out


_LOCK, _WRITING = threading.Lock(), {}


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession):
    """Meanwhile queries of this session delete their shuffles at their end; then (when the last of several threads is through) the setting is as it was."""
    name, me = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", id(spark)
    with _LOCK:
        n, was = _WRITING.get(me) or (0, spark.conf.get(name, "false"))
        _WRITING[me] = n + 1, was
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, was = _WRITING.pop(me)
            if n > 1:
                _WRITING[me] = n - 1, was
            else:
                spark.conf.set(name, was)


def _held(spark: SparkSession) -> set[str]:
    """The tables that this session has written and not forgotten."""
    if not hasattr(spark.sparkContext, "_lotline_held"):
        spark.sparkContext._lotline_held = set()
    return spark.sparkContext._lotline_held


def forget(*tables: DataFrame) -> None:
    """Deletes the files of written() tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._lotline_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _held(df.sparkSession).discard(df._lotline_path)


def clear(spark: SparkSession) -> int:
    """Deletes all tables that this session has written and that are still there; results that were not yet read or saved are lost. Returns how many."""
    held = _held(spark)
    for name in held:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    n = len(held)
    held.clear()
    return n
