"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import json
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scope = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder where that is unset, on one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif sc.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="tidewright-")
            sc.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return f"{base.rstrip('/')}/tidewright-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(the Hadoop file system of ``path``, ``path`` for it)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def write_json(spark: SparkSession, path: str, value) -> None:
    """``value`` at ``path`` in shared storage, in place of what was there."""
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str):
    """What ``write_json`` stored, or None."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


@contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread has ``stored`` inside are removed at its end, not at the end of the process."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, outer
        for path in paths:
            remove(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends there, and its partition numbers hold."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    paths = getattr(_scope, "paths", None)
    if paths is not None:
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.parquet(path)

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session is gone, and the folder is its owner's to clear
            pass

    atexit.register(clean)
    return spark.read.schema(df.schema).parquet(path)
