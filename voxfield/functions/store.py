"""Written intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, only a single-process local master gets a folder of its own, removed when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _own:
        _own[context.applicationId] = made = tempfile.mkdtemp(prefix="voxfield-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _own[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/voxfield/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder that this library has written."""
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it doesn't exist."""
    system, folder = _folder(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(folder)) if system.exists(folder) else []


def publish(spark: SparkSession, text: str, path: str) -> None:
    """Write a small text file that appears whole or not at all; replaces an older one."""
    system, target = _folder(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    stream = system.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    system.delete(target, False)
    system.rename(part, target)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes at the end, but for tables written with ``keep``.

    Nothing that outlives the block may read a table that goes.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when their job ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts lineage, survives lost executors, and lets every later reader prune columns and push filters.
    """
    path = new_path(df.sparkSession, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
