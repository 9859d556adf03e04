"""Keeping intermediate results so that they survive lost executors, and putting results in place.

Everything an application stores lies in one folder of its own below the shared folder. It is deleted
when the application ends, or earlier by ``workspace``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[tuple[str, str], str] = {}  # per application and shared folder, its own folder
_open: dict[str, list[list[str]]] = {}  # per application, the paths made in each open workspace


def _file(spark: SparkSession, path: str):
    """Hadoop's path and the file system it lies in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, files = _file(spark, path)
    files.delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    where, files = _file(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def put_in_place(spark: SparkSession, staged: str, target: str) -> None:
    """Make a written folder the content of ``target``, which it replaces as a whole."""
    new, files = _file(spark, staged)
    old, _ = _file(spark, target)
    files.mkdirs(old.getParent())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"cannot move {staged} to {target}")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _own_folder(spark: SparkSession) -> str:
    """This application's folder. Its file system deletes it when the application ends."""
    app = spark.sparkContext.applicationId
    key = app, spark.conf.get("spark.checkpoint.dir", "")
    if key not in _folders:
        path = f"{shared_folder(spark)}/{app}-{uuid.uuid4().hex[:8]}"
        where, files = _file(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _folders[key] = path
    return _folders[key]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _open.get(spark.sparkContext.applicationId, [])[-1:]:
        paths.append(path)
    return path


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write once, go on from the files. Lineage is cut, and Spark knows the true size."""
    target = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted on leaving, so results must be written or read by then."""
    app, paths = spark.sparkContext.applicationId, []
    _open.setdefault(app, []).append(paths)
    try:
        yield
    finally:
        _open[app].remove(paths)
        for path in paths:
            delete(spark, path)
