"""Intermediate tables in the folder that the cluster shares: they cut lineage, survive lost executors and are deleted after use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []

#: Folders of intermediate tables: the last list is that of the innermost scope.
_made: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may do without it."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def written(df: DataFrame, label: str, outer: bool = False, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, keeps column pruning.

    The table lasts until the scope in which it was made ends (outer: the one around that), or until release(); at the
    latest the end of the driver's JVM deletes it."""
    spark = df.sparkSession
    path = folder(spark, label)
    if outer and len(_made) > 1:
        _made[-2].append(_made[-1].pop())
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for files of any kind, deleted like a table."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    _system(spark, path, "deleteOnExit")
    return path


def _system(spark: SparkSession, path: str, call: str, *arguments) -> None:
    """A call on the path's file system, local or remote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(place.getFileSystem(spark._jsc.hadoopConfiguration()), call)(place, *arguments)


def mark() -> int:
    """How many tables the open scope has: what is made from here on can be released with release(spark, made_since(mark))."""
    return len(_made[-1])


def made_since(place: int, but_last: bool = False) -> list[str]:
    return _made[-1][place : -1 if but_last else None]


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes intermediate tables: the given ones, or all that the open scope has made so far. Results that still read
    them can't be computed any more."""
    for path in list(_made[-1]) if paths is None else list(paths):
        _system(spark, path, "delete", True)
        for made in _made:
            if path in made:
                made.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written inside; results must be consumed or saved before."""
    _made.append([])
    try:
        yield
    finally:
        release(spark)
        _made.pop()
