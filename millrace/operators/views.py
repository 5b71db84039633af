"""Saved results: a refresh writes a new version beside the old ones, and readers take the newest whole one, or compute."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.shared import new_folder as shared_folder


def new_folder(spark: SparkSession) -> str:
    """A folder for views that nothing else uses."""
    return shared_folder(spark, "views")


_ONCE: dict[tuple, str] = {}


def once(spark: SparkSession, name: str, sources: list[str], live: Callable[[], DataFrame]) -> DataFrame:
    """A result that many queries of a session read: the first one saves it. It is made anew where a source's files changed."""
    key = (spark.sparkContext.applicationId, name, *((p, stamp(spark, p)) for p in sources))
    if key not in _ONCE:
        path = shared_folder(spark, name)
        live().write.parquet(path)
        _ONCE[key] = path
    return spark.read.parquet(_ONCE[key])


def _listed(spark: SparkSession, path: str) -> list:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(fs.listStatus(where)) if fs.exists(where) else []


def children(spark: SparkSession, path: str) -> list[str]:
    """The folders directly under a path."""
    return sorted(x.getPath().toString() for x in _listed(spark, path) if x.isDirectory())


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another stamp means that it was written anew."""
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in _listed(spark, path)))


def versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions of a view, oldest first; one that a writer has not finished has no _SUCCESS."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [x.getPath() for x in fs.listStatus(where)]
    return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def refresh(df: DataFrame, path: str) -> None:
    """Saves df as the view's newest version; readers of an older one are not disturbed."""
    df.write.parquet(f"{path}/v{time.time_ns():020d}")


def refresh_all(views: dict[str, DataFrame], folder: str) -> None:
    for name, df in views.items():
        refresh(df, f"{folder}/{name}")


def saved(spark: SparkSession, path: str, live: Callable[[], DataFrame]) -> DataFrame:
    """The newest version of a view, or its live computation where none is saved."""
    found = versions(spark, path)
    return spark.read.parquet(found[-1]) if found else live()
