"""Folders that Spark has committed as a whole."""

from __future__ import annotations

from pyspark.sql import SparkSession


def committed_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` that hold the marker of a finished write."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    below = [status.getPath() for status in store.listStatus(place) if status.isDirectory()]
    done = [x for x in below if store.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(x.getName() for x in done)
