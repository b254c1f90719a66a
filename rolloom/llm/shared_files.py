"""Files in a folder that driver and executors share, written under temporary names and committed
through a manifest.

A task writes under a name of its own attempt and reports it in a row. Spark commits the rows of one
attempt per task, so the manifest names exactly one file per final name; only those are renamed, and
what lost or repeated attempts left behind goes with the temporary folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from rolloom.session import remove

TEMPORARY = "_temporary"
MANIFEST = "_manifest"


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; works on executors, without the JVM."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def temporary_name(folder: str, name: str) -> str:
    return f"{folder}/{TEMPORARY}/{name}.{uuid.uuid4().hex}"


def open_new(uri: str) -> pa.NativeFile:
    store, path = locate(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_old(uri: str) -> pa.NativeFile:
    store, path = locate(uri)
    return store.open_input_file(path)


def commit(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Write the manifest, give the files in it their final names, and return the manifest.

    ``files`` holds ``name`` and ``temporary`` besides other columns. A rename that has been done by
    an earlier attempt is left as it is.
    """
    files.write.parquet(f"{folder}/{MANIFEST}")
    manifest = spark.read.schema(files.schema).parquet(f"{folder}/{MANIFEST}")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist())
            for name, temporary in pairs:
                store, source = locate(temporary)
                _, target = locate(f"{folder}/{name}")
                if store.get_file_info(source).type == fs.FileType.NotFound:
                    if store.get_file_info(target).type == fs.FileType.NotFound:
                        raise FileNotFoundError(target)
                else:
                    store.move(source, target)
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    renamed = manifest.select("name", "temporary").mapInArrow(rename, "name string")
    renamed.write.format("noop").mode("overwrite").save()
    remove(spark, f"{folder}/{TEMPORARY}")
    return manifest.drop("temporary")
