"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "rolloom", **conf) -> SparkSession:
    """A session for tests and the local bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="rolloom-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder all executors share.

    A machine-local folder is made only where nothing is set and Spark runs in this very process.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders through the file system that they live in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        if path in _written:
            _written.remove(path)


def release() -> None:
    """Delete what :func:`materialize` has written and nobody has removed; runs at exit, too.

    The frames it returned must not be read afterwards.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        remove(spark, *list(_written))


atexit.register(release)


def remove_at_release(path: str) -> None:
    """Treat a folder as if :func:`materialize` had written it."""
    _written.append(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """What :func:`materialize` writes inside is deleted at the end; write results elsewhere before."""
    before = set(_written)
    try:
        yield
    finally:
        remove(spark, *[path for path in _written if path not in before])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow intermediate table once and read it back.

    Used where a slim result of an expensive text pass is needed twice: the text is scanned once,
    and a lost executor costs a re-read of the slim files, not of the texts. The folder stays until
    :func:`release` or the end of the driver's Python, as the returned frame is read lazily.
    """
    path = scratch_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
