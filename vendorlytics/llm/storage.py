"""Intermediate tables and files in the cluster's shared folder
(``spark.checkpoint.dir``).

``stored`` writes a DataFrame there and reads it back, which cuts lineage: a
lost executor costs the tasks it ran, not the stages before.  Shuffle files of
such a write are released when it ends.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from vendorlytics.session import checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's whole address.  A path without a scheme is one of the cluster's default
    file system, for Spark and for the files that tasks write alike."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString()


def arrow_address(path: str) -> str:
    """A Hadoop address as pyarrow's file systems name it."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file" and not rest.startswith("//"):
        return f"file://{rest}"
    return f"s3:{rest}" if colon and scheme in ("s3a", "s3n") else path


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions inside free their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    with releasing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    gc.collect()  # plans that only unreachable Python objects hold are freed on the driver
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path  # for ``drop``
    return out


def drop(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    delete(df.sparkSession, df.stored_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_file(path: str, chunks) -> int:
    """Write a file from a task: under a name of this attempt's own, then moved
    in place whole, so that a repeated or lost attempt leaves no half file.
    Returns the bytes written."""
    from pyarrow import fs

    system, target = fs.FileSystem.from_uri(arrow_address(path))
    folder, _, name = target.rpartition("/")
    system.create_dir(folder, recursive=True)
    trial, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(trial) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(trial, target)
    return size


def open_file(path: str):
    """A file opened for range reads (``read_at(length, offset)``)."""
    from pyarrow import fs

    system, target = fs.FileSystem.from_uri(arrow_address(path))
    return system.open_input_file(target)
