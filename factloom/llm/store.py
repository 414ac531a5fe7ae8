"""Shared storage for intermediate tables and binary files.

Everything goes under the folder in ``spark.checkpoint.dir``, which driver and executors share. Tables are written as
Parquet and read back, which cuts lineage and survives lost executors. Binary files are written by tasks under a name of
their own and renamed when whole, so a task that runs again replaces its file with the same bytes.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none and runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def small_batches(spark: SparkSession, most: str = "8m") -> SparkSession:
    """Arrow batches of ``most`` bytes in this session: whole texts go through Python, and rows may be long."""
    spark.conf.set(BOUND, most)
    return spark


@contextlib.contextmanager
def batches(spark: SparkSession, most: str) -> Iterator[None]:
    """Arrow batches of ``most`` bytes for what runs inside; then the session's bound holds again."""
    before = spark.conf.get(BOUND)
    small_batches(spark, most)
    try:
        yield
    finally:
        spark.conf.set(BOUND, before)


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    """A stream into a new file; the caller closes it before anything names the file."""
    store, path = _filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def write_file(uri: str, parts: Iterable[bytes]) -> int:
    """Streams parts into a file that appears under its name only when whole; returns its size."""
    store, path = _filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    aside, size = f"{path}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(aside) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(aside, path)
    return size


class RangeReader:
    """Reads byte ranges; keeps the last file open."""

    def __init__(self) -> None:
        self.uri, self.file = None, None

    def open(self, uri: str):
        if uri != self.uri:
            self.close()
            store, path = _filesystem(uri)
            self.file, self.uri = store.open_input_file(path), uri
        return self.file

    def read(self, uri: str, offset: int, length: int) -> bytes:
        return self.open(uri).read_at(length, offset)

    def size(self, uri: str) -> int:
        return self.open(uri).size()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = None, None
