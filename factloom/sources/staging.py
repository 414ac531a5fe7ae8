"""Intermediate tables, written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that shuffle files of a statement are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; under a temporary folder only where none is named and the session runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _cleanup(spark: SparkSession) -> str | None:
    try:
        return spark.conf.get(CLEANUP)
    except PySparkException:  # it has no such setting
        return None


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """The same rows without lineage, from Parquet. Shuffle files of the work before go as soon as they are written, where this Spark has a setting for that."""
    spark = df.sparkSession
    path, was = folder(spark, name), _cleanup(spark)
    if was is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is not None:
            spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
