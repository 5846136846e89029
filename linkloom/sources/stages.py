"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting, by which the shuffle files of a query go as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all is one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return f"{root.rstrip('/')}/linkloom/{spark.sparkContext.applicationId}"


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written as a Parquet table (in folders by some columns) and read back: it is computed once, its plan ends there, and lost executors lose nothing of it."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with cleared(df.sparkSession):
        df.write.parquet(path, partitionBy=by, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
