"""Extension: the batch state functions behind a stream of landed postings.

Each micro-batch reads the current version of the state, applies the same pure function, and writes the next version; the version is
the batch id, so a batch that is replayed after a failure writes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

Apply = Callable[[DataFrame, DataFrame], DataFrame]


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version:012d}"


def latest(spark: SparkSession, root: str, before: int, empty: DataFrame) -> DataFrame:
    """The newest complete version under ``root`` before a batch id."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = sorted(int(n[2:]) for n in names if n.startswith("v=") and int(n[2:]) < before and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{version_path(root, int(n[2:]))}/_SUCCESS")))
    return spark.read.schema(empty.schema).parquet(version_path(root, done[-1])) if done else empty


def stateful(stream: DataFrame, root: str, empty: DataFrame, apply: Apply) -> DataStreamWriter:
    """A writer that keeps ``apply(state, batch)`` under ``root``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        state = latest(batch.sparkSession, root, batch_id, empty)
        apply(state, batch).write.mode("overwrite").parquet(version_path(root, batch_id))

    return stream.writeStream.foreachBatch(each)
