"""Tables written to the folder that the whole cluster shares.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir``: they outlive
lost executors, are smaller than checkpoint files and every executor sees them.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, one below the temp folder in local mode and an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'quadrille-checkpoints')}"
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside are deleted at the end, but for paths taken out of the list that it gives."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        for path in _open.pop():
            remove(spark, path)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    return written(df, name, partition_by)[0]


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """As materialize, with the table's path for remove()."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a row's content, nulls told apart; rows with equal keys are equal (columns of maps aside)."""
    cols = [df[f.name] for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    parts = [c for x in cols for c in (x, x.isNull())]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, records: int = 1024, size: int = 8 << 20) -> None:
    """Keep Arrow batches of whole documents small, in rows and in bytes, so a worker holds little at a time.

    Spark reads these settings when a query runs, so they stay set in the session;
    smaller ones of the caller's are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", records), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower()
        number = int(now) if now.lstrip("-").isdigit() else None
        if number is None or number <= 0 or number > most:
            spark.conf.set(key, str(most))
