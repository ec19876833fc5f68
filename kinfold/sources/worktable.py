"""Intermediate results written to the cluster's shared checkpoint folder.

A written table cuts lineage like ``checkpoint()`` does, survives the loss of executors, and gives
the optimizer an exact size, so that later joins broadcast it only when it really is small.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution deletes its shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a partition that ``spread`` makes, by the optimizer's estimate, which counts compressed columns.
SPREAD_BYTES = 4 << 20


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only where none is configured and the session is a local one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="kinfold-"))
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Executions inside delete their shuffle files when they end, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table. Nothing reads the shuffle files of the write again, so they go."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/kinfold/{label}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._kinfold_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    path = getattr(table, "_kinfold_path", None)
    if path is None:
        return
    spark = table.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def by_size(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over one partition per core, or more where a partition would exceed ``SPREAD_BYTES``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-_estimated_bytes(df) // SPREAD_BYTES)), key)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a costly narrow stage enough partitions when the input is too small to have them: see ``by_size``.

    An input estimated above one full split per core has enough partitions and passes without a
    shuffle, so what this moves is bounded by the cores, not by the data.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if _estimated_bytes(df) >= cores * split else by_size(df, key)
