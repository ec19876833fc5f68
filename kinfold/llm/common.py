"""Names and small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.worktable import materialize

__all__ = ["SPACE", "WORD", "fold", "materialize", "placed", "table", "text_of", "with_copies"]

#: A word is a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(key: str | Column, folds: int) -> Column:
    """``crc32(key as text) mod folds``: the fold that held-out rows are told by."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def placed(df: DataFrame, group: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """Add ``place`` (long, gapless from 0 in each group) without sorting a whole group in one task.

    ``_slice`` must be a whole-number column of ``df``; ``slices=1`` says that it has one value. Rows are numbered inside
    (group, slice) and shifted by the sizes of the slices before; only slice sizes meet per group.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    shifts = (
        df.groupBy(*group, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    numbered = df.withColumn("_at", F.row_number().over(inside) - 1)
    if slices == 1:
        return numbered.withColumn("place", F.col("_at").cast("long")).drop("_at", "_slice")
    return (
        numbered.join(shifts, [*group, "_slice"])
        .withColumn("place", (F.col("_at") + F.col("_shift")).cast("long"))
        .drop("_at", "_shift", "_slice")
    )


def with_copies(df: DataFrame, unit: str) -> DataFrame:
    """Add ``_copy`` (long): the number of the row, from 0, among the rows of equal ``unit``; ``_slice`` goes.

    ``df`` must be a written table whose ``_slice`` is the partition that wrote the row, so that rows repeated
    without bound are numbered by many tasks. Rows of one unit should be equal, as any of them may get any number.
    """
    again = materialize(
        df.groupBy(unit).agg(F.count("*").alias("_n")).where("_n > 1").select(unit), "repeated"
    )
    alone = df.join(again, unit, "left_anti").drop("_slice").withColumn("_copy", F.lit(0).cast("long"))
    more = placed(df.join(again, unit, "left_semi"), [unit], [F.col("_slice")])
    return alone.unionByName(more.withColumnRenamed("place", "_copy").select(alone.columns))
