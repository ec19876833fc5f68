"""Candidate pairs from shared buckets, with oversized buckets split over many tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 2048
#: Pairs that a task of a bucket join makes on average, and the most tasks.
TASK_PAIRS = 2_000_000
MOST_TASKS = 20_000


def _chunked(postings: DataFrame, size: str, low: bool, chunk: int) -> DataFrame:
    """Cut each bucket into chunks and key every row by the chunk pairs it takes part in.

    Low rows meet the chunks from their own upwards, high rows those from their own downwards, so
    each chunk pair meets exactly once. A bucket of ``n`` rows is copied ``n / chunk`` times and no
    join key ever holds more than about ``chunk`` rows a side.
    """
    parts = F.greatest(F.ceil(F.col(size) / chunk).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int")
    df = postings.withColumn("_parts", parts).withColumn("_own", own)
    if low:
        pairs = F.transform(
            F.sequence(F.col("_own"), F.col("_parts") - 1),
            lambda o: F.struct(F.col("_own").alias("lo"), o.alias("hi")),
        )
    else:
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("_own")),
            lambda o: F.struct(o.alias("lo"), F.col("_own").alias("hi")),
        )
    return df.withColumn("_cell", F.explode(pairs)).drop("_parts", "_own")


def task_count(sized: DataFrame, size: str = "size", task_pairs: int = TASK_PAIRS) -> int:
    """Tasks that the pairs of the buckets are joined in: ``task_pairs`` each on average."""
    pairs = sized.agg(F.sum(F.col(size).cast("double"))).first()[0] or 0
    return min(MOST_TASKS, max(sized.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / 2 / task_pairs)))


def with_bucket_size(postings: DataFrame, key: str = "term") -> DataFrame:
    """Add ``size``, the rows of each bucket; buckets of one row are dropped."""
    sizes = postings.groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") > 1)
    return postings.join(sizes, key)


def bucket_pairs(
    postings: DataFrame,
    key: str = "term",
    size: str = "size",
    condition: Column | None = None,
    chunk: int = CHUNK,
    once: bool = True,
    parts: int | None = None,
    more: Sequence[Column] = (),
) -> DataFrame:
    """Pairs ``(i, j)``, ``i < j``, of rows that share a bucket, distinct unless ``once`` is false.

    ``postings`` has the bucket ``key``, ``row_id`` and the ``size`` of the bucket. ``condition`` over the aliases ``a`` and ``b`` drops pairs inside the join, before
    anything is written. Where pairs are many more than rows, tasks of equal rows can hold most of the pairs: the join then runs in
    ``parts`` tasks (see ``task_count``), whatever the size of the rows. ``more`` are further columns over ``a`` and ``b``.
    """
    a, b = _chunked(postings, size, True, chunk), _chunked(postings, size, False, chunk)
    if parts is not None:
        a, b = (side.repartition(parts, key, "_cell.lo", "_cell.hi") for side in (a, b))
    a, b = a.alias("a"), b.alias("b")
    on = (
        (F.col(f"a.{key}") == F.col(f"b.{key}"))
        & (F.col("a._cell.lo") == F.col("b._cell.lo"))
        & (F.col("a._cell.hi") == F.col("b._cell.hi"))
        & (F.col("a.row_id") != F.col("b.row_id"))
        & ((F.col("a._cell.lo") < F.col("a._cell.hi")) | (F.col("a.row_id") < F.col("b.row_id")))
    )
    if condition is not None:
        on = on & condition
    pairs = a.join(b, on).select(
        F.least("a.row_id", "b.row_id").alias("i"),
        F.greatest("a.row_id", "b.row_id").alias("j"),
        *more,
    )
    return pairs.distinct() if once else pairs


def leader_pairs(postings: DataFrame, key: str = "term") -> DataFrame:
    """Each row of a bucket paired with the bucket's smallest row: linear in the bucket."""
    leaders = postings.groupBy(key).agg(F.min("row_id").alias("i"))
    return (
        postings.join(leaders, key)
        .where(F.col("row_id") > F.col("i"))
        .select("i", F.col("row_id").alias("j"))
        .distinct()
    )


def crossing_pairs(
    postings: DataFrame,
    labels: DataFrame,
    key: str = "term",
    condition: Column | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Pairs of rows that share a bucket but lie in different components.

    ``labels(row_id, component)`` covers connected rows, others stand alone. Within a bucket the
    members of its largest component need no pairs among themselves, so only the rest is compared
    with the bucket; a bucket inside one component costs nothing. Both sides are cut into chunks, so a
    join key holds about ``chunk`` rows a side.
    """
    placed = postings.join(labels, "row_id", "left").withColumn(
        "component", F.coalesce("component", "row_id")
    )
    largest = (
        placed.groupBy(key, "component")
        .agg(F.count("*").alias("n"))
        .groupBy(key)
        .agg(
            F.max(F.struct("n", "component")).alias("top"),
            F.count("*").alias("components"),
            F.sum("n").alias("rows"),
        )
        .where(F.col("components") > 1)
        .select(
            key, F.col("top.component").alias("top"), "rows", (F.col("rows") - F.col("top.n")).alias("rest")
        )
    )
    mixed = placed.join(largest, key)

    def chunks(rows: str) -> Column:
        return F.greatest(F.ceil(F.col(rows) / chunk).cast("int"), F.lit(1))

    def own(rows: str) -> Column:
        return F.pmod(F.xxhash64("row_id"), chunks(rows)).cast("int")

    minor = (
        mixed.where(F.col("component") != F.col("top"))
        .withColumn("_part", own("rest"))
        .withColumn("_cell", F.explode(F.sequence(F.lit(0), chunks("rows") - 1)))
        .alias("a")
    )
    every = (
        mixed.withColumn("_cell", own("rows"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), chunks("rest") - 1)))
        .alias("b")
    )
    on = (
        (F.col(f"a.{key}") == F.col(f"b.{key}"))
        & (F.col("a._cell") == F.col("b._cell"))
        & (F.col("a._part") == F.col("b._part"))
        & (F.col("a.component") != F.col("b.component"))
        & ((F.col("b.component") == F.col("b.top")) | (F.col("a.row_id") < F.col("b.row_id")))
    )
    if condition is not None:
        on = on & condition
    return (
        minor.join(every, on)
        .select(
            F.least("a.row_id", "b.row_id").alias("i"),
            F.greatest("a.row_id", "b.row_id").alias("j"),
        )
        .distinct()
    )
