"""Mixing sources to target weights by cube-method balanced sampling.

Sources get targets in proportion to their weights, up to a cap on repeats. A document of a source is
taken ``floor(ratio)`` times, and once more with probability ``ratio - floor(ratio)``, where ``ratio``
is target by size. The extra documents are drawn by the cube method (Deville and Tille 2004): inclusion
probabilities move along directions that change neither the number of documents nor the number of words,
until they are 0 or 1. Three open documents always have such a direction, so a bucket of any size ends
with two open ones at most. Sources are dealt over buckets by a hash of the id; what stays open in the
buckets goes on to the next round, in fewer buckets, until each source has one bucket left, whose last
two open documents are landed: of their four roundings the one that misses the fewest words. What a long
document leaves missing then is made good by swapping documents within that last bucket. The words taken
of a source miss its target by less than a document, however many documents it has.

Order and draws come from hashes of ids and group names: reruns and retried tasks agree.

Nulls and edges: a null text has size 0; null sources are one source and rank last; documents of size 0
take no words; repeated ids are units of their own; a source without words has target 0. Extra columns
are kept by ``mixed`` and ignored by ``allotted``. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import WORD, materialize, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2.0
BUCKET = 2_000
SEED = 7
#: Probabilities this close to 0 or 1 are there.
NEAR = 1e-9


def targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """``(source, docs, source_size, target)``, one row a source.

    ``share`` times all words are dealt by weight; a source stops at ``max_repeats`` times its words and
    the rest is dealt again. Sources stop in the order of words by weight, so those that stop are a
    prefix of that order, found by running sums over one row a source.
    """
    every = Window.partitionBy(F.lit(0))
    of = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("_rank") % len(weights) + 1)
    ranked = (
        sizes.groupBy("source")
        .agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
        .withColumn("_rank", F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("_weight", of)
        .withColumn("_stop", F.lit(max_repeats) * F.col("source_size"))
    )
    falling = every.orderBy(F.col("_stop") / F.col("_weight"), "_rank")
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.lit(share) * F.sum("source_size").over(every)) - F.coalesce(F.sum("_stop").over(before), F.lit(0.0))
    ) / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("_level", level)
    stops = F.col("_stop") <= F.col("_level") * F.col("_weight")
    first_open = F.when(~stops, F.struct(F.col("_stop") / F.col("_weight"), "_rank", "_level"))
    open_level = F.min(first_open).over(every)
    shared = F.col("_open")["_level"] * F.col("_weight")
    return leveled.withColumn("_open", open_level).select(
        "source", "docs", "source_size", F.when(stops, F.col("_stop")).otherwise(shared).alias("target")
    )


def _step(p: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` along ``u`` or against it until one of its values is 0 or 1, keeping its mean."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
        down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
    move = up if rng.random() * (up + down) < down else -down
    p = p + move * u
    return np.where(p < NEAR, 0.0, np.where(p > 1 - NEAR, 1.0, p))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Balanced rounding of ``p``: at most two values stay between 0 and 1, none if ``land``.

    Sums of ``p`` and of ``p * size`` stay as they are, but for the landing.
    """
    p, goal = p.astype(float).copy(), p @ size
    held: list[int] = []
    for unit in np.flatnonzero((p > 0) & (p < 1)):
        held.append(int(unit))
        if len(held) < 3:
            continue
        a, b, c = size[held]
        u = np.array([b - c, c - a, a - b], dtype=float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        p[held] = _step(p[held], u / np.abs(u).max(), rng)
        held = [k for k in held if 0 < p[k] < 1]
    if land and held:
        p[held] = landed(p[held], size[held])
        p = exchanged(p, size, float(goal - p @ size))
    return p


def landed(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounding of the last one or two values: least miss in words, then in documents."""
    choices = np.array(list(product((0.0, 1.0), repeat=len(p))))
    words, docs = np.abs((choices - p) @ size), np.abs((choices - p).sum(axis=1))
    return choices[np.lexsort((docs, words))[0]]


def exchanged(p: np.ndarray, size: np.ndarray, miss: float) -> np.ndarray:
    """Swap taken documents for others while that brings the words nearer by ``miss``; documents stay as many."""
    while True:
        taken, free = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if not len(taken) or not len(free):
            return p
        free = free[np.argsort(size[free], kind="stable")]
        wanted = size[taken] + miss
        after = np.clip(np.searchsorted(size[free], wanted), 0, len(free) - 1)
        pairs = np.concatenate([after, np.maximum(after - 1, 0)])
        left = np.abs(np.tile(wanted, 2) - size[free[pairs]])
        best = int(np.argmin(left))
        if left[best] >= abs(miss) - 0.5:
            return p
        gone, come = taken[best % len(taken)], free[pairs[best]]
        p[gone], p[come] = 0.0, 1.0
        miss += size[gone] - size[come]


def _bucket(docs_in_group: Column, bucket: int, salt: int) -> Column:
    count = F.greatest(F.ceil(docs_in_group / bucket), F.lit(1))
    return F.pmod(F.xxhash64("_unit", F.lit(salt)), count).cast("long")


def drawn(units: DataFrame, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """``units`` with ``p`` rounded to 0 or 1, balanced within each ``source``.

    ``units`` has ``source``, ``_unit`` (long, orders rows), ``size`` and ``p``. Each round rounds
    buckets of about ``bucket`` rows in tasks; only rows that are still open go to the next round.
    """
    schema = units.schema

    def rounder(land: bool, salt: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "_unit"], ascending=[False, True], kind="stable")
            name = f"{group['source'].iloc[0]}:{group['_bucket'].iloc[0]}:{salt}:{seed}"
            rng = np.random.default_rng(zlib.crc32(name.encode()))
            group["p"] = flight(group["p"].to_numpy(), group["size"].to_numpy(), rng, land)
            return group[schema.names]

        return run

    is_open = (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)
    settled, rest, salt = [units.where(~is_open)], units.where(is_open), seed
    while True:
        counts = materialize(rest.groupBy("source").agg(F.count("*").alias("_n")), "open")
        land = counts.where(F.col("_n") > bucket).isEmpty()
        dealt = (
            rest.withColumnRenamed("source", "_name")
            .join(counts, F.col("_name").eqNullSafe(F.col("source")))
            .drop("_name")
            .withColumn("_bucket", _bucket(F.col("_n"), bucket, salt))
        )
        rounded = materialize(
            dealt.groupBy("source", "_bucket").applyInPandas(rounder(land, salt), schema), "rounded"
        )
        if land:
            return reduce(DataFrame.unionByName, [*settled, rounded])
        settled.append(rounded.where(~is_open))
        rest, salt = rounded.where(is_open), salt + 1


def allotted(
    docs: DataFrame,
    key: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeats: float = MAX_REPEATS,
    bucket: int = BUCKET,
) -> DataFrame:
    """``(key, size, source_size, target, copies, taken)`` of every document.

    ``copies`` is how often the mix takes it and ``taken`` the words it gives so.
    """
    counted = docs.select(
        key,
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(key, text_of()).alias("_unit"),
    )
    sizes = materialize(counted, "sizes")
    goals = materialize(targets(sizes, weights, share, max_repeats), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        sizes.join(goals.withColumnRenamed("source", "_goal"), F.col("source").eqNullSafe(F.col("_goal")))
        .withColumn("_whole", F.floor(ratio + NEAR).cast("long"))
        .withColumn("p", F.greatest(ratio - F.col("_whole"), F.lit(0.0)))
        .select(key, "source", "size", "source_size", "target", "_unit", "_whole", "p")
    )
    copies = (F.col("_whole") + F.col("p").cast("long")).alias("copies")
    return drawn(units, bucket).select(
        key, "_unit", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Rows equal in id and text share what they are given evenly, the larger shares first.
    """
    each = allotted(docs, key, **options).where(F.col("copies") > 0)
    owed = each.groupBy("_unit").agg(F.sum("copies").alias("_copies"))
    rows = docs.withColumn("_unit", F.xxhash64(key, text_of())).dropDuplicates(["_unit"])
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return rows.join(owed, "_unit").select(*docs.columns, times.alias("_time")).drop("_time")
