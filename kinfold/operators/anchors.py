"""Exact similar pairs of dense vectors, with angle bounds in place of most block products.

Angles obey the triangle inequality. Rows go to the cell of their nearest anchor, and of every cell the
least and greatest angle to each anchor are known. A pair above the threshold is at most ``reach`` =
acos(threshold) apart, so a row can have a partner in a cell only if its own angle to every anchor lies within
``reach`` of the cell's range for that anchor. A row meets its own cell and the cells of higher number that pass;
all other products are proven needless. No pair is lost, whatever the anchors are: they decide the cost alone.

Anchors are taken farthest first from a bounded sample, told by a hash of the id, so every run takes the same. The driver holds
at most ``MAX_ANCHORS`` vectors and, for each pair of anchors, one range. Cells and their visitors are cut into blocks of
bounded size and every pair of blocks is a task's group, so a cell with a third of all rows is spread.

Vectors without a direction (zero, null, or with null or non-finite components) have no pairs. Where the vectors have no
clusters, or the threshold is low, the bounds prove little: ``Plan.counts`` tells the share of pairs that was skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.dense import SENT_ROWS, _links, _passing
from kinfold.operators.components import connected_components
from kinfold.sources.worktable import materialize

MAX_ANCHORS = 256
SAMPLE_ROWS = 4_096
#: Rows for which one more anchor is taken.
ROWS_AN_ANCHOR = 500
SEED = 11
#: Angles are taken this much wider than computed; rounding near a cosine of one is below it.
SLACK = 1e-6


@dataclass
class Plan:
    """Rows with their cell and the higher cells they must meet.

    ``rows`` has ``(row_id, vector, cell, visits array<int>)``, vectors of unit length; ``home`` and ``visitors`` count
    a cell's rows and those that come to it.
    """

    rows: DataFrame
    home: dict[int, int]
    visitors: dict[int, int]

    def counts(self) -> tuple[int, int]:
        """Pairs whose product is taken, and all pairs."""
        n = sum(self.home.values())
        inside = sum(m * (m - 1) // 2 for m in self.home.values())
        between = sum(self.home.get(c, 0) * m for c, m in self.visitors.items())
        return inside + between, n * (n - 1) // 2


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(row_id, vector)`` of unit length, of the rows that have a direction."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("row_id"), vector.alias("vector")).where(
        F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    )
    largest = F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    scaled = rows.withColumn("_m", largest).where("_m > 0").select(
        "row_id", F.transform("vector", lambda x: x / F.col("_m")).alias("vector")
    )
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return scaled.withColumn("_n", length).select(
        "row_id", F.transform("vector", lambda x: x / F.col("_n")).alias("vector")
    )


def farthest_first(sample: np.ndarray, anchors: int) -> np.ndarray:
    """Rows of ``sample``, each next one farthest from those before; equal rows are not taken twice."""
    taken = [0]
    nearest = sample @ sample[0]
    while len(taken) < min(anchors, len(sample)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        taken.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    return sample[taken]


def _angles(values: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(values @ anchors.T, -1.0, 1.0))


def _assigned(rows: DataFrame, anchors: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _angles(_matrix(batch.column("vector")), anchors).argmin(axis=1).astype(np.int32)
                yield batch.append_column("cell", pa.array(cell))

    return rows.mapInArrow(run, "row_id long, vector array<double>, cell int")


def _ranges(assigned: DataFrame, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest angle of each cell's rows (axis 0) to each anchor (axis 1)."""
    k = len(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            if batch.num_rows:
                angles, cell = _angles(_matrix(batch.column("vector")), anchors), batch.column("cell").to_numpy()
                np.minimum.at(low, cell, angles)
                np.maximum.at(high, cell, angles)
        cell, anchor = np.nonzero(high > -np.inf)
        names = ["cell", "anchor", "low", "high"]
        found = [cell.astype(np.int32), anchor.astype(np.int32), low[cell, anchor], high[cell, anchor]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    parts = assigned.mapInArrow(run, "cell int, anchor int, low double, high double")
    low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    met = parts.groupBy("cell", "anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in met.toLocalIterator():  # at most MAX_ANCHORS squared rows
        low[r["cell"], r["anchor"]], high[r["cell"], r["anchor"]] = r["low"], r["high"]
    return low, high


def planned(
    vectors: DataFrame, threshold: float, id_col: str = "row_id", vector_col: str = "embedding",
    anchors: int | None = None,
) -> Plan:
    """Cells, and for every row the cells that may hold partners above ``threshold`` (0 or more)."""
    if threshold < 0:
        raise ValueError("angle bounds need a threshold of 0 or more")
    rows = materialize(unit_vectors(vectors, id_col, vector_col), "unit")
    draw = F.xxhash64("row_id", F.lit(SEED))
    sample = [r["vector"] for r in rows.orderBy(draw, "row_id").limit(SAMPLE_ROWS).toLocalIterator()]
    if not sample:
        empty = rows.select("*", F.lit(0).alias("cell"), F.array().cast("array<int>").alias("visits"))
        return Plan(empty, {}, {})
    wanted = math.ceil(rows.count() / ROWS_AN_ANCHOR) if anchors is None else anchors
    points = farthest_first(np.array(sample), max(1, min(wanted, MAX_ANCHORS)))
    assigned = materialize(_assigned(rows, points), "cells")
    low, high = _ranges(assigned, points)
    reach = math.acos(min(threshold, 1.0)) + SLACK

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles, cell = _angles(_matrix(batch.column("vector")), points), batch.column("cell").to_numpy()
            meets = np.zeros((batch.num_rows, len(points)), dtype=bool)
            for c in range(1, len(points)):
                near = cell < c
                near[near] = ((angles[near] >= low[c] - reach) & (angles[near] <= high[c] + reach)).all(axis=1)
                meets[:, c] = near
            ends = np.concatenate([[0], meets.sum(axis=1).cumsum()]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(meets)[1].astype(np.int32)))
            yield batch.append_column("visits", lists)

    met = materialize(
        assigned.mapInArrow(visit, "row_id long, vector array<double>, cell int, visits array<int>"), "visits"
    )
    home = met.groupBy("cell").agg(F.count("*").alias("n"))
    come = met.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    count = lambda df: {r["cell"]: r["n"] for r in df.toLocalIterator()}
    return Plan(met, count(home), count(come))


def _met_blocks(plan: Plan, block_rows: int):
    """Groups of rows that are multiplied: pairs of a cell's blocks, and its blocks with its visitors' blocks.

    A cell's own blocks come first, its visitors' after them; both are dealt by a hash of the id.
    """
    of = lambda counts: F.element_at(
        F.create_map(*(F.lit(x) for c in sorted(plan.home) for x in (c, math.ceil(counts.get(c, 0) / block_rows)))),
        F.col("cell"),
    )
    draw = lambda n: F.pmod(F.xxhash64("row_id", F.lit(SEED + 1)), n).cast("int")
    span = lambda first, n: F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))
    if not plan.home:
        sided = plan.rows.select("row_id", "vector", "cell", F.lit(0).alias("own"), F.lit(0).alias("other"))
    else:
        sized = lambda df: df.withColumn("_h", of(plan.home)).withColumn("_v", of(plan.visitors))
        home = sized(plan.rows.select("row_id", "vector", "cell")).withColumn("own", draw(F.col("_h")))
        home = home.withColumn("other", F.explode(span(F.lit(0), F.col("_h") + F.col("_v"))))
        come = sized(plan.rows.select("row_id", "vector", F.explode("visits").alias("cell"))).where("_v > 0")
        come = come.withColumn("own", F.col("_h") + draw(F.col("_v")))
        come = come.withColumn("other", F.explode(span(F.lit(0), F.col("_h"))))
        sided = home.unionByName(come).drop("_h", "_v")
    return (
        sided.withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("other")
        .groupBy("cell", "lo", "hi")
    )


def similar_pairs(plan: Plan, threshold: float, block_rows: int = SENT_ROWS) -> DataFrame:
    """All pairs ``(i, j, score)`` with ``i < j`` and a cosine strictly above ``threshold``.

    ``plan`` must be made for this threshold or a lower one.
    """

    def block(table: pa.Table) -> pa.Table:
        return _passing(table, threshold)

    return _met_blocks(plan, block_rows).applyInArrow(block, "i long, j long, score double")


def similar_groups(plan: Plan, threshold: float, block_rows: int = SENT_ROWS) -> DataFrame:
    """``(group_id, member_id)``: components of the pairs above ``threshold``.

    A pair of blocks gives the links of a forest and not its pairs, so a large set of copies is about one link a row and pair of blocks.
    """

    def block(table: pa.Table) -> pa.Table:
        return _links(table, threshold).select(["i", "j"])

    links = materialize(_met_blocks(plan, block_rows).applyInArrow(block, "i long, j long"), "links")
    return connected_components(links).select(
        F.col("component").alias("group_id"), F.col("node").alias("member_id")
    )
