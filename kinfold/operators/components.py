"""Connected components as rounds of joins (alternating stars, Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.sources.worktable import discard, materialize

MAX_ROUNDS = 60
LOCAL_EDGES = 1_000_000


def smallest_reachable(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lower each label to the smallest one reachable over the links ``left - right``."""
    while True:
        low = label.copy()
        np.minimum.at(low, left, label[right])
        np.minimum.at(low, right, low[left])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _local_stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Shrink each partition's edges to one edge per node, to the smallest node it reaches there.

    Works like a map-side combine: at most ``LOCAL_EDGES`` edges are held at a time, and what they
    connect stays connected.
    """

    def contract(table: pa.Table) -> pa.RecordBatch:
        u, v = (table.column(c).to_numpy() for c in ("u", "v"))
        nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
        graph = np.zeros(len(u), dtype=np.int64)
        for k in keys:
            values, key_code = np.unique(table.column(k).to_numpy(), return_inverse=True)
            graph = graph * len(values) + key_code
        graphs, graph = np.unique(graph, return_inverse=True)
        place = np.concatenate([graph, graph]) * len(nodes) + code
        spots, first, spot = np.unique(place, return_index=True, return_inverse=True)
        left, right = spot[: len(u)], spot[len(u) :]
        root = smallest_reachable(np.arange(len(spots)), left, right)
        leaf = root != np.arange(len(spots))
        row = pa.array(first[leaf] % len(u))
        ends = {k: table.column(k).combine_chunks().take(row) for k in keys}
        ends["u"] = pa.array(nodes[spots[leaf] % len(nodes)], type=table.schema.field("u").type)
        ends["v"] = pa.array(nodes[spots[root[leaf]] % len(nodes)], type=table.schema.field("v").type)
        return pa.RecordBatch.from_arrays(list(ends.values()), names=list(ends))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= LOCAL_EDGES:
                yield contract(pa.Table.from_batches(held))
                held = []
        if held:
            yield contract(pa.Table.from_batches(held))

    return edges.mapInArrow(stars, edges.schema)


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(
        edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
    )
    smallest = both.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(smallest, [*keys, "u"])
        .select(*keys, F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link a node and all its smaller neighbours to the smallest of them (``u > v``)."""
    smallest = edges.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(smallest, [*keys, "u"])
        .where(F.col("v") != F.col("m"))
        .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    )
    own = smallest.select(*keys, "u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()


def _all_stars(edges: DataFrame, keys: list[str]) -> bool:
    """True when every node has one centre and no centre has a centre itself."""
    roles = edges.select(*keys, F.col("u").alias("node"), F.lit(1).alias("leaf")).unionByName(
        edges.select(*keys, F.col("v").alias("node"), F.lit(0).alias("leaf"))
    )
    unsettled = (
        roles.groupBy(*keys, "node")
        .agg(F.sum("leaf").alias("centres"), F.min("leaf").alias("is_leaf"))
        .where((F.col("centres") > 1) | ((F.col("centres") == 1) & (F.col("is_leaf") == 0)))
    )
    return unsettled.isEmpty()


def connected_components(
    edges: DataFrame,
    left: str = "i",
    right: str = "j",
    keys: Sequence[str] = (),
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """``(*keys, node, component)`` for every node with an edge; the component is its smallest node.

    ``keys`` partition the edges into independent graphs that are solved in the same rounds. Edges are
    first shrunk within their partitions; then large-star and small-star joins alternate until every
    component is a star. Each round is written to the shared work folder, so lineage stays flat; hubs are handled by
    map-side ``min`` and adaptive skew joins, never by collecting neighbours.
    """
    keys = list(keys)
    oriented = (
        edges.select(
            *keys, F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
        )
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    current = materialize(
        _local_stars(_local_stars(oriented, keys).distinct(), keys).distinct(), "stars"
    )
    for _ in range(max_rounds):
        if _all_stars(current, keys):
            break
        joined = _small_star(_large_star(current, keys), keys)
        advanced = materialize(_local_stars(joined, keys).distinct(), "stars")
        discard(current)
        current = advanced
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    leaves = current.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    centres = current.select(
        *keys, F.col("v").alias("node"), F.col("v").alias("component")
    ).distinct()
    return leaves.unionByName(centres)
