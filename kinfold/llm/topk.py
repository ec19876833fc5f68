"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Vectors are quantised to whole numbers and dealt into blocks. A block's index has one posting list for each
dimension and sign of the query: its rows by falling impact, cut into ``LEVELS`` segments whose impact
bounds are the quantised impacts. For a query the segments of all lists are processed by falling
``|query component| * bound``, adding exact contributions to the rows' accumulators. After every round
the rows that can still be among the best are those whose accumulator plus the most that their unseen
lists can add reaches the k-th best proven score. Processing stops on proof: when so few rows are left
that scoring them is cheaper than going on, or none is, no other row can be a member. Those possible
members are then scored exactly from their vectors. The k-th score carries over to later blocks of the task, so
they are pruned from their start.

Queries are rows themselves, in blocks of ``QUERY_BLOCK``: each index block meets each query block once (a
stated query set against all rows), through an equi-join on the query block's number. A task keeps
``k`` rows a query, so what is shuffled to the final ranking is small however large the table is.

Nulls and edges: a vector that is null, empty or holds a null, NaN or infinite component takes no part,
as query or candidate; nor does a row with a null id; vectors of different sizes meet as if padded with
zeros; equal scores rank by smaller id; rows that repeat an id are candidates of each other's queries by
no means (a query's own id is left out), and a repeated query id is asked once, with its largest vector;
fewer than ``k`` candidates give fewer rows. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import materialize

K = 10
SCALE = 1024
BLOCK = 4096
QUERY_BLOCK = 256
LEVELS = 16
#: Shares of a query's segments after which it is looked at what can still be a member. On dense vectors
#: hardly anything is proven before the first look.
LOOKS = (0.7, 0.85, 1.0)
#: Possible members, for each wanted row, that are scored directly instead of going on.
DIRECT = 16


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, v)``: ``floor(scale * x)`` of every component, for rows whose components are all finite."""
    value = lambda x: x.cast("double")
    bad = lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == F.lit(float("inf")))
    usable = F.col(key).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * value(x)).cast("long"))
    return vectors.where(usable).select(F.col(key).alias("id"), whole.alias("v"))


def in_blocks(rows: DataFrame, block: str, count: int) -> DataFrame:
    """``(block, rows)`` with the rows of a block as one array, dealt by a hash of id and vector.

    A block has about as many rows as planned: that bound, not the data, is what one row holds.
    """
    own = F.pmod(F.xxhash64("id", "v"), F.lit(count)).alias(block)
    return rows.groupBy(own).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))


def matrix(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, short vectors padded with zeros."""
    entries = rows.values
    ids = entries.field("id").to_numpy()
    vectors = entries.field("v")
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    out = np.zeros((len(ids), sizes.max()), dtype=np.int64)
    out[np.repeat(np.arange(len(ids)), sizes), np.concatenate([np.arange(n) for n in sizes])] = vectors.flatten().to_numpy()
    return ids, out


class ImpactIndex:
    """Posting lists of one block, by dimension and sign: rows by falling impact, cut into segments."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors, self.doubles, self.largest = vectors, vectors.astype(float), int(np.abs(vectors).max())
        n, width = vectors.shape
        self.scratch = {"i": np.empty_like(self.vectors), "f": np.empty_like(self.doubles)}
        self.levels = min(levels, n)
        rank_level = (np.arange(n) * self.levels // n).astype(np.int8)
        first = np.searchsorted(rank_level, np.arange(self.levels))
        # For each sign: the segment of every row in every list, the segments' bounds and the lists' least.
        self.segment, self.bounds, self.least = [], [], []
        for sign in (1, -1):
            impact = vectors * sign
            order = np.argsort(-impact, axis=0, kind="stable")
            segment = np.empty((n, width), dtype=np.int8)
            np.put_along_axis(segment, order, np.broadcast_to(rank_level[:, None], (n, width)), axis=0)
            self.segment.append(segment)
            self.bounds.append(np.take_along_axis(impact, order[first], axis=0))
            self.least.append(impact.min(axis=0))

    def search(self, query: np.ndarray, k: int, floor: int | None, skip: np.ndarray) -> np.ndarray:
        """Rows that can be among the ``k`` best of those not in ``skip``.

        ``floor`` is a score that members must reach. The answer holds every member, and possibly more.
        """
        allowed = np.ones(len(self.vectors), dtype=bool)
        allowed[skip] = False
        live = np.flatnonzero(query)
        if not len(live):
            return np.flatnonzero(allowed)
        down = query[live] < 0
        weight = np.abs(query[live])
        pick = lambda pair: np.where(down, pair[1][..., live], pair[0][..., live])
        segment, bound = pick(self.segment), pick(self.bounds) * weight
        least = pick(self.least) * weight
        # Bounds fall along each list, so falling impact processes every list from its front.
        lists = np.argsort(-(bound - least).ravel(), kind="stable") % len(live)
        ends = np.vstack([bound, least])
        done = np.zeros(len(live), dtype=np.int8)
        # Whole numbers below 2 ** 53 are exact as doubles, which multiply faster.
        values = self.doubles if self.largest * int(weight.sum()) < 1 << 53 else self.vectors
        values = values if len(live) == values.shape[1] else values[:, live]
        ask, ends = query[live].astype(values.dtype), ends.astype(values.dtype)
        seen, part_of = np.zeros(len(values), dtype=values.dtype), self.scratch[values.dtype.kind][:, : len(live)]
        for part in np.split(lists, [round(share * len(lists)) for share in LOOKS[:-1]]):
            after = done + np.bincount(part, minlength=len(live)).astype(np.int8)
            now = (segment >= done) & (segment < after)
            seen += np.multiply(values, now, out=part_of) @ ask
            done, unseen = after, part_of
            unseen[:] = segment >= after
            highest, lowest = (unseen @ np.stack([ends[done, np.arange(len(live))], ends[-1]], axis=1)).T
            most, proven = seen + highest, (seen + lowest)[allowed]
            threshold = np.partition(proven, -k)[-k] if len(proven) >= k else None
            if floor is not None:
                threshold = floor if threshold is None else max(threshold, floor)
            if threshold is None:
                continue
            members = np.flatnonzero(allowed & (most >= threshold))
            if len(members) <= DIRECT * k:
                return members
        return members if threshold is not None else np.flatnonzero(allowed)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    key: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` best rows of each query, its own id left out."""
    rows = materialize(quantised(vectors, key, vector), "quantised")
    asked = rows.where(is_query).groupBy("id").agg(F.max("v").alias("v"))
    asked = materialize(asked, "queries")
    n, q = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-q // query_block))
    queries = in_blocks(asked, "query_block", query_blocks).withColumnRenamed("rows", "queries")
    index = materialize(in_blocks(rows, "block", blocks), "blocks")
    every = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    met = every.join(queries, "query_block").select("query_block", "queries", "rows", "block")
    met = met.repartition(blocks * query_blocks, "query_block", "block").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                query_ids, asks = matrix(batch.column(1)[at])
                ids, block_vectors = matrix(batch.column(2)[at])
                width = max(asks.shape[1], block_vectors.shape[1])
                pad = lambda m, w=width: np.pad(m, ((0, 0), (0, w - m.shape[1])))
                asks, index_ = pad(asks), ImpactIndex(pad(block_vectors))
                for query_id, ask in zip(query_ids.tolist(), asks, strict=True):
                    old_ids, old_scores = best.get(query_id, (ids[:0], ids[:0]))
                    floor = int(old_scores[-1]) if len(old_scores) == k else None
                    found = index_.search(ask, k, floor, np.flatnonzero(ids == query_id))
                    scores = np.r_[old_scores, index_.vectors[found] @ ask]
                    members = np.r_[old_ids, ids[found]]
                    order = np.lexsort((members, -scores))[:k]
                    best[query_id] = members[order], scores[order]
        for query_id, (members, scores) in best.items():
            columns = [np.full(len(members), query_id), members, scores]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    found = met.mapInArrow(run, "query_id long, id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score"
    )
