"""Similarity of dense vectors: exact block-pair products and a hyperplane hash."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import cosine
from kinfold.operators.buckets import CHUNK, bucket_pairs, with_bucket_size
from kinfold.operators.components import connected_components, smallest_reachable
from kinfold.operators.forest import local_forest
from kinfold.sources.worktable import materialize

#: Rows of a matrix product, and rows of a block; a row is sent once for each block.
BLOCK_ROWS = 2_000
SENT_ROWS = 16_000
MIN_BLOCK_ROWS = 250
PAIRS_A_CORE = 4
#: Pairs a row that are linked as a list.
FEW_PAIRS = 8


def block_count(rows: int, cores: int, block_rows: int = SENT_ROWS) -> int:
    """Blocks small enough for one task's memory, and enough block pairs to use the cores."""
    by_memory = math.ceil(rows / block_rows)
    by_cores = math.ceil(math.sqrt(2 * PAIRS_A_CORE * cores))
    return max(1, by_memory, min(by_cores, math.ceil(rows / MIN_BLOCK_ROWS)))


def _block_pairs(vectors: DataFrame, id_col: str, vector_col: str, blocks: int | None):
    """Rows copied to every pair of blocks that their own block is in; each pair is one group."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("row_id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    if blocks is None:
        blocks = block_count(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)
    return (
        rows.withColumn("own", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("other")
        .groupBy("lo", "hi")
    )


PAIRS = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("score", pa.float64())])


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    length = np.sqrt((values * values).sum(axis=1, keepdims=True))
    return np.divide(values, length, out=np.zeros_like(values), where=length > 0)


def _scores(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Score matrices of one block pair with their row and column ids; each pair appears once.

    A matrix has at most ``BLOCK_ROWS`` rows and columns. The last value tells whether they are the same rows.
    """
    ids = table.column("row_id").to_numpy()
    own = table.column("own").to_numpy()
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    unit = _unit_rows(table.column("vector"))
    first, second = np.nonzero(own == lo)[0], np.nonzero(own == hi)[0]
    for x in range(0, len(first), BLOCK_ROWS):
        for y in range(x if lo == hi else 0, len(second), BLOCK_ROWS):
            a, b = first[x : x + BLOCK_ROWS], second[y : y + BLOCK_ROWS]
            same = lo == hi and x == y
            scores = unit[a] @ unit[b].T
            if same:
                scores[np.tril_indices(len(scores))] = -np.inf
            yield scores, ids[a], ids[b], same


def _joined(parts: list[pa.Table], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables(parts) if parts else schema.empty_table()


def _passing(table: pa.Table, threshold: float) -> pa.Table:
    """The pairs of a block pair above ``threshold``."""
    parts = [_pair_table(s, rows, columns, *np.nonzero(s > threshold)) for s, rows, columns, _ in _scores(table)]
    return _joined(parts, PAIRS)


def _links(table: pa.Table, threshold: float) -> pa.Table:
    """The strongest links of a block pair."""
    parts = [_pair_table(s, rows, columns, *_linked(s, same, threshold)) for s, rows, columns, same in _scores(table)]
    return _joined(parts, PAIRS)


def _pair_table(scores, rows, columns, x, y) -> pa.Table:
    a, b = rows[x], columns[y]
    return pa.table({"i": np.minimum(a, b), "j": np.maximum(a, b), "score": scores[x, y]})


def _strongest_links(scores: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep every threshold's components of one score matrix (Boruvka rounds).

    Each round every component takes its best link to another one, so at most about one link per row
    is kept, however many pairs pass the threshold. Few pairs are linked as a list and not as a matrix.
    """
    rows, columns = scores.shape
    x, y = np.nonzero(scores > threshold)
    if len(x) <= FEW_PAIRS * (rows + columns):
        kept = local_forest(x, rows + y, scores[x, y])
        return x[kept], y[kept]
    left = np.where(scores > threshold, scores, -np.inf)
    label = np.arange(rows + columns)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        left[label[:rows, None] == label[None, rows:]] = -np.inf
        best_column, best_row = left.argmax(axis=1), left.argmax(axis=0)
        x = np.concatenate([np.arange(rows), best_row])
        y = np.concatenate([best_column, np.arange(columns)])
        value = left[x, y]
        home = label
        live = value > -np.inf
        if not live.any():
            break
        x, y, value, home = x[live], y[live], value[live], home[live]
        order = np.lexsort((-value, home))
        top = order[np.concatenate([[True], home[order][1:] != home[order][:-1]])]
        x, y = x[top], y[top]
        kept.append((x, y))
        label = smallest_reachable(np.arange(rows + columns), label[x], label[rows + y])[label]
    if not kept:
        nothing = np.empty(0, dtype=int)
        return nothing, nothing
    links = np.unique(np.concatenate([np.stack(k, axis=1) for k in kept]), axis=0)
    return links[:, 0], links[:, 1]


def _linked(scores: np.ndarray, diagonal: bool, threshold: float):
    """``_strongest_links``; on a diagonal block the rows and columns are the same items."""
    if not diagonal:
        return _strongest_links(scores, threshold)
    x, y = np.nonzero(scores > threshold)
    if len(x) <= FEW_PAIRS * len(scores):
        kept = local_forest(x, y, scores[x, y])
        return x[kept], y[kept]
    full = np.maximum(scores, scores.T)
    x, y = _strongest_links(full, threshold)
    pairs = np.unique(np.sort(np.stack([x, y], axis=1), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def similar_pairs(
    vectors: DataFrame,
    threshold: float = 0.8,
    id_col: str = "row_id",
    vector_col: str = "embedding",
    blocks: int | None = None,
) -> DataFrame:
    """All pairs ``(i, j, score)`` with ``i < j`` and a cosine strictly above ``threshold``."""

    def block(table: pa.Table) -> pa.Table:
        return _passing(table, threshold)

    cells = _block_pairs(vectors, id_col, vector_col, blocks)
    return cells.applyInArrow(block, "i long, j long, score double")


def _forest(
    vectors: DataFrame,
    threshold: float,
    levels: Sequence[float],
    id_col: str,
    vector_col: str,
    blocks: int | None,
) -> DataFrame:
    """Per block pair the strongest links, and the number and sum of scores per level.

    Rows are ``(level, n, i, j, score)``: links have a null level, level rows null ids. A level is the
    number of ``levels`` below the score.
    """
    bounds = np.asarray(levels, dtype=float)

    def part(scores: np.ndarray, rows: np.ndarray, columns: np.ndarray, diagonal: bool) -> pa.Table:
        links = _pair_table(scores, rows, columns, *_linked(scores, diagonal, threshold))
        passing = scores[scores > threshold]
        level = np.searchsorted(bounds, passing, side="left")
        n = np.bincount(level, minlength=len(bounds) + 1)
        total = np.bincount(level, weights=passing, minlength=len(bounds) + 1)
        used = np.nonzero(n)[0]
        blank = pa.nulls(len(used), pa.int64())
        return pa.table(
            {
                "level": pa.concat_arrays(
                    [pa.nulls(len(links), pa.int32()), pa.array(used.astype(np.int32))]
                ),
                "n": pa.concat_arrays([pa.nulls(len(links), pa.int64()), pa.array(n[used])]),
                "i": pa.concat_arrays([links.column("i").combine_chunks(), blank]),
                "j": pa.concat_arrays([links.column("j").combine_chunks(), blank]),
                "score": pa.concat_arrays(
                    [links.column("score").combine_chunks(), pa.array(total[used])]
                ),
            }
        )

    names = [("level", pa.int32()), ("n", pa.int64()), *((f.name, f.type) for f in PAIRS)]

    def block(table: pa.Table) -> pa.Table:
        return _joined([part(*tile) for tile in _scores(table)], pa.schema(names))

    cells = _block_pairs(vectors, id_col, vector_col, blocks)
    return cells.applyInArrow(block, "level int, n long, i long, j long, score double")


def strongest_links(
    vectors: DataFrame,
    threshold: float,
    levels: Sequence[float] = (),
    id_col: str = "row_id",
    vector_col: str = "embedding",
    blocks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``links(i, j, score)`` and ``counts(level, n, total)`` of the pairs above ``threshold``.

    The links have the same components as all pairs at every threshold from ``threshold`` up, but
    number at most about one per row and block pair.
    """
    both = materialize(
        _forest(vectors, threshold, list(levels), id_col, vector_col, blocks), "links"
    )
    links = both.where(F.col("level").isNull()).select("i", "j", "score")
    counts = (
        both.where(F.col("level").isNotNull())
        .groupBy("level")
        .agg(F.sum("n").alias("n"), F.sum("score").alias("total"))
    )
    return links, counts


def similar_groups(
    vectors: DataFrame,
    threshold: float = 0.8,
    id_col: str = "row_id",
    vector_col: str = "embedding",
    blocks: int | None = None,
) -> DataFrame:
    """``(group_id, member_id)``: components of the pairs above ``threshold``."""
    links, _ = strongest_links(vectors, threshold, (), id_col, vector_col, blocks)
    return connected_components(links).select(
        F.col("component").alias("group_id"), F.col("node").alias("member_id")
    )


def hyperplane_postings(
    vectors: DataFrame,
    id_col: str = "row_id",
    vector_col: str = "embedding",
    bands: int = 32,
    bits: int = 8,
    seed: int = 42,
) -> DataFrame:
    """``(term, row_id)``: signs of random projections, ``bits`` of them to a band (Charikar 2002)."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("row_id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )

    def codes(batches):
        planes = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("vector")
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((values.shape[1], bands * bits))
            signs = (values @ planes > 0).reshape(len(values), bands, bits)
            code = (signs * (1 << np.arange(bits))).sum(axis=2) + (np.arange(bands) << bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(code.astype(np.int64).ravel()),
                    pa.array(np.repeat(batch.column("row_id").to_numpy(), bands)),
                ],
                names=["term", "row_id"],
            )

    return rows.mapInArrow(codes, "term long, row_id long")


def hashed_pairs(
    vectors: DataFrame,
    threshold: float = 0.8,
    id_col: str = "row_id",
    vector_col: str = "embedding",
    bands: int = 32,
    bits: int = 8,
    seed: int = 42,
    chunk: int = CHUNK,
) -> DataFrame:
    """Approximate ``similar_pairs``: vectors sharing a band, scores exact, some pairs missed."""
    postings = hyperplane_postings(vectors, id_col, vector_col, bands, bits, seed)
    pairs = bucket_pairs(with_bucket_size(postings), chunk=chunk)
    rows = vectors.select(F.col(id_col).alias("row_id"), F.col(vector_col).alias("v"))
    return (
        pairs.join(rows.toDF("i", "_a"), "i")
        .join(rows.toDF("j", "_b"), "j")
        .select("i", "j", cosine(F.col("_a"), F.col("_b")).alias("score"))
        .where(F.col("score") > threshold)
    )
