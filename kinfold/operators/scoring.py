"""Exact cosines of many pairs of sparse vectors, with vectors sent to cells of pairs and not to every pair.

Rows are dealt over blocks, and a pair belongs to the cell of its two blocks. A cell gets each vector that one of its
pairs needs once, so a vector is copied once for each block that its partners lie in. Rows of a group of near copies
go to one block where the group is small enough.

Where only pairs above a threshold count, their terms are first compared by 16 bits each: terms that fall together are
summed, which can only raise a product, so pairs that stay below the threshold then are surely below it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.sources.worktable import discard, materialize

LEAST_BLOCKS = 8
#: Bytes of the vectors of a block and pairs of a cell, on average.
BLOCK_BYTES = 64 << 20
CELL_PAIRS = 1_000_000
NARROW_BITS = 16
NARROW_BYTES, WIDE_BYTES = 2, 12
SLACK = 1e-9


def _blocks(terms: int, width: int, pairs: int) -> int:
    by_bytes = math.ceil(terms * width / BLOCK_BYTES)
    by_pairs = math.ceil(math.sqrt(2 * pairs / CELL_PAIRS))
    return max(LEAST_BLOCKS, by_bytes, by_pairs)


def _lists(table: pa.Table, column: str) -> list[np.ndarray]:
    """The lists of a column as arrays over the column's own values."""
    out: list[np.ndarray] = []
    for chunk in table.column(column).chunks:
        values, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out.extend(values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
    return out


def _places(ids: list) -> dict:
    """Where each id stands; an id may stand at several places."""
    places: dict = {}
    for at, name in enumerate(ids):
        places.setdefault(name, []).append(at)
    return places


def _partners(pairs: pa.Table) -> Iterator[tuple[object, np.ndarray]]:
    """Each left end with the positions of its pairs."""
    codes = pairs.column("i").combine_chunks().dictionary_encode()
    index = codes.indices.to_numpy()
    order = np.argsort(index, kind="stable")
    ends = np.searchsorted(index[order], np.arange(len(codes.dictionary) + 1))
    for k, name in enumerate(codes.dictionary.to_pylist()):
        yield name, order[ends[k] : ends[k + 1]]


def _maybe_above(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        places, right = _places(rows.column("row_id").to_pylist()), pairs.column("j").to_pylist()
        low = 1 << (NARROW_BITS - 1)
        keys = [k.astype(np.int64) + low for k in _lists(rows, "keys")]
        again = [k.astype(np.int64) + low for k in _lists(rows, "again")]
        more = [n.astype(np.float64) for n in _lists(rows, "more")]
        length = rows.column("length").to_numpy()
        kept = np.zeros(pairs.num_rows, dtype=bool)
        for name, positions in _partners(pairs):
            for a in places.get(name, ()):
                whole = np.bincount(keys[a], minlength=1 << NARROW_BITS).astype(np.float64)
                np.add.at(whole, again[a], more[a])
                for p in positions:
                    for b in places.get(right[p], ()):
                        product = whole[keys[b]].sum() + (whole[again[b]] * more[b]).sum()
                        kept[p] |= product > (threshold - SLACK) * length[a] * length[b]
        return pairs.select(["i", "j"]).filter(pa.array(kept))

    return run


def _cosines(above: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        places, right = _places(rows.column("row_id").to_pylist()), pairs.column("j").to_pylist()
        terms, counts = _lists(rows, "terms"), _lists(rows, "counts")
        length = rows.column("length").to_numpy()
        at: list[int] = []
        scores: list[float] = []
        for name, positions in _partners(pairs):
            for a in places.get(name, ()):
                mine, n = terms[a], counts[a].astype(np.int64)
                for p in positions:
                    for b in places.get(right[p], ()):
                        spot = np.minimum(np.searchsorted(mine, terms[b]), max(len(mine) - 1, 0))
                        product = 0
                        if len(mine) and len(terms[b]):
                            product = int(np.sum(np.where(mine[spot] == terms[b], n[spot] * counts[b], 0)))
                        both = float(length[a] * length[b])
                        score = product / both if both > 0 else 0.0
                        if above is None or score > above:
                            at.append(int(p))
                            scores.append(score)
        found = pairs.select(["i", "j"]).take(pa.array(at, pa.int64()))
        return found.append_column("score", pa.array(scores, pa.float64()))

    return run


def _dealt(pairs: DataFrame, rows: DataFrame, place_i: Column, place_j: Column) -> tuple[DataFrame, DataFrame]:
    """Pairs with their ``cell``, and the rows that each cell needs. Two blocks have one cell, whichever end lies where."""
    cell = F.struct(F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y"))
    placed = pairs.withColumns({"_x": place_i, "_y": place_j}).select("i", "j", cell.alias("cell"))
    needed = placed.select(F.col("cell").alias("at"), F.explode(F.array("i", "j")).alias("row_id")).distinct()
    return placed, needed.join(rows, "row_id")


def _in_cells(placed: DataFrame, rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return placed.groupBy("cell").cogroup(rows.groupBy("at")).applyInArrow(run, schema)


def narrowed(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(i, j)`` that can have a cosine above ``threshold``: none that has is lost."""
    pairs = materialize(pairs.select("i", "j"), "candidates")
    terms = vectors.agg(F.sum(F.size("vec.terms"))).first()[0] or 0
    blocks = _blocks(terms, NARROW_BYTES, pairs.count())
    mask, low = (1 << NARROW_BITS) - 1, 1 << (NARROW_BITS - 1)
    key = lambda t: (t.bitwiseAND(F.lit(mask).cast("long")) - low).cast("smallint")
    repeats = F.filter(
        F.arrays_zip(F.col("vec.terms").alias("term"), F.col("vec.counts").alias("n")), lambda r: r["n"] > 1
    )
    rows = vectors.select(
        "row_id",
        F.sqrt(F.col("vec.norm2").cast("double")).alias("length"),
        F.transform("vec.terms", key).alias("keys"),
        F.transform(repeats, lambda r: key(r["term"])).alias("again"),
        F.transform(repeats, lambda r: r["n"] - 1).alias("more"),
    )
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed, needed = _dealt(pairs, rows, block("i"), block("j"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    kept = materialize(_in_cells(placed, needed, _maybe_above(threshold), schema), "narrowed")
    discard(pairs)
    return kept


def score_pairs(pairs: DataFrame, vectors: DataFrame, above: float | None = None) -> DataFrame:
    """Exact cosine ``score`` of the pairs ``(i, j)``; with ``above``, of those that exceed it."""
    names = pairs.select("i", "j")
    pairs = materialize(names, "pairs") if above is None else narrowed(names, vectors, above)
    size = vectors.agg(F.sum(F.size("vec.terms")).alias("terms"), F.count("*").alias("rows")).first()
    blocks = _blocks(size["terms"] or 0, WIDE_BYTES, pairs.count())
    share = max(1, size["rows"] // blocks)
    ends = pairs.select(F.col("i").alias("row_id"), F.col("j").alias("_other")).unionByName(
        pairs.select(F.col("j").alias("row_id"), F.col("i").alias("_other"))
    )
    labels = ends.groupBy("row_id").agg(F.least("row_id", F.min("_other")).alias("_label"))
    sizes = labels.groupBy("_label").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("row_id"), F.ceil(F.col("_n") / share).cast("long"))
    block = F.pmod(F.xxhash64("_label") + part, F.lit(blocks)).cast("int")
    places = materialize(labels.join(sizes, "_label").select("row_id", block.alias("_block")), "places")
    # Vectors without a pair are left out before vectors are sent by their ids.
    rows = vectors.join(places.select("row_id"), "row_id", "left_semi").select(
        "row_id",
        F.sqrt(F.col("vec.norm2").cast("double")).alias("length"),
        F.col("vec.terms").alias("terms"),
        F.col("vec.counts").alias("counts"),
    )
    met = pairs.join(places.toDF("i", "_bi"), "i").join(places.toDF("j", "_bj"), "j")
    placed, needed = _dealt(met, rows, F.col("_bi"), F.col("_bj"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", score double"
    return _in_cells(placed, needed, _cosines(above), schema)
