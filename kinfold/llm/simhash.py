"""SimHash near-duplicates: bucketed fingerprints, pivot distance tables, connected components.

A document's fingerprint is the bitwise majority of its shingles' XXH64 hashes. Equal fingerprints are
folded first, so copies cost one row. Of the rest, two that differ in at most ``k`` bits agree on at
least two of ``k + 2`` bit blocks; every pair of blocks is a bucket key, and only rows of one bucket
meet. Within a bucket each fingerprint has its Hamming distances to ``PIVOTS`` reference fingerprints.
By the triangle inequality a pair whose distances to any reference differ by more than ``k`` is no link;
such pairs are discarded by a range search on the first reference and the largest coordinate difference
on the others, and the survivors are verified bit by bit. A bucket gives a spanning forest of its links,
never its pairs. Buckets above ``CHUNK`` rows are cut into chunks and every pair of chunks is a key of
its own, so no task holds more than two chunks of one bucket; nothing is dropped.

Nulls and edges: a null or wordless text has fingerprint zero and is linked like any other; texts of
fewer words than a shingle hash as one sequence; null ids are allowed but cannot name a component;
repeated ids are rows like others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, text_of
from kinfold.operators.components import connected_components, smallest_reachable

BITS = 64
SEED = 42
PIVOTS = 16
CHUNK = 2048
#: Pairs that are compared at once inside a task.
PAIRS = 1 << 20


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in more than half of ``hashes``."""
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """Fingerprint of one UTF-8 text; only A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``(key, fp)`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            column = np.array(prints, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(column)], names=[key, "fp"])

    slim = docs.select(key, text_of().cast("binary").alias("_text"))
    return slim.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of ``max_bits + 2`` blocks that cover the fingerprint."""
    edges = [round(k * BITS / (max_bits + 2)) for k in range(max_bits + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def bucket_keys(max_bits: int) -> Column:
    """For every two blocks a key of their bits: two prints within ``max_bits`` share at least one."""

    def cut(first: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for number, ((a, wa), (b, wb)) in enumerate(combinations(_blocks(max_bits), 2)):
        both = cut(a, wa) if wa == BITS else F.shiftleft(cut(a, wa), wb).bitwiseOR(cut(b, wb))
        keys.append(F.struct(F.lit(number).alias("blocks"), both.alias("bits")))
    return F.array(*keys)


def pivot_distances(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of every print to the reference fingerprints, one column a reference."""
    pivots = np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def links(prints: np.ndarray, side: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs; with ``side``, only pairs of rows on different sides."""
    table = pivot_distances(prints)
    order = np.argsort(table[:, 0], kind="stable")
    table, prints = table[order], prints[order]
    side = side[order] if side is not None else None
    first = table[:, 0]
    reach = np.searchsorted(first, first + max_bits, side="right")
    width = reach - np.arange(len(prints)) - 1
    left, right, start = [], [], 0
    while start < len(prints):
        stop = start + max(1, int(np.searchsorted(np.cumsum(width[start:]), PAIRS, side="right")))
        rows = np.repeat(np.arange(start, stop), width[start:stop])
        begun = np.cumsum(width[start:stop]) - width[start:stop]
        others = rows + 1 + np.arange(len(rows)) - np.repeat(begun, width[start:stop])
        if side is not None:
            near = side[rows] != side[others]
            rows, others = rows[near], others[near]
        for pivot in range(1, PIVOTS):
            near = np.abs(table[rows, pivot] - table[others, pivot]) <= max_bits
            rows, others = rows[near], others[near]
        near = np.bitwise_count(prints[rows] ^ prints[others]) <= max_bits
        left.append(order[rows[near]])
        right.append(order[others[near]])
        start = stop
    return np.concatenate(left), np.concatenate(right)


def bucket_links(prints: DataFrame, max_bits: int, chunk: int = CHUNK) -> DataFrame:
    """``(i, j)``: links that connect whatever is linked among the distinct ``fp`` of ``prints``."""
    keyed = prints.select("fp", F.explode(bucket_keys(max_bits)).alias("_k")).select("fp", "_k.*")
    sizes = keyed.groupBy("blocks", "bits").agg(F.count("*").alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cells = (
        keyed.join(sizes, ["blocks", "bits"])
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(
            F.xxhash64("blocks", "bits", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("cell"),
            F.when(F.col("_other") == F.col("_own"), -1).otherwise(F.col("_own")).alias("side"),
            "fp",
        )
    )

    def forest(cell_prints: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = links(cell_prints, None if side[0] < 0 else side, max_bits)
        root = smallest_reachable(np.arange(len(cell_prints)), left, right)
        leaf = np.flatnonzero(root != np.arange(len(cell_prints)))
        return cell_prints[leaf], cell_prints[root[leaf]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("i", pa.int64()), ("j", pa.int64())])

        def closed(cell: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            found = [
                forest(fp[s : s + n].view(np.uint64), side[s : s + n])
                for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True)
            ]
            ends = [np.concatenate(x or [np.empty(0, np.uint64)]).view(np.int64) for x in (
                [a for a, _ in found], [b for _, b in found])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], schema=schema)

        rest = [np.empty(0, np.int64)] * 3
        for batch in batches:
            now = [np.r_[a, c.to_numpy().astype(np.int64)] for a, c in zip(rest, batch.columns, strict=True)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last:
                yield closed(*(x[:last] for x in now))
            rest = [x[last:] for x in now]
        if len(rest[0]):
            yield closed(*rest)

    ordered = cells.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "i long, j long")


def _named(rows: DataFrame, key: str, max_bits: int) -> DataFrame:
    """``(fp, label, component_id)``: each print's component and its smallest id, from written ``(key, fp)``."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(key).alias("_first")), "distinct")
    linked = connected_components(materialize(bucket_links(distinct, max_bits), "links"))
    labelled = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("_label"), "_first"
    )
    lowest = labelled.groupBy("_label").agg(F.min("_first").alias("component_id"))
    return materialize(labelled.join(lowest, "_label").select("fp", "_label", "component_id"), "named")


def components(
    docs: DataFrame, key: str = "doc_id", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """``(key, fp, component_id)``: the smallest id reachable over links of at most ``max_bits`` bits."""
    rows = materialize(fingerprints(docs, key, shingle), "prints")
    return rows.join(_named(rows, key, max_bits).drop("_label"), "fp").select(key, "fp", "component_id")


def survivors(docs: DataFrame, key: str = "doc_id", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each group of ``docs``: that with the smallest id, then the smallest hash of its columns.

    A document is told by its id and a hash of all its columns, so rows that share an id are kept apart, and
    rows that are equal in every column are one document. Null ids come after all others.
    """
    fields = [F.col(f"`{c}`") for c in docs.columns]
    # Nested columns are hashed as JSON; a null counts besides the values, which hashes pass over.
    nested = [t.startswith(("map", "struct", "array")) for _, t in docs.dtypes]
    values = [F.to_json(c) if deep else c for c, deep in zip(fields, nested, strict=True)]
    marked = docs.withColumn("_hash", F.xxhash64(*values, *(c.isNull() for c in fields)))
    rows = fingerprints(marked.select(F.struct(key, "_hash").alias("_unit"), "text"), "_unit", shingle)
    rows = materialize(rows.select(f"_unit.{key}", "_unit._hash", "fp"), "prints")
    label = rows.join(_named(rows.select(key, "fp"), key, max_bits).select("fp", "_label"), "fp")
    order = F.struct(F.col(key).isNull(), F.col(key).alias("id"), F.col("_hash").alias("hash"))
    first = label.groupBy("_label").agg(F.min(order).alias("_first"))
    first = materialize(first.select(F.col("_first.id").alias("_id"), F.col("_first.hash").alias("_hash")), "survivors")
    chosen = marked.join(first, (F.col(key).eqNullSafe(F.col("_id"))) & (marked["_hash"] == first["_hash"]), "left_semi")
    return chosen.dropDuplicates([key, "_hash"]).select(docs.columns)
