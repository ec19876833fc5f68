"""Vector code compression: product codes whose parts are assigned through a lexicographic trie.

Vectors become whole numbers and are cut into ``PARTS`` equal consecutive parts. Each part position has a codebook
of up to ``ENTRIES`` entries, refined in ``ROUNDS`` rounds. What is assigned is the distinct parts with their
counts, in lexicographic order: each task reads a sorted stretch and walks the trie of its parts depth
first. A node holds the distances that its prefix has gathered to every entry, so parts with common first
dimensions share that work; a leaf takes the nearest entry and adds its part, times its count, to that
entry's sums. The walk goes down in blocks of up to ``BLOCK`` siblings, so a task holds one block of distances a level.

Parts are packed as bytes that sort like their numbers. Copies are folded inside each task and by a sum
before the parts are ordered, so a vector held by a third of all rows is one part a position.
Only codebooks (entries x dimensions) and their sums reach the driver.

Nulls and edges: rows whose vector is null or holds null or non-finite components are dropped; shorter
vectors (empty ones too) and sizes that the number of parts does not divide are filled up with zeros to the longest;
numbers beyond ``LIMIT`` count as ``LIMIT``, and errors that no long holds as the largest long. Rows with
a null id have codes but seed no codebook; repeated ids seed it in the order of their vectors; fewer rows than
entries give fewer entries. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Sibling nodes whose distances are held at once, and vectors whose parts make one trie.
BLOCK = 4096
VECTORS = 16_384
LIMIT = 1 << 52
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """Numbers of parts and of dimensions a part, and bytes of a packed number."""

    parts: int
    width: int
    item: int

    def packed(self, values: np.ndarray) -> np.ndarray:
        """Rows of whole numbers as byte strings of one size, in the order of their numbers."""
        shifted = (values + self.middle).astype(f">u{self.item}")
        return shifted.view(f"S{self.item * self.width}")[:, 0]

    def numbers(self, packed: np.ndarray) -> np.ndarray:
        raw = np.ascontiguousarray(packed).view(f">u{self.item}").reshape(-1, self.width)
        return raw.astype(np.int64) - self.middle

    @property
    def middle(self) -> int:
        """What is added so that no number is negative."""
        return min(1 << (8 * self.item - 1), 2 * LIMIT)


def exact_kind(largest: int, width: int, rows: int) -> type:
    """Whole numbers of 64 bits where no distance and no sum can leave them, else Python's."""
    return np.int64 if max(width * (2 * largest) ** 2, largest * rows) < 1 << 62 else object


@dataclass
class Trie:
    """Distinct parts in lexicographic order; a node of depth ``d`` is a run of equal ``d``-prefixes."""

    parts: np.ndarray

    def __post_init__(self) -> None:
        n, width = self.parts.shape
        new = np.ones((n, width), dtype=bool)
        new[1:] = np.logical_or.accumulate(self.parts[1:] != self.parts[:-1], axis=1)
        #: First part of every node, by depth; the root is depth 0.
        self.firsts = [np.zeros(1, dtype=np.int64), *(np.flatnonzero(new[:, d]) for d in range(width))]

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (the first of equals) and squared distance of every part."""
        n, width = self.parts.shape
        code, error = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=entries.dtype)
        parts = self.parts.astype(entries.dtype)

        def descend(depth: int, low: int, high: int, gathered: np.ndarray) -> None:
            """Walk below the nodes ``low .. high`` of ``depth``, whose distances are ``gathered``."""
            if depth == width:
                at = self.firsts[depth][low:high]
                best = np.argmin(gathered, axis=1)
                code[at], error[at] = best, gathered[np.arange(high - low), best]
                return
            children = self.firsts[depth + 1]
            ends = np.append(self.firsts[depth], n)[[low, high]]
            begin, end = np.searchsorted(children, ends)
            owner = np.searchsorted(self.firsts[depth], children[begin:end], side="right") - 1 - low
            for start in range(begin, end, BLOCK):
                stop = min(end, start + BLOCK)
                value = parts[children[start:stop], depth]
                step = value[:, None] - entries[None, :, depth]
                below = gathered[owner[start - begin : stop - begin]] + step * step
                descend(depth + 1, start, stop, below)

        if n:
            descend(0, 0, 1, np.zeros((1, len(entries)), dtype=entries.dtype))
        return code, error


def whole_numbers(vectors: DataFrame, key: str, vector: str, extra: list[Column]) -> DataFrame:
    """``(_id, *extra, _v)``: the rows that take part, components scaled and rounded down."""
    value = lambda x: x.cast("double")
    bad = lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == F.lit(float("inf")))
    limit = F.lit(float(LIMIT))
    scaled = lambda x: F.greatest(F.least(value(x) * F.lit(float(SCALE)), limit), -limit)
    whole = F.transform(vector, lambda x: F.floor(scaled(x)).cast("long"))
    usable = F.col(vector).isNotNull() & ~F.exists(vector, bad)
    return vectors.where(usable).select(F.col(key).alias("_id"), *extra, whole.alias("_v"))


def matrix(column: pa.ListArray, shape: Shape) -> np.ndarray:
    """Vectors of a batch as whole numbers, filled up with zeros: rows x parts x dimensions."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), shape.parts * shape.width), dtype=np.int64)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), inside] = column.flatten().to_numpy()
    return out.reshape(len(column), shape.parts, shape.width)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = VECTORS) -> Iterator[pa.RecordBatch]:
    """Batches joined up to ``rows`` rows, so that tries share more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.num_rows for b in held) + batch.num_rows > rows:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def distinct_parts(whole: DataFrame, shape: Shape) -> DataFrame:
    """``(pos, part, n)``: the distinct packed parts of every position, with counts, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            values = matrix(batch.column(0), shape)
            for pos in range(shape.parts):
                part, n = np.unique(shape.packed(values[:, pos]), return_counts=True)
                size = part.dtype.itemsize
                offsets = np.arange(0, (len(part) + 1) * size, size, dtype=np.int32)
                data = pa.py_buffer(np.ascontiguousarray(part).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), data])
                columns = [pa.array(np.full(len(part), pos, np.int32)), packed, pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["pos", "part", "n"])

    folded = whole.select("_v").mapInArrow(run, "pos int, part binary, n long")
    summed = folded.groupBy("pos", "part").agg(F.sum("n").alias("n"))
    ordered = summed.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part")
    return materialize(ordered, "parts")


def by_position(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(position, parts in order, counts)`` of a batch of packed parts."""
    pos, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    raw = b"".join(batch.column(1).to_pylist())
    packed = np.frombuffer(raw, dtype=f"S{shape.item * shape.width}")
    order = np.lexsort((packed, pos))
    for here in np.split(order, np.flatnonzero(np.diff(pos[order])) + 1):
        yield int(pos[here[0]]), shape.numbers(packed[here]), n[here]


def refined(parts: DataFrame, shape: Shape, books: np.ndarray, largest: int) -> np.ndarray:
    """The codebooks after one round: each used entry is the floored mean of its parts."""
    entries = books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((shape.parts, entries), dtype=object)
        total = np.zeros((shape.parts, entries, shape.width), dtype=object)
        for batch in gathered(batches, shape.parts * VECTORS):
            for pos, values, n in by_position(batch, shape):
                kind = exact_kind(largest, shape.width, int(n.sum()))
                code, _ = Trie(values).nearest(books[pos].astype(kind))
                sums = np.zeros((entries, shape.width), dtype=kind)
                np.add.at(sums, code, values.astype(kind) * n.astype(kind)[:, None])
                held = np.zeros(entries, dtype=np.int64)
                np.add.at(held, code, n)
                count[pos] += held.astype(object)
                total[pos] += sums.astype(object)
        at, entry = np.nonzero(count)
        rows = [
            [int(p), int(e), int(count[p, e]), [str(x) for x in total[p, e]]] for p, e in zip(at, entry, strict=True)
        ]
        names = ["pos", "entry", "n", "sums"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    partial = parts.mapInArrow(run, "pos int, entry int, n long, sums array<string>")
    flat = partial.select("pos", "entry", "n", F.posexplode("sums").alias("dim", "sum"))
    summed = flat.groupBy("pos", "entry", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).cast("string").alias("sum")
    )
    after = books.copy()
    found = summed.toArrow().to_pylist()  # entries x dimensions at most
    for r in found:
        after[r["pos"], r["entry"], r["dim"]] = int(r["sum"]) // r["n"]
    return after


def seeds(whole: DataFrame, shape: Shape, entries: int) -> np.ndarray:
    """Codebooks of the rows with the smallest ids: position x entry x dimension, as Python numbers."""
    first = whole.where(F.col("_id").isNotNull()).orderBy("_id", "_v").limit(entries).select("_v")
    rows = first.toArrow().column("_v").combine_chunks()  # ``entries`` rows at most
    return matrix(rows, shape).transpose(1, 0, 2).astype(object)


def shape_of(whole: DataFrame, parts: int) -> tuple[Shape, int] | None:
    """The shape that fits all vectors and their largest number; none if there is no row."""
    largest = F.aggregate("_v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))
    seen = whole.agg(F.max(F.size("_v")).alias("size"), F.max(largest).alias("largest")).first()
    if seen["size"] is None:
        return None
    item = next(b for b in (2, 4, 8) if seen["largest"] < 1 << (8 * b - 1))
    return Shape(parts, max(1, -(-seen["size"] // parts)), item), int(seen["largest"])


def codebooks(
    whole: DataFrame, shape: Shape, largest: int, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray:
    """The final codebooks; unused entries stay as they were."""
    books = seeds(whole, shape, entries)
    if books.shape[1]:
        parts = distinct_parts(whole, shape)
        for _ in range(rounds):
            books = refined(parts, shape, books, largest)
    return books


def coded(whole: DataFrame, shape: Shape, books: np.ndarray, largest: int) -> DataFrame:
    """``whole`` without its vectors, with ``code`` and ``error``."""
    others = [c for c in whole.columns if c != "_v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = exact_kind(largest, shape.parts * shape.width, 1)
        for batch in gathered(batches):
            values = matrix(batch.column(batch.num_columns - 1), shape)
            codes = np.zeros((batch.num_rows, shape.parts), dtype=np.uint8)
            error = np.zeros(batch.num_rows, dtype=kind)
            for pos in range(shape.parts if books.shape[1] else 0):
                part, at = np.unique(shape.packed(values[:, pos]), return_inverse=True)
                code, missed = Trie(shape.numbers(part)).nearest(books[pos].astype(kind))
                codes[:, pos] = code[at]
                error += missed[at]
            hexed = codes.tobytes().hex()
            size = 2 * shape.parts
            texts = [hexed[k : k + size] for k in range(0, len(hexed), size)]
            bounded = np.minimum(error, LARGEST).astype(np.int64)
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(bounded)]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "code", "error"])

    kinds = [f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in others]
    return whole.mapInArrow(run, ", ".join([*kinds, "code string", "error long"]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(key, code, error, label_error, codebooks_sha256)`` of every row that takes part.

    ``code`` has two hex digits a part, ``error`` is the squared distance to the entries, and ``label_error``
    its sum over the rows with an equal label, nulls together. At most 256 entries.
    """
    whole = whole_numbers(vectors, key, vector, [F.col(label).alias("_label")])
    found = shape_of(whole, parts)
    shape, largest = found or (Shape(parts, 1, 2), 0)
    books = codebooks(whole, shape, largest, entries, rounds) if found else np.zeros((parts, 0, 1), object)
    rows = materialize(coded(whole, shape, books, largest), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = rows.groupBy(F.col("_label").alias("_of")).agg(
        F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error")
    )
    joined = rows.join(sums, F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(
        F.col("_id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
