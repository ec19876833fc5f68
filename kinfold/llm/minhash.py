"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set is its distinct shingles, each known by a 64-bit hash; its sketch is the ``SKETCH`` smallest
hashes. Documents are linked when the Jaccard similarity of their sets reaches ``SIMILARITY``. Equal word
sequences are folded first, so copies cost one row.

*Inverted lists.* Each document offers its ``LISTED`` smallest hashes. Linked documents share at least
``least_overlap`` of them: all but ``MISSED`` of the time by the hypergeometric law, always when the sets are no
larger. So, with hashes ordered from rare to frequent, they meet in the list of one of the first
``LISTED - least_overlap + 1`` (prefix filtering). A passage that many documents share fills lists only of documents that
are made of little else.

*Estimates.* The smallest hashes of two sketches together are a sample of the union; the share that both
hold estimates the similarity. When both sketches hold their whole sets, this is the similarity itself. Else the pair is
dropped only if a linked pair would look like it with a chance below ``MISSED``, by the Chernoff bound.

*Verification.* What the estimate cannot decide is compared on the full sets of shingles, from the texts.

Lists are linked through their first document, and only documents that are still in different components
are compared further: in lists up to ``LIST_ROWS`` as pairs, in longer ones inside tasks that each hold two
chunks of a list and give a spanning forest of its links, never its pairs. Nothing is capped.

Nulls and edges: fewer words than a shingle make one shingle; a null or wordless text has an empty set and is
linked with nothing, not even its like; repeated rows are copies like others; rows with a null id share their
copies' component, and name none (a component of only such rows has a null id, and its rows are kept). Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, text_of
from kinfold.operators.buckets import bucket_pairs, with_bucket_size
from kinfold.operators.components import connected_components, smallest_reachable

SHINGLE = 3
SIMILARITY = 85  # percent
LISTED = 64
SKETCH = 256
#: Chance at most that a linked pair is missed by a list or an estimate.
MISSED = 1e-9
#: Rows of a list that are met as pairs; longer lists are met in chunks of ``CHUNK`` rows.
LIST_ROWS = 256
CHUNK = 512
COLUMNS = 8192
SEED = 42


def shingles(text: bytes, size: int) -> set[bytes]:
    """The distinct shingles of a UTF-8 text; only A-Z are lower-cased."""
    words = text.lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def hashes(found: set[bytes]) -> np.ndarray:
    """Rising 63-bit hashes of the shingles."""
    digest = xxhash.xxh3_64_intdigest
    values = np.fromiter((digest(s, SEED) for s in found), dtype=np.uint64, count=len(found))
    return np.unique((values >> np.uint64(1)).astype(np.int64))


def similar(both: int, left: int, right: int, percent: int) -> bool:
    return 100 * both >= percent * (left + right - both)


@lru_cache(1 << 16)
def least_overlap(size: int, listed: int = LISTED, percent: int = SIMILARITY, missed: float = MISSED) -> int:
    """Offered hashes that a set of ``size`` shares with any set that it is linked with.

    Without loss if both sets are offered whole. Else the ``listed`` smallest hashes of the union, whose size
    is at most ``size`` over the similarity, are a draw without replacement; the answer is the most that
    falls short with a chance of at most ``missed``.
    """
    whole = -(-percent * size // 100)
    if size * 100 <= percent * listed:
        return whole
    union = min(size * 100 // percent, 1 << 20)
    shared = -(-percent * union // 100)
    drawn = min(listed, union)

    def ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    below, count = 0.0, max(0, drawn - (union - shared))
    while count < min(drawn, shared):
        below += math.exp(ways(shared, count) + ways(union - shared, drawn - count) - ways(union, drawn))
        if below > missed:
            break
        count += 1
    return max(1, min(count, whole))


def undecided(both: np.ndarray, union: np.ndarray, percent: int, missed: float = MISSED) -> np.ndarray:
    """Whether a linked pair can share ``both`` of the ``union`` smallest hashes (Chernoff bound)."""
    share, similarity = both / np.maximum(union, 1), percent / 100
    with np.errstate(divide="ignore", invalid="ignore"):
        held = np.where(share > 0, share * np.log(share / similarity), 0.0)
        rest = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - similarity)), 0.0)
    return (share >= similarity) | (union * (held + rest) <= -math.log(missed))


def prints(docs: DataFrame, key: str, size: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """``(key, node, n, first, offered, _text_hash)``: the word sequence's digest, the set's size, how many offered
    hashes come first, and the offered hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, firsts, offered = [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                values = hashes(shingles(text, size))
                nodes.append(hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest())
                sizes.append(len(values))
                offered.append(values[:LISTED].tolist())
                least = least_overlap(len(values), percent=percent) if len(values) else 1
                firsts.append(len(offered[-1]) - least + 1)
            columns = [
                batch.column(0),
                pa.array(nodes, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(firsts, pa.int32()),
                pa.array(offered, pa.list_(pa.int64())),
                batch.column(2),
            ]
            names = [key, "node", "n", "first", "offered", "_text_hash"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    of_key = docs.schema[key].dataType.simpleString()
    slim = docs.select(key, text_of().cast("binary").alias("_text"), F.xxhash64("text").alias("_text_hash"))
    return slim.mapInArrow(
        run, f"`{key}` {of_key}, node binary, n long, first int, offered array<long>, _text_hash long"
    )


def inverted_lists(classes: DataFrame) -> DataFrame:
    """``(term, row_id, n, size)``: the lists of two rows or more that linked classes must meet in."""
    postings = classes.select("node", F.explode("offered").alias("term"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = postings.join(frequency, "term").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("rows", "term"))).alias("shared")  # ``LISTED`` entries at most
    )
    # Hashes of one document only come before all others, and make no list.
    alone = F.size("offered") - F.size("shared")
    chosen = shared.join(classes.select("node", "n", "first", "offered"), "node").where(F.col("first") > alone)
    terms = chosen.select("node", "n", F.explode(F.slice("shared", F.lit(1), F.col("first") - alone)).alias("_t"))
    return with_bucket_size(terms.select(F.col("_t.term").alias("term"), F.col("node").alias("row_id"), "n"))


def sketches(docs: DataFrame, key: str, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(node, n, sketch, text)`` of the classes ``wanted(node, key, _text_hash)``, read from their texts again."""
    slim = docs.select(F.col(key).alias("_key"), F.xxhash64("text").alias("_hash"), "text")
    same = F.col("_key").eqNullSafe(F.col("_wanted")) & (F.col("_hash") == F.col("_text_hash"))
    met = slim.join(wanted.withColumnRenamed(key, "_wanted"), same).select("node", "text")
    one = met.groupBy("node").agg(F.first("text").alias("text")).select("node", text_of().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashes(shingles(t.as_py(), size)) for t in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s[:SKETCH].tolist() for s in sets], pa.list_(pa.int64())),
                batch.column(1),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "sketch", "text"])

    return one.mapInArrow(run, "node binary, n long, sketch array<long>, text binary")


def union_sample(left: np.ndarray, right: np.ndarray, both: int) -> int:
    """Size of the union below the hash up to which both sketches are complete."""
    ends = [s[-1] if len(s) == SKETCH else np.iinfo(np.int64).max for s in (left, right)]
    within = [int(np.searchsorted(s, min(ends), side="right")) for s in (left, right)]
    return sum(within) - both


def _two_sided(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    side = lambda end, mark: rows.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{mark}") for c in columns))
    return pairs.select("i", "j").join(side("i", "i"), "i").join(side("j", "j"), "j")


def estimated(pairs: DataFrame, rows: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """``(i, j, sure)``: the pairs that are linked, or that the union of their sketches leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("n_i", "n_j")]
            sides = [batch.column(c) for c in ("sketch_i", "sketch_j")]
            sure, keep = [], []
            for row in range(batch.num_rows):
                left, right = (s[row].values.to_numpy() for s in sides)
                both = len(np.intersect1d(left, right, assume_unique=True))
                whole = len(left) == n[0][row] and len(right) == n[1][row]
                if whole:
                    linked = similar(both, len(left), len(right), percent)
                else:
                    union = union_sample(left, right, both)
                    linked = bool(undecided(np.array(both), np.array(union), percent))
                if linked:
                    keep.append(row)
                    sure.append(whole)
            kept = batch.take(pa.array(keep, pa.int64()))
            columns = [kept.column("i"), kept.column("j"), pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "sure"])

    met = _two_sided(pairs, rows, ["n", "sketch"])
    # The smaller set over the larger one bounds the similarity.
    sized = 100 * F.least("n_i", "n_j") >= percent * F.greatest("n_i", "n_j")
    return met.where(sized).mapInArrow(run, "i binary, j binary, sure boolean")


def verified(pairs: DataFrame, rows: DataFrame, size: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """The pairs ``(i, j)`` whose full sets of shingles are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                left, right = (shingles(batch.column(c)[row].as_py(), size) for c in ("text_i", "text_j"))
                keep.append(similar(len(left & right), len(left), len(right), percent))
            mask = pa.array(keep, pa.bool_())
            ends = [batch.column(c).filter(mask) for c in ("i", "j")]
            yield pa.RecordBatch.from_arrays(ends, names=["i", "j"])

    return _two_sided(pairs, rows, ["text"]).mapInArrow(run, "i binary, j binary")


def confirmed(found: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The links among ``found(i, j, sure)``: the sure ones, and the others after verification."""
    sure = found.where("sure").select("i", "j")
    return sure.unionByName(verified(found.where("NOT sure"), rows, size, percent))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shared hashes and union samples of all pairs of two lists of sketches, without a Python loop over pairs."""
    values, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    often = np.bincount(code) > 1
    column = np.cumsum(often) - 1
    use = often[code]
    code, owner = column[code[use]], owner[use]
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    for start in range(0, int(often.sum()), COLUMNS):
        here = (code >= start) & (code < start + COLUMNS)
        held = np.zeros((len(left) + len(right), COLUMNS), dtype=np.float32)
        held[owner[here], code[here] - start] = 1.0
        both += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    last = lambda s: s[-1] if len(s) == SKETCH else np.iinfo(np.int64).max
    ends = [np.array([last(s) for s in side]) for side in (left, right)]
    within = np.minimum(ends[0][:, None], ends[1][None, :])
    union = -both
    for k, sketch in enumerate(left):
        union[k] += np.searchsorted(sketch, within[k], side="right")
    for k, sketch in enumerate(right):
        union[:, k] += np.searchsorted(sketch, within[:, k], side="right")
    return both, union


def cell_links(
    nodes: list[bytes], labels: list[bytes], sizes: np.ndarray, sketch: list[np.ndarray], side: np.ndarray, percent: int
) -> list[tuple[bytes, bytes, bool]]:
    """Of the rows on different sides (on any, if side is -1) that have different labels: a spanning forest of the
    sure links, and the open pairs that it leaves apart."""
    alike = side[0] < 0
    a = np.arange(len(nodes)) if alike else np.flatnonzero(side == side.min())
    b = np.arange(len(nodes)) if alike else np.flatnonzero(side != side.min())
    if not len(a) or not len(b):
        return []
    both, union = overlaps([sketch[k] for k in a], [sketch[k] for k in b])
    names, label = np.unique(np.array(labels, dtype=object), return_inverse=True)
    near = 100 * np.minimum.outer(sizes[a], sizes[b]) >= percent * np.maximum.outer(sizes[a], sizes[b])
    near &= label[a][:, None] != label[b][None, :]
    if alike:
        near &= np.triu(np.ones(near.shape, dtype=bool), 1)
    lengths = np.array([len(s) for s in sketch])
    whole = lengths == sizes
    certain = whole[a][:, None] & whole[b][None, :]
    exact = near & certain & (100 * both >= percent * union)
    left, right = np.nonzero(exact)
    left, right = a[left], b[right]
    # Rows of one label are connected already, and a label is a node: the forest joins labels.
    root = smallest_reachable(np.arange(len(names)), label[left], label[right])
    found = [(names[k], names[root[k]], True) for k in np.flatnonzero(root != np.arange(len(names)))]
    open_ = near & ~certain & undecided(both, union, percent)
    left, right = np.nonzero(open_)
    left, right = a[left], b[right]
    apart = root[label[left]] != root[label[right]]
    return found + [(nodes[p], nodes[q], False) for p, q in zip(left[apart], right[apart], strict=True)]


def long_list_links(lists: DataFrame, rows: DataFrame, percent: int = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """``(i, j, sure)`` from lists ``(term, row_id, label, size)``, met in chunks inside tasks."""
    parts = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int")
    ends = F.col("term"), F.least("_own", "_other"), F.greatest("_own", "_other")
    cells = (
        lists.withColumn("_parts", parts)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select(
            F.concat_ws("-", *(c.cast("string") for c in ends)).alias("cell"),
            F.when(F.col("_other") == F.col("_own"), -1).otherwise(F.col("_own")).alias("side"),
            F.col("row_id").alias("node"),
            "label",
        )
    )
    full = cells.join(rows.select("node", "n", "sketch"), "node").select("cell", "side", "node", "label", "n", "sketch")

    def closed(table: pa.Table) -> list[tuple[bytes, bytes, bool]]:
        values = table.column("sketch").combine_chunks()
        ends = values.offsets.to_numpy()
        flat = values.values.to_numpy()
        return cell_links(
            table.column("node").to_pylist(),
            table.column("label").to_pylist(),
            table.column("n").to_numpy(),
            [flat[p:q] for p, q in zip(ends, ends[1:], strict=False)],
            table.column("side").to_numpy(),
            percent,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[bytes, bytes, bool]]) -> pa.RecordBatch:
            kinds = [("i", pa.binary()), ("j", pa.binary()), ("sure", pa.bool_())]
            columns = [pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in kinds])

        held, cell = [], None
        for batch in batches:
            names = batch.column("cell").to_pylist()
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                if held and names[start] != cell:
                    yield out(closed(pa.Table.from_batches(held)))
                    held = []
                cell = names[start]
                held.append(batch.slice(start, stop - start))
        if held:
            yield out(closed(pa.Table.from_batches(held)))

    ordered = full.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "i binary, j binary, sure boolean")


def links(
    lists: DataFrame,
    rows: DataFrame,
    size: int = SHINGLE,
    percent: int = SIMILARITY,
    list_rows: int = LIST_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """``(i, j)``: links that connect all classes that are linked, directly or over others."""

    def checked(found: DataFrame, label: str) -> DataFrame:
        return materialize(confirmed(materialize(found, label), rows, size, percent), "links")

    leaders = lists.groupBy("term").agg(F.min("row_id").alias("i"))
    spokes = lists.join(leaders, "term").where(F.col("row_id") > F.col("i"))
    first = checked(estimated(spokes.select("i", F.col("row_id").alias("j")).distinct(), rows, percent), "spokes")

    labels = connected_components(first).select(F.col("node").alias("row_id"), F.col("component").alias("label"))
    placed = lists.join(labels, "row_id", "left").withColumn("label", F.coalesce("label", "row_id"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("term").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    open_ = placed.join(mixed.where("_low != _high").select("term"), "term", "left_semi")

    near: Column = (F.col("a.label") != F.col("b.label")) & (
        100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    )
    short = bucket_pairs(open_.where(F.col("size") <= list_rows), condition=near)
    of_short = checked(estimated(short, rows, percent), "short")
    of_long = checked(long_list_links(open_.where(F.col("size") > list_rows), rows, percent, chunk).distinct(), "long")
    return first.unionByName(of_short).unionByName(of_long)


def components(
    docs: DataFrame,
    key: str = "doc_id",
    size: int = SHINGLE,
    percent: int = SIMILARITY,
    list_rows: int = LIST_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``: the smallest id reachable over links, and whether it is the row's."""
    seen = materialize(prints(docs, key, size, percent), "prints")
    some = seen.where("n > 0")
    classes = some.groupBy("node").agg(
        F.min(key).alias("_lowest"),
        F.min(F.struct("_text_hash", key)).alias("_source"),
        F.first("n").alias("n"),
        F.first("first").alias("first"),
        F.first("offered").alias("offered"),
    )
    classes = materialize(classes, "classes")
    lists = materialize(inverted_lists(classes), "lists")
    listed = lists.select(F.col("row_id").alias("node")).distinct()
    wanted = classes.join(listed, "node", "left_semi").select("node", f"_source.{key}", "_source._text_hash")
    rows = materialize(sketches(docs, key, wanted, size), "sketches")
    joined = connected_components(links(lists, rows, size, percent, list_rows, chunk))
    named = classes.select("node", "_lowest").join(joined, "node", "left")
    named = materialize(named.select("node", "_lowest", F.coalesce("component", "node").alias("_label")), "named")
    lowest = named.groupBy("_label").agg(F.min("_lowest").alias("component_id"))
    of_class = materialize(named.join(lowest, "_label").select("node", "component_id"), "labels")
    own = F.col(key).alias(key)
    wordless = seen.where("n = 0").select(own, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    linked = some.join(of_class, "node").select(own, F.col("n").alias("n_shingles"), "component_id")
    kept = F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(wordless).withColumn("kept", kept)
