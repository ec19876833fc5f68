"""Cross-tokenizer alignment at whitespace-token anchors.

Every text is tokenized whole by two vocabularies. Where a token of either side ends at the same byte, the
texts before it are the same on both sides; such shared ends cut the tokens into groups, and all token
pairs of a group are linked. Anchors are shared ends after which both sides go on with a token that begins with a space,
verified by the byte offsets. They cut a document into short windows of token ids. How the tokens of a window fall into groups
depends on its ids alone, so each task aligns a window once and remembers it by its two id tuples.

For each linked id pair the corpus-wide number of documents that hold it linked is counted: tasks write
each document's distinct pairs, Spark counts them with map-side sums, and the counts go back to
the tasks in slices of about ``SLICE`` pairs, one pass over the written pairs for each slice. So what is sent to
a task is bounded, however many pairs the corpus has.

Nulls and edges: a text that is null or empty, or whose joined tokens differ from it on either side (a
vocabulary that normalises it), has no tokens: zeros and an empty group string. Very long texts are
aligned whole; windows above ``WINDOW`` tokens are aligned but not remembered. Repeated rows count as
documents each; null ids are allowed; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, text_of
from kinfold.sources.worktable import discard

BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: Largest window, in tokens of both sides, and number of windows and groups that a task remembers.
WINDOW = 64
KNOWN_WINDOWS = 400_000
#: About how many id pairs with their counts are sent to the tasks at once.
SLICE = 1_000_000
#: Added to the ids of the right side in a window's key, which no id of the left side reaches.
RIGHT = 1 << 30
#: Links of a group that are listed one by one.
MANY = 4096
SPACE_MARK = "▁"
Pairs = tuple[np.ndarray, np.ndarray]


class ByteSide:
    """Byte-level vocabulary, given as its ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(" " + text, disallowed_special=())


class PieceSide:
    """Sentence pieces with byte fallback; the model puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.tokens = [self.bytes_of(k) for k in range(self.model.get_piece_size())]

    def bytes_of(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        if self.model.is_byte(number):  # written as <0xHH>
            return bytes([int(piece[3:-1], 16)])
        return piece.replace(SPACE_MARK, " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), dtype=np.uint32)


def side_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Length of every token, and whether it begins with a space."""
    return np.array([len(t) for t in tokens]), np.array([t[:1] == b" " for t in tokens])


class Group(NamedTuple):
    """Tokens of both sides between two shared ends: their ids as text, and the linked pairs.

    ``keys`` has one 64-bit number a link; a group of more than ``MANY`` links has them in ``large``, as distinct
    pairs with multiplicities.
    """

    text: str
    keys: bytes
    large: list[Pairs]


#: The alignment of a window: its groups in order.
Window = list[Group]


def merged(keys: np.ndarray, times: np.ndarray) -> Pairs:
    """Distinct keys with summed multiplicities."""
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, at, times)
    return distinct, total


def linked(left: list[int], right: list[int], width: int) -> Pairs:
    """The distinct id pairs of a group, as ``left * width + right``, with multiplicities."""
    a, b = (np.unique(np.array(ids, dtype=np.int64), return_counts=True) for ids in (left, right))
    return np.add.outer(a[0] * width, b[0]).ravel(), np.multiply.outer(a[1], b[1]).ravel()


def aligned_group(left: list[int], right: list[int], width: int) -> Group:
    text = ",".join(map(str, left)) + "|" + ",".join(map(str, right))
    if len(left) * len(right) > MANY:
        return Group(text, b"", [linked(left, right, width)])
    keys = [x * width + y for x in left for y in right]
    return Group(text, struct.pack(f"{len(keys)}q", *keys), [])


def side_by_side(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> list[bytes]:
    """The id tuples of stretches of both sides: the ids of ``a``, then those of ``b`` with ``RIGHT`` added."""
    ids = np.empty(len(a) + len(b), dtype=np.uint32)
    ids[np.arange(len(a)) + np.repeat(from_b[:-1], np.diff(from_a))] = a
    ids[np.arange(len(b)) + np.repeat(from_a[1:], np.diff(from_b))] = b + RIGHT
    edges = (4 * (from_a + from_b)).tolist()
    return list(map(ids.tobytes().__getitem__, map(slice, edges, edges[1:])))


class Aligner:
    """Aligns texts, remembering windows; one a worker process."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.of_a, self.of_b = side_table(self.a.tokens), side_table(self.b.tokens)
        #: Windows, and the groups that new windows are made of, by the id tuples of both sides.
        self.known: dict[bytes, Window] = {}
        self.groups: dict[bytes, Group] = {}

    def encoded(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or none if either does not spell the text with a space before it."""
        if not text:
            return None
        whole = b" " + text.encode()
        a, b = self.a.encode(text), self.b.encode(text)
        # Bytes have a token each and are never changed, so on that side the length tells.
        if self.of_a[0][a].sum() != len(whole) or b"".join(map(self.b.tokens.__getitem__, b.tolist())) != whole:
            return None
        return a, b

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[int, list[Window]]:
        """The number of groups, and the windows between anchors: shared ends that both sides follow by a token
        with a space in front."""
        ends_a, ends_b = self.of_a[0][a].cumsum(), self.of_b[0][b].cumsum()
        at_a = np.searchsorted(ends_a, ends_b)
        at_b = np.flatnonzero(ends_a[at_a] == ends_b)
        at_a = at_a[at_b]
        # The last shared end is the end of the text; a window ends there whatever follows.
        marked = self.of_a[1][a[at_a[:-1] + 1]] & self.of_b[1][b[at_b[:-1] + 1]]
        cut = np.append(np.flatnonzero(marked), len(at_a) - 1) + 1
        of_a, of_b = np.append(0, at_a + 1), np.append(0, at_b + 1)
        from_a, from_b = np.append(0, of_a[cut]), np.append(0, of_b[cut])
        spelled = side_by_side(a, b, from_a, from_b)
        found = list(map(self.known.get, spelled))
        if None in found:
            groups, last = side_by_side(a, b, of_a, of_b), [0, *cut.tolist()]
            parts = list(map(self.groups.get, groups))
            if None in parts:
                parts = [part or self.group(ids) for part, ids in zip(parts, groups, strict=True)]
            for k, window in enumerate(found):
                if window is None:
                    found[k] = parts[last[k] : last[k + 1]]
                    if len(spelled[k]) <= 4 * WINDOW:
                        self.known[spelled[k]] = found[k]
            if len(self.known) + len(self.groups) > KNOWN_WINDOWS:
                self.known.clear()
                self.groups.clear()
        return len(at_a), found

    def group(self, ids: bytes) -> Group:
        found = self.groups.get(ids)
        if found is None:
            both = np.frombuffer(ids, dtype=np.uint32)
            left, right = both[both < RIGHT], both[both >= RIGHT] - RIGHT
            found = aligned_group(left.tolist(), right.tolist(), len(self.b.tokens))
            if len(ids) <= 4 * WINDOW:
                self.groups[ids] = found
        return found

    def document(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens a side, groups, links, the groups' digest, and distinct pairs with multiplicities."""
        sides = self.encoded(text)
        if sides is None:
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        n_groups, windows = self.windows(*sides)
        groups = list(chain.from_iterable(windows))
        flat = np.frombuffer(b"".join([g[1] for g in groups]), dtype=np.int64)
        keys, times = np.unique(flat, return_counts=True)
        if large := [pairs for g in groups if g[2] for pairs in g[2]]:
            keys, times = merged(*(np.concatenate(x) for x in zip((keys, times), *large, strict=True)))
        digest = hashlib.sha256(";".join([g[0] for g in groups]).encode()).hexdigest()
        return len(sides[0]), len(sides[1]), n_groups, int(times.sum()), digest, keys, times


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process, kept on a library module, since functions that travel by value
    have fresh globals."""
    import sentencepiece

    loaded = sentencepiece.__dict__.setdefault("_aligners", {})
    if (a_path, b_path) not in loaded:
        loaded[a_path, b_path] = Aligner(a_path, b_path)
    return loaded[a_path, b_path]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, key: str = "doc_id", a: str | None = None, b: str | None = None) -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)`` of every row.

    ``pairs`` holds the document's distinct linked id pairs, as ``a * pieces of b + b`` in rising order, and
    ``times`` how often each is linked. ``a`` is a rank file, ``b`` a sentence-piece model.
    """
    paths = a or public_tokenizers.path(BYTE_RANKS), b or public_tokenizers.path(PIECES)
    schema = pa.schema(
        [(c, pa.int64()) for c in COUNTS]
        + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
    )

    def listed(parts: list[np.ndarray]) -> pa.ListArray:
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        # Remembered windows are many objects without cycles, which searches for cycles would walk again and again.
        gc.disable()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = list(zip(*(own.document(t.as_py()) for t in batch.column(1)), strict=True))
                columns = [pa.array(x, f.type) for x, f in zip(rows[:5], schema, strict=False)]
                columns += [listed(rows[5]), listed(rows[6])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *schema.names])
        gc.enable()

    counted = ", ".join(f"{c} long" for c in COUNTS)
    of_key = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_of().alias("_text")).mapInArrow(
        run, f"`{key}` {of_key}, {counted}, groups_sha256 string, pairs array<long>, times array<long>"
    )


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``(pair, a, b, n, best)``: documents that hold an id pair linked, and whether that is the most of
    its left id's pairs (ties included). ``width`` is the number of the right side's ids."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    width_ = F.lit(width)
    counts = counts.select(
        "pair", F.floor(F.col("pair") / width_).alias("a"), F.pmod("pair", width_).alias("b"), "n"
    )
    counts = materialize(counts, "pair_counts")
    most = counts.groupBy("a").agg(F.max("n").alias("_most"))
    return counts.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def pieces_of(path: str | None = None) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES)).get_piece_size()


def weighed(rows: DataFrame, counts: DataFrame, size: int = SLICE) -> DataFrame:
    """``rows`` with ``n_best``, the links whose pair is a best one of its left id, and ``count_sum``, the
    pair counts summed over links. ``counts`` goes to the tasks in slices of about ``size`` pairs."""
    context = rows.sparkSession.sparkContext
    numbered = materialize(counts.select("pair", "n", "best"), "counts")
    slices = max(1, -(-numbered.count() // size))
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"n_best": zero, "count_sum": zero})
    previous = None
    for number in range(slices):
        part = numbered.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == number).orderBy("pair").toArrow()
        table = context.broadcast(tuple(part.column(c).to_numpy() for c in ("pair", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            pairs, n, best = table.value
            for batch in batches:
                keys, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
                of_row = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
                flat = keys.flatten().to_numpy()
                at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
                here = pairs[at] == flat if len(pairs) else np.zeros(len(flat), dtype=bool)
                of_row, at, times = of_row[here], at[here], times[here]
                for name, worth in (("n_best", times * best[at]), ("count_sum", times * n[at])):
                    total = batch.column(name).to_numpy().copy()
                    np.add.at(total, of_row, worth)
                    place = batch.schema.get_field_index(name)
                    batch = batch.set_column(place, name, pa.array(total, pa.int64()))
                yield batch

        rows = rows.mapInArrow(run, rows.schema)
        if number + 1 < slices:
            rows = materialize(rows, "weighed")
            if previous is not None:
                discard(previous)
            previous = rows
    return rows


def alignments(docs: DataFrame, key: str = "doc_id", a: str | None = None, b: str | None = None) -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every document."""
    rows = materialize(aligned(docs, key, a, b), "aligned")
    found = weighed(rows, pair_counts(rows, pieces_of(b)))
    return found.select(key, *COUNTS, "n_best", "count_sum", "groups_sha256")
