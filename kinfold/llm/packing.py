"""Mixture-controlled packing of tokenized documents by deficit round-robin.

Every source is a queue of tokens. In each round a source is given a quantum, its share of
``window`` tokens, on top of the fraction that it was short of in earlier rounds (its deficit), and
gives that many whole tokens from the head of its queue. So each window holds the target proportions to
the token, whichever partition a document lies in. A document that is cut by the end of a quantum goes
on in the next round. The windows follow each other in one stream, which is cut into sequences of
``length`` tokens; only the last one is padded.

Because quanta are whole tokens of a running share, the tokens that a source has given after ``r`` rounds
are ``floor(r * window * share)``, at most its queue. A token's place in its queue therefore decides its
round, and rounds never have to be played one after the other. Queue places come from token counts by
(partition, source) and a prefix sum over partitions; stream places of rounds from a prefix sum in blocks.
The texts are tokenized once, in the tasks that read them, and written as ids; the layout (places only)
is joined to them by (partition, source), then each document is cut within its row.

Nulls and edges: a null or empty text is its end token alone; a null source is a queue of its own;
repeated rows are packed as often as they come; texts longer than a sequence span several. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, text_of

END = 2
LENGTH = 4096
#: Sequences in a window, the stretch that holds the target proportions.
WINDOW_SEQUENCES = 16
#: Distinct words that a task remembers the ids of.
KNOWN_WORDS = 250_000
PUNCTUATION = b".,!?;:"
#: Largest layout, in bytes, that is sent to all tasks instead of being joined by a shuffle.
BROADCAST_BYTES = 32 << 20
BLOCK = 4096


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class KnownWords(dict):
    """Ids of each word, found when first asked for, as little-endian unsigned 32-bit bytes.

    A word's ids are those of its letters and then of its trailing punctuation. Words of European letters
    only are one piece, which the model takes without the steps before it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.letters = self.tokenizer.model.tokenize, byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters, which stand for themselves
            ids = packed_ids([piece.id for piece in self.pieces(word.lower().decode())])
        else:
            core = word.rstrip(PUNCTUATION)
            if len(core) < len(word) and core[-1:].isalpha() and b"<|" not in word:
                ids = self[core] + self[word[len(core) :]]
            else:
                ids = self.other(word.decode("utf-8", "replace"))
        self[word] = ids
        return ids

    def other(self, text: str) -> bytes:
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            spelled = text.lower().encode().decode("latin-1").translate(self.letters)
            return packed_ids([piece.id for piece in self.pieces(spelled)])
        return packed_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)


class WordTokenizer:
    """Ids of UTF-8 texts.

    This vocabulary lower-cases, drops white space and never joins across it, nor a letter with the
    punctuation after it. So a text's ids are those of its words in turn, and these are remembered, since
    most words are frequent ones.
    """

    def __init__(self, path: str):
        self.known = KnownWords(path)

    def ids(self, text: bytes) -> bytes:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        # Special tokens are told by case, so texts that may hold one keep theirs.
        words = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.known.__getitem__, words))


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker process, loaded once and kept with the words it knows.

    It is kept on the library's module, because functions that travel by value have fresh globals.
    """
    import tokenizers

    loaded = tokenizers.__dict__.setdefault("_word_tokenizers", {})
    if path not in loaded:
        loaded[path] = WordTokenizer(path)
    return loaded[path]


def tokenized(docs: DataFrame, key: str, path: str, end: int = END) -> DataFrame:
    """``(part, key, source, before, n, ids)``: ids with the end token, and the tokens of the same
    source before the document in its partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, given = word_tokenizer(path).ids, TaskContext.get().partitionId(), {}
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = [ids_of(t.as_py()) + last for t in piece.column(2)]
                sizes, before = [len(i) // 4 for i in ids], []
                for source, n in zip(piece.column(1).to_pylist(), sizes, strict=True):
                    before.append(given.get(source, 0))
                    given[source] = before[-1] + n
                columns = [
                    pa.array([part] * len(ids), pa.int32()), piece.column(0), piece.column(1),
                    pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                ]
                names = ["part", key, "source", "before", "n", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    slim = docs.select(key, F.col("source").cast("string").alias("source"), text_of().cast("binary").alias("_text"))
    of_key = docs.schema[key].dataType.simpleString()
    schema = f"part int, `{key}` {of_key}, source string, before long, n long, ids binary"
    return slim.mapInArrow(run, schema)


def _shares(totals: DataFrame, weights: Mapping[str | None, float] | None) -> DataFrame:
    """Add ``share``, each source's part of a window: by tokens, or by the given weights."""
    whole = Window.partitionBy(F.lit(0))
    if weights is None:
        weight = F.col("tokens").cast("double")
    else:
        chosen = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()]
        weight = F.coalesce(*chosen, F.lit(1.0))
    return totals.withColumn("share", weight / F.sum(weight).over(whole))


def _given(rounds: Column, window: int) -> Column:
    """Tokens that a source has given before round ``rounds``."""
    return F.least(F.floor(rounds * F.lit(float(window)) * F.col("share")).cast("long"), F.col("tokens"))


def layout(spans: DataFrame, window: int, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """``(part, source, round, first, last, stream)``: stretches of a partition's queue that lie in one
    round, from token ``first`` to ``last`` (exclusive) of the partition's part, and the stream place
    of their first token. ``spans`` has ``(part, source, n)``."""
    queue = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("_at", F.coalesce(F.sum("n").over(queue), F.lit(0)))
    totals = _shares(spans.groupBy("source").agg(F.sum("n").alias("tokens")), weights)
    totals = totals.withColumnRenamed("source", "_source")
    quantum = F.lit(float(window)) * F.col("share")
    low = F.greatest(F.floor(F.col("_at") / quantum) - 1, F.lit(0))
    high = F.floor((F.col("_at") + F.col("n")) / quantum) + 1
    begin, end = F.col("_at"), F.col("_at") + F.col("n")
    cells = (
        placed.join(totals, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("round", F.explode(F.sequence(low, high)))
        .withColumn("_from", _given(F.col("round"), window))
        .withColumn("_to", _given(F.col("round") + 1, window))
        .withColumn("_first", F.greatest("_from", begin))
        .withColumn("_last", F.least("_to", end))
        .where("_first < _last")
        .select("part", "source", "round", "_at", "_from", "_first", "_last")
    )
    cells = materialize(cells, "cells")
    turns = cells.groupBy("round", "source").agg(F.sum(F.col("_last") - F.col("_first")).alias("_n"))
    in_round = Window.partitionBy("round").orderBy(F.asc_nulls_last("source"))
    turns = turns.withColumn(
        "_turn", F.coalesce(F.sum("_n").over(in_round.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rounds = turns.groupBy("round").agg(F.sum("_n").alias("_n"))
    rounds = rounds.withColumn("_block", F.floor(F.col("round") / BLOCK))
    blocks = rounds.groupBy("_block").agg(F.sum("_n").alias("_n"))
    up = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_block",
        F.coalesce(
            F.sum("_n").over(up(Window.partitionBy(F.lit(0)).orderBy("_block"))), F.lit(0)
        ).alias("_base"),
    )
    in_block = up(Window.partitionBy("_block").orderBy("round"))
    rounds = rounds.withColumn("_in", F.coalesce(F.sum("_n").over(in_block), F.lit(0))).join(blocks, "_block")
    starts = turns.join(rounds.select("round", "_base", "_in"), "round").select(
        F.col("round").alias("_r"),
        F.col("source").alias("_s"),
        (F.col("_base") + F.col("_in") + F.col("_turn")).alias("_start"),
    )
    own = F.col("source").eqNullSafe(F.col("_s")) & (F.col("round") == F.col("_r"))
    return cells.join(starts, own).select(
        "part",
        "source",
        "round",
        (F.col("_first") - F.col("_at")).alias("first"),
        (F.col("_last") - F.col("_at")).alias("last"),
        (F.col("_start") + F.col("_first") - F.col("_from")).alias("stream"),
    )


def cut(before: int, n: int, first: np.ndarray, stream: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """``(start, size, stream place)`` of the pieces of one document.

    ``first`` and ``stream`` are the stretches of its partition's queue; a piece ends where its stretch
    or its sequence does.
    """
    pieces, at = [], 0
    cell = int(np.searchsorted(first, before, side="right")) - 1
    while at < n:
        until = int(first[cell + 1]) - before if cell + 1 < len(first) else n
        place = int(stream[cell]) + before + at - int(first[cell])
        size = min(until - at, n - at, length - place % length)
        pieces.append((at, size, place))
        at += size
        if at == until:
            cell += 1
    return pieces


def packed(
    docs: DataFrame,
    key: str = "doc_id",
    path: str | None = None,
    length: int = LENGTH,
    window_sequences: int = WINDOW_SEQUENCES,
    weights: Mapping[str | None, float] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents: ``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    ``path`` names the vocabulary file (by default the public word vocabulary). ``weights`` gives the
    proportions of the windows by source, 1 for a source that it doesn't name; without it they follow the
    sources' tokens, so that all queues end together. ``with_ids`` adds the ids of each piece.
    """
    vocabulary = path or public_tokenizers.path("word_bpe_49k.json")
    tokens = materialize(tokenized(docs, key, vocabulary), "tokens")
    spans = materialize(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "spans")
    stretches = materialize(layout(spans, length * window_sequences, weights), "layout")
    lists = stretches.groupBy("part", "source").agg(
        F.array_sort(F.collect_list(F.struct("first", "stream"))).alias("_cells")
    )
    lists = lists.select(F.col("part").alias("_p"), F.col("source").alias("_s"), "_cells")
    if stretches.count() * 24 <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
    own = (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))
    ready = tokens.join(lists, own).select(
        key, "before", "n", "ids", F.col("_cells.first").alias("_first"), F.col("_cells.stream").alias("_stream")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        names += ["ids"] if with_ids else []
        for batch in batches:
            row, columns = [], [[] for _ in range(6 + with_ids)]
            for at in range(batch.num_rows):
                before, n, ids = (batch.column(k)[at].as_py() for k in (1, 2, 3))
                first, stream = (batch.column(k)[at].values.to_numpy() for k in (4, 5))
                view = memoryview(ids)
                for start, size, place in cut(before, n, first, stream, length):
                    own_ids = view[4 * start : 4 * (start + size)]
                    row.append(at)
                    values = [start, size, zlib.crc32(own_ids), n, place // length, place % length]
                    for column, value in zip(columns, [*values, *[bytes(own_ids)] * with_ids], strict=True):
                        column.append(value)
            arrays = [batch.column(0).take(pa.array(row, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[:6]]
            arrays += [pa.array(c, pa.binary()) for c in columns[6:]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    longs = ", ".join(f"{c} long" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {longs}" + ", ids binary" * with_ids
    return ready.mapInArrow(run, schema)
