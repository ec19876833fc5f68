"""Exact similarity join of sparse term-count vectors.

Candidates come from prefix filtering (Bayardo, Ma and Srikant 2007): with terms ordered from rare to
frequent, two vectors whose cosine exceeds ``t`` share a term in both prefixes, where a prefix ends
once the rest of the vector is too short to reach ``t``. Where two vectors meet, what remains of them, in length and in
terms, bounds their cosine; the terms that they have in common in their prefixes bound it again. Any one order of the terms finds all pairs, so only
the most frequent terms are ordered by their rows; all others come before them. A row's prefix is then
found in the row, and its terms are sent once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.text import words
from kinfold.functions.vectors import bigram_vector, word_digest
from kinfold.operators.buckets import (
    CHUNK,
    bucket_pairs,
    crossing_pairs,
    leader_pairs,
    with_bucket_size,
)
from kinfold.operators.components import connected_components
from kinfold.operators.scoring import score_pairs
from kinfold.sources.worktable import discard, materialize, spread

SLACK = 1e-9
HOT_BUCKET = 5_000
#: Terms whose rows are told to every task, at most, and the rows such a term has at least.
FREQUENT_TERMS = 1 << 21
FREQUENT_ROWS = 4
#: Terms that a task orders at a time.
PIECE_TERMS = 2_000_000
#: Parts of one that shares of a cosine are rounded up to; whole numbers take less room than doubles where pairs are sent.
SHARES = 1_000_000
#: Where two terms meet and both vectors hold less than this power of the threshold from there on, the meeting is left out.
#: At 2 nothing that is left out tells of the pair, at 4 all meetings are sent.
LEFT_OUT = 2.25


def text_vectors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored ``(row_id, digest, vec)``: the word-bigram vector of each text, written once."""
    narrow = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("_text"))
    tokens = spread(narrow, "row_id").select("row_id", words(F.col("_text")).alias("_words"))
    return materialize(
        tokens.select(
            "row_id",
            word_digest(F.col("_words")).alias("digest"),
            bigram_vector(F.col("_words")).alias("vec"),
        ),
        "vectors",
    )


def representatives(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per distinct word sequence, and ``(row_id, rep)`` for every row that has a vector.

    The smallest id represents the copies; ``min`` combines map-side, so a huge set of copies never
    gathers in one task.
    """
    present = vectors.where(F.size("vec.terms") > 0)
    keys = present.select("row_id", "digest")
    reps = keys.groupBy("digest").agg(F.min("row_id").alias("rep"))
    members = materialize(keys.join(reps, "digest").select("row_id", "rep"), "members")
    copies = members.where(F.col("row_id") != F.col("rep")).select("row_id")
    return present.join(copies, "row_id", "left_anti"), members


def frequent_terms(
    vectors: DataFrame, most: int = FREQUENT_TERMS, least: int = FREQUENT_ROWS
) -> tuple[np.ndarray, np.ndarray, int]:
    """The terms that most rows have, in order, with their rows: at most ``most``. Any other term has fewer rows.

    The third is how many rows another term can have. Terms of equally many rows are all in or all out.
    """
    counted = vectors.select(F.explode("vec.terms").alias("term")).groupBy("term").agg(F.count("*").alias("rows"))
    counted = materialize(counted.where(F.col("rows") >= least), "terms")
    by_rows = counted.groupBy("rows").agg(F.count("*").alias("n"))
    more = F.sum("n").over(Window.orderBy(F.desc("rows")))  # one row for each number of rows
    inside = F.col("n") <= most
    by_rows = by_rows.select("rows", more.alias("n"))
    cut, rest = by_rows.agg(F.min(F.when(inside, F.col("rows"))), F.max(F.when(~inside, F.col("rows")))).first()
    found = counted.where(F.col("rows") >= F.lit(cut)).toArrow()
    discard(counted)
    terms, rows = (found.column(c).to_numpy().astype(np.int64) for c in ("term", "rows"))
    order = np.argsort(terms)
    return terms[order], rows[order], rest or least - 1


def prefix_postings(
    vectors: DataFrame, threshold: float, known: np.ndarray, rows_of: np.ndarray, few: int = 0
) -> DataFrame:
    """``(term, row_id, left, remain, norm2, n, common)`` for the prefix terms of each vector.

    ``left`` is what the term and everything after it still hold of the vector's squared length ``norm2``, ``remain`` the
    number of these terms, ``n`` the term's count. The ``known`` terms come last, ordered by the number of rows that have
    them, and are ``common`` if these are more than ``few``. A column ``part`` of the vectors makes equal terms of
    different parts different ones.
    """
    least = threshold * threshold - SLACK

    names = ["term", "row_id", "left", "remain", "norm2", "n", "common"]

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            held = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, held + PIECE_TERMS, side="right")))
            yield batch.slice(start, stop - start)
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch)):
            size = pa.compute.list_value_length(piece.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
            term = piece.column("terms").flatten().to_numpy(zero_copy_only=False)
            count = piece.column("counts").flatten().to_numpy(zero_copy_only=False)
            mass = count.astype(np.int64) ** 2
            if not len(term):
                continue
            row = np.repeat(np.arange(len(size)), size)
            rows = np.zeros(len(term), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, term), len(known) - 1)
                rows = np.where(known[at] == term, rows_of[at], 0)
            order = np.lexsort((term, rows, row))
            before = np.cumsum(mass[order]) - mass[order]
            last = np.cumsum(size)
            whole = np.concatenate([before, [mass.sum()]])[last]
            norm2 = piece.column("norm2").to_numpy(zero_copy_only=False)
            left = whole[row] - before
            kept = left / norm2[row] > least
            remain = (last[row] - np.arange(len(row))).astype(np.int32)
            columns = [
                pa.array(term[order][kept]),
                piece.column("row_id").take(pa.array(row[kept])),
                pa.array(left[kept]),
                pa.array(remain[kept]),
                pa.array(norm2[row][kept].astype(np.int64)),
                pa.array(count[order][kept].astype(np.int32)),
                pa.array(rows[order][kept] > few),
                *(piece.column(c).take(pa.array(row[kept])) for c in parts),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *parts])

    parts = [c for c in vectors.columns if c == "part"]
    slim = vectors.select("row_id", "vec.terms", "vec.counts", "vec.norm2", *parts)
    types = {c: vectors.schema[c].dataType.simpleString() for c in ("row_id", *parts)}
    schema = f"term long, row_id {types['row_id']}, left long, remain int, norm2 long, n int, common boolean"
    postings = slim.mapInArrow(run, ", ".join([schema, *(f"{c} {types[c]}" for c in parts)]))
    return postings.withColumn("term", F.xxhash64("term", "part")).drop("part") if parts else postings


def _split_postings(vectors: DataFrame, threshold: float, chunk: int) -> tuple[DataFrame | None, DataFrame]:
    """Prefix postings of rare terms, and stored ones of the others with the ``size`` of their bucket.

    A rare term has at most ``chunk`` rows. Where a term beside the most frequent ones can have more, none is rare.
    """
    known, rows_of, rest = frequent_terms(vectors)
    postings = prefix_postings(vectors, threshold, known, rows_of, chunk)
    if rest > chunk:
        return None, with_bucket_size(materialize(postings.drop("common"), "postings"))
    common = materialize(postings.where("common").drop("common"), "postings")
    sizes = common.groupBy("term").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    # At most FREQUENT_TERMS rows.
    return postings.where("not common").drop("common"), common.join(F.broadcast(sizes), "term")


def _prefix_pairs(
    rare: DataFrame | None, sized: DataFrame, threshold: float, chunk: int, whole: bool = True
) -> DataFrame:
    """Distinct pairs that meet in a bucket. Both sides of the rare terms' join are one exchange.

    Where the buckets are ``whole``, hold every prefix term of rows whose ids differ, all terms in which two prefixes meet
    are known, and bound the pair's cosine once more. What they do not show is a term after the end of one of the prefixes,
    beyond which that vector holds ``threshold`` at most, or a term whose meeting was left out, from which on the
    cosine is no more than ``threshold ** (LEFT_OUT / 2)``.
    """
    square = threshold * threshold - SLACK
    left_out = threshold**LEFT_OUT if whole else square
    met = _most("a", "b") * _most("b", "a")
    long = lambda side: F.col(f"{side}.n").cast("long")
    double = lambda side: F.col(f"{side}.norm2").cast("double")
    product = long("a") * long("b") / F.sqrt(double("a") * double("b"))
    after = lambda side: (F.col(f"{side}.left") - long(side) * long(side)) / double(side)
    more = [
        (met > square).alias("near"),
        F.ceil(product * SHARES).alias("common"),
        F.ceil(F.greatest(after("a"), after("b"), F.lit(0.0)) * SHARES).alias("rest"),
    ]
    more = more if whole else []
    pairs = bucket_pairs(sized, condition=met > left_out, chunk=chunk, once=False, more=more)
    if rare is not None:
        on = (F.col("a.term") == F.col("b.term")) & (F.col("a.row_id") < F.col("b.row_id")) & (met > left_out)
        both = rare.alias("a").join(rare.alias("b"), on)
        pairs = pairs.unionByName(both.select(F.col("a.row_id").alias("i"), F.col("b.row_id").alias("j"), *more))
    if not whole:
        return pairs.distinct()
    found = pairs.groupBy("i", "j").agg(
        F.max("near").alias("near"), F.sum("common").alias("common"), F.min("rest").alias("rest")
    )
    unseen = F.greatest(threshold * F.sqrt(F.col("rest") / SHARES), F.lit(math.sqrt(left_out)))
    return found.where(F.col("near") & (F.col("common") / SHARES + unseen > threshold - SLACK)).select("i", "j")


def _most(mine: str, other: str) -> Column:
    """The share of ``mine`` that can be common to ``other`` where this is their first common term.

    No more terms can be common than remain on the side with fewer, and each term beyond them counts one at least.
    """
    spare = F.greatest(F.col(f"{mine}.remain") - F.col(f"{other}.remain"), F.lit(0))
    return (F.col(f"{mine}.left") - spare) / F.col(f"{mine}.norm2")


def _in_reach(threshold: float) -> Column:
    """True where two vectors whose first common term this is can have a cosine above ``threshold``."""
    return _most("a", "b") * _most("b", "a") > threshold * threshold - SLACK


def ids_differ(vectors: DataFrame) -> bool:
    """Whether no two rows have the same id. Terms of such rows would be taken for those of one."""
    return vectors.groupBy("row_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def similar_pairs(vectors: DataFrame, threshold: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """All pairs ``(i, j, score)`` with ``i < j`` and a cosine strictly above ``threshold``.

    Where the vectors have a column ``part``, all such pairs inside a part.
    """
    postings = _split_postings(vectors, threshold, chunk)
    candidates = _prefix_pairs(*postings, threshold, chunk, ids_differ(vectors))
    return score_pairs(candidates, vectors, above=threshold)


def similar_groups(
    vectors: DataFrame,
    threshold: float = 0.8,
    hot_bucket: int = HOT_BUCKET,
    chunk: int = CHUNK,
) -> DataFrame:
    """``(group_id, member_id)``: components of the graph of pairs above ``threshold``.

    Needs far fewer pairs than ``similar_pairs``. Copies are folded into one row and join the group
    through it. Buckets above ``hot_bucket`` rows are first linked through their leader; only rows
    still in different components are then compared, which leaves the components unchanged.
    """
    distinct, members = representatives(vectors)
    rare, postings = _split_postings(distinct, threshold, min(chunk, hot_bucket))
    cold = postings.where(F.col("size") <= hot_bucket)
    hot = postings.where(F.col("size") > hot_bucket)

    def verified(candidates: DataFrame) -> DataFrame:
        return score_pairs(candidates, distinct, above=threshold).select("i", "j")

    any_hot = not hot.isEmpty()
    edges = verified(_prefix_pairs(rare, cold, threshold, chunk, not any_hot and ids_differ(distinct)))
    if any_hot:
        edges = materialize(edges.unionByName(verified(leader_pairs(hot))), "edges")
        labels = connected_components(edges).withColumnRenamed("node", "row_id")
        edges = edges.unionByName(
            verified(crossing_pairs(hot, labels, condition=_in_reach(threshold), chunk=chunk))
        )
    copies = members.where(F.col("row_id") != F.col("rep")).select(
        F.col("rep").alias("i"), F.col("row_id").alias("j")
    )
    return connected_components(edges.unionByName(copies)).select(
        F.col("component").alias("group_id"), F.col("node").alias("member_id")
    )


def minhash_postings(vectors: DataFrame, bands: int = 16, rows: int = 2) -> DataFrame:
    """``(term, row_id)``: one bucket per band of minimum hashes over the terms (Broder 1997)."""

    def lowest(seed: int):
        return F.array_min(F.transform("vec.terms", lambda t: F.xxhash64(t, F.lit(seed))))

    keys = [
        F.xxhash64(F.lit(band), *[lowest(band * rows + r) for r in range(rows)])
        for band in range(bands)
    ]
    present = vectors.where(F.size("vec.terms") > 0)
    return present.select("row_id", F.explode(F.array(*keys)).alias("term"))


def hashed_pairs(
    vectors: DataFrame, threshold: float = 0.8, bands: int = 16, rows: int = 2, chunk: int = CHUNK
) -> DataFrame:
    """Approximate ``similar_pairs``: rows sharing a MinHash band, scores exact, some pairs missed."""
    postings = materialize(minhash_postings(vectors, bands, rows), "postings")
    candidates = bucket_pairs(with_bucket_size(postings), chunk=chunk)
    return score_pairs(candidates, vectors, above=threshold)
