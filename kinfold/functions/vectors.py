"""Vectors as array columns: dense cosine and sparse term-count vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.text import bind, word_bigrams


def parse_vector(text: Column) -> Column:
    """``[0.1, 0.2]`` as text to an array of doubles."""
    return F.from_json(text, "array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors in double precision; 0 when one of them is all zeros."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def term_counts(terms: Column) -> Column:
    """Struct ``(terms, counts, norm2)`` of a list of 64-bit terms with repeats.

    ``terms`` are the distinct terms in order, ``counts`` how often each occurs, ``norm2`` the squared
    length. One sort per row and no shuffle.
    """

    def encode(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        lengths = bind(
            starts,
            lambda s: F.zip_with(
                s,
                F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(size)),
                lambda start, end: end - start,
            ),
        )
        return bind(
            lengths,
            lambda n: F.struct(
                F.array_distinct(ordered).alias("terms"),
                n.alias("counts"),
                F.aggregate(
                    n, F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x.cast("long")
                ).alias("norm2"),
            ),
        )

    empty = F.struct(
        F.expr("cast(array() as array<bigint>)").alias("terms"),
        F.expr("cast(array() as array<int>)").alias("counts"),
        F.lit(0).cast("long").alias("norm2"),
    )
    return bind(
        F.sort_array(terms), lambda s: F.when(F.size(s) > 0, encode(s)).otherwise(empty)
    )


def runs(ordered: Column) -> Column:
    """Array of ``(term, k)``: the distinct values of a sorted list and how often each occurs."""

    def encode(values: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(values) - 1),
            lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1)),
        )
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(values)))
        return bind(
            starts,
            lambda s: F.zip_with(
                s,
                ends(s),
                lambda start, end: F.struct(F.get(values, start).alias("term"), (end - start).cast("long").alias("k")),
            ),
        )

    return bind(ordered, lambda v: F.when(F.size(v) > 0, encode(v)))


def bigram_vector(word_list: Column) -> Column:
    """Word-bigram count vector of a list of words, terms as 64-bit hashes."""
    pairs = F.coalesce(word_bigrams(word_list), F.array())
    return term_counts(F.transform(pairs, lambda t: F.xxhash64(t)))


def word_digest(word_list: Column) -> Column:
    """Digest of a word sequence: equal digests mean equal bigram vectors."""
    return F.sha2(F.array_join(word_list, " "), 256)


def repeated_terms(vec: Column) -> Column:
    """Map of the terms that occur more than once to their count."""
    runs = F.filter(
        F.arrays_zip(vec["terms"].alias("terms"), vec["counts"].alias("counts")),
        lambda r: r["counts"] > 1,
    )
    return F.map_from_entries(runs)


def sparse_dot(a_terms: Column, a_multi: Column, b_terms: Column, b_multi: Column) -> Column:
    """Dot product of two term-count vectors, each given by its terms and ``repeated_terms``.

    Common terms count once each; only those repeated on a side need their counts.
    """
    repeated = F.array_intersect(
        F.array_intersect(F.array_union(F.map_keys(a_multi), F.map_keys(b_multi)), a_terms), b_terms
    )
    extra = F.aggregate(
        repeated,
        F.lit(0).cast("long"),
        lambda total, t: total
        + F.coalesce(F.element_at(a_multi, t), F.lit(1)).cast("long")
        * F.coalesce(F.element_at(b_multi, t), F.lit(1)).cast("long")
        - F.lit(1).cast("long"),
    )
    none_repeated = (F.size(a_multi) == 0) & (F.size(b_multi) == 0)
    return F.size(F.array_intersect(a_terms, b_terms)).cast("long") + F.when(
        none_repeated, F.lit(0).cast("long")
    ).otherwise(extra)


def sparse_side(vec: Column) -> Column:
    """What ``sparse_cosine`` needs of a vector, worked out once per row before a pair join."""
    return F.struct(
        vec["terms"].alias("terms"),
        repeated_terms(vec).alias("multi"),
        F.sqrt(vec["norm2"].cast("double")).alias("length"),
    )


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two ``sparse_side`` structs; 0 when a vector is empty."""
    product = sparse_dot(a["terms"], a["multi"], b["terms"], b["multi"])
    length = a["length"] * b["length"]
    return F.when(length > 0, product / length).otherwise(F.lit(0.0))
