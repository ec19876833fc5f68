"""Quality rules with adaptive thresholds from mergeable quantile sketches, in native SQL functions.

Each document is measured by five rates. For every language and source, and for every language as a
whole, a sketch of each rate is kept: counts of rows by logarithmic bucket with 32 steps a doubling.
Buckets are fixed, so sketches merge by adding counts, in any order and with the same result. The
threshold of a group is a fence above the upper quartile of its sketch, pooled with its language's
sketch at the weight of ``PRIOR`` documents so that a group of few rows does not judge itself alone.

Nulls and edges: a null text has no words and fails the base rule; null languages and sources are
groups of their own; repeated rows are judged alike; very long texts are measured whole; an empty table
gives an empty result. Where an input column is named like a result column, the result replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import SPACE, materialize, text_of

NOT_SPACE = r"[^\x20\x09-\x0D]"
GRAM = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"

#: Documents' worth of its language's sketch that each group's sketch is pooled with.
PRIOR = 50
#: Interquartile ranges between the upper quartile and the fence.
SPREAD = 4.0
#: Rates (larger is worse) and the least distance of the fence from the upper quartile: per mille, but
#: for the mean word length, which is in hundredths of a character.
SLACK = {
    "symbol_rate": 200,
    "dup_line_rate": 300,
    "repeat_rate": 160,
    "word_length": 400,
    "upper_rate": 300,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _fifths(hashes: Column) -> Column:
    """A 64-bit hash of the window of five words that begins at each word, from the words' own hashes.

    The last four windows are cut short by the end of the text, so they differ from all others.
    """
    ahead = lambda at, k: F.get(hashes, at + k)
    return F.transform(
        hashes, lambda word, at: F.xxhash64(word, *(ahead(at, k) for k in range(1, GRAM)))
    )


def _repeated_starts(ordered: Column) -> Column:
    """Starts, ascending, of the windows that have an equal; ``ordered`` is sorted by hash."""

    def has_equal(entry: Column, at: Column) -> Column:
        same = lambda other: F.coalesce(other["h"] == entry["h"], F.lit(False))
        return same(F.get(ordered, at - 1)) | same(F.get(ordered, at + 1))

    return F.sort_array(F.transform(F.filter(ordered, has_equal), lambda entry: entry["i"]))


def _covered(starts: Column) -> Column:
    """Words covered by windows of five that begin at ``starts``."""
    reach = F.transform(
        starts,
        lambda start, at: F.least(F.lit(GRAM), F.get(starts, at + 1) - start),
    )
    return F.coalesce(F.aggregate(reach, F.lit(0), lambda total, x: total + x), F.lit(0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts in ``COUNTS``, ``n_lines``, ``n_upper`` and ``base_failed``.

    Everything is computed within the row: no shuffle, no Python.
    """
    added = [*COUNTS, "n_lines", "n_upper", "base_failed"]
    own = [F.col(c) for c in docs.columns if c not in added]
    body = F.col("_body")
    step = docs.select(*own, text_of(text).alias("_body"))
    step = step.withColumns(
        {
            "_words": F.array_remove(F.split(body, SPACE), ""),
            "_lines": F.filter(F.split(body, "\n"), lambda line: F.rlike(line, F.lit(NOT_SPACE))),
            "n_symbols": F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_upper": (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long"),
        }
    ).drop("_body")
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda word: F.xxhash64(word)),
        }
    ).drop("_words", "_lines")
    step = step.withColumn("_grams", _fifths(F.col("_hashes"))).drop("_hashes")
    step = step.withColumn("_twice", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    step = step.withColumn(
        "_ordered",
        F.when(
            F.col("_twice"),
            F.sort_array(
                F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ),
    ).drop("_grams", "_twice")
    step = step.withColumn("_starts", _repeated_starts(F.col("_ordered"))).drop("_ordered")
    step = step.withColumn("n_repeat_words", _covered(F.col("_starts")).cast("long")).drop("_starts")
    return step.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def _rates() -> dict[str, Column]:
    """The measured rates as whole numbers, 0 where there is nothing to divide by."""

    def ratio(scale: int, over: str, under: str) -> Column:
        share = F.floor(scale * F.col(over) / F.greatest(F.col(under), F.lit(1)))
        return share.cast("long")

    return {
        "symbol_rate": ratio(1000, "n_symbols", "n_words"),
        "dup_line_rate": ratio(1000, "n_dup_lines", "n_lines"),
        "repeat_rate": ratio(1000, "n_repeat_words", "n_words"),
        "word_length": ratio(100, "word_chars", "n_words"),
        "upper_rate": ratio(1000, "n_upper", "word_chars"),
    }


def sketched(measures: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, rate, edge, n)``: rows of each bucket, told by the bucket's greatest value."""
    rates = F.explode(
        F.array(*(F.struct(F.lit(k).alias("rate"), v.alias("value")) for k, v in _rates().items()))
    )
    low = "greatest(0, length(bin(value)) - 6)"
    edge = F.expr(f"shiftleft(shiftright(value, {low}) + 1, {low}) - 1")
    return (
        measures.where(F.col("n_words") > 0)
        .select(*keys, rates.alias("_r"))
        .select(*keys, "_r.*")
        .groupBy(*keys, "rate", edge.alias("edge"))
        .agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, by adding counts."""
    return sketches.groupBy(*keys, "rate", "edge").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, <rate>...)``: the largest accepted value of each rate."""
    whole = merged(sketches, [lang])
    rising = Window.partitionBy(lang, "rate").orderBy("edge")
    whole = whole.select(
        F.col(lang).alias("_lang"),
        F.col("rate").alias("_rate"),
        F.col("edge").alias("_edge"),
        F.sum("n").over(rising).alias("_lang_below"),
        F.sum("n").over(Window.partitionBy(lang, "rate")).alias("_lang_n"),
    )
    groups = sketches.groupBy(lang, source, "rate").agg(F.sum("n").alias("_group_n"))
    own = sketches.select(
        F.col(lang).alias("_l"),
        F.col(source).alias("_s"),
        F.col("rate").alias("_r"),
        F.col("edge").alias("_e"),
        "n",
    )
    grid = groups.join(
        whole, F.col(lang).eqNullSafe(F.col("_lang")) & (F.col("rate") == F.col("_rate"))
    )
    grid = grid.join(
        own,
        F.col(lang).eqNullSafe(F.col("_l"))
        & F.col(source).eqNullSafe(F.col("_s"))
        & (F.col("rate") == F.col("_r"))
        & (F.col("_edge") == F.col("_e")),
        "left",
    ).select(lang, source, "rate", "_edge", "_lang_below", "_lang_n", "_group_n", "n")
    up = Window.partitionBy(lang, source, "rate").orderBy("_edge")
    below = F.sum(F.coalesce("n", F.lit(0))).over(up)
    pooled = grid.withColumn(
        "_share",
        (below + F.lit(float(PRIOR)) * F.col("_lang_below") / F.col("_lang_n"))
        / (F.col("_group_n") + F.lit(PRIOR)),
    )
    at = lambda q: F.min(F.when(F.col("_share") >= q - 1e-9, F.col("_edge")))
    slack = F.create_map(*(x for k, v in SLACK.items() for x in (F.lit(k), F.lit(v))))
    quartiles = pooled.groupBy(lang, source, "rate").agg(at(0.25).alias("low"), at(0.75).alias("high"))
    limit = F.col("high") + F.greatest(
        SPREAD * (F.col("high") - F.col("low")), slack[F.col("rate")].cast("double")
    )
    return quartiles.groupBy(lang, source).agg(
        *(F.max(F.when(F.col("rate") == k, limit)).alias(k) for k in SLACK)
    )


def judged(measures: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measures`` with ``kept``: past the base rules and within every fence of its group.

    ``measures`` should be a written table, since it is read for the sketches and again for the join.
    The fences are one row a language and source; they are written, so the join knows their size.
    """
    limits = materialize(fences(sketched(measures, [lang, source]), lang, source), "fences")
    limits = limits.select(
        F.col(lang).alias("_lang"), F.col(source).alias("_source"), *(F.col(k).alias(f"_{k}") for k in SLACK)
    )
    within = F.lit(True)
    for name, value in _rates().items():
        within = within & (value <= F.col(f"_{name}"))
    joined = measures.drop("kept").join(
        limits,
        F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")),
        "left",
    )
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(False))
    return joined.withColumn("kept", kept).drop("_lang", "_source", *(f"_{k}" for k in SLACK))


def verdicts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, *COUNTS, base_failed, kept)`` of every document."""
    slim = measured(docs.select(key, "text", "lang", "source")).drop("text")
    return judged(materialize(slim, "measures")).select(key, *COUNTS, "base_failed", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    whole = docs.select(F.struct("*").alias("_doc"), "text", "lang", "source")
    measures = materialize(measured(whole).drop("text"), "measured")
    return judged(measures).where("kept").select("_doc.*")
