"""Text embedding through pluggable providers, stored embeddings, and 2-D projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, HashingTF, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.text import word_bigrams, words
from kinfold.functions.vectors import runs
from kinfold.sources.worktable import materialize, spread

BATCH = 100


class EmbeddingProvider(Protocol):
    """Adds a vector column to a table of texts."""

    name: str

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame: ...


class BatchProvider:
    """Provider around a model: ``make_encoder`` builds it once per task, and it is then called with
    at most ``batch`` texts at a time."""

    def __init__(
        self,
        name: str,
        make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
        batch: int = BATCH,
    ):
        self.name, self.make_encoder, self.batch = name, make_encoder, batch

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        make_encoder, batch = self.make_encoder, self.batch
        schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

        def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encoder = make_encoder()
            for frame in frames:
                for start in range(0, len(frame), batch):
                    piece = frame.iloc[start : start + batch]
                    vectors = np.asarray(encoder(piece[text_col].tolist()), dtype=float)
                    yield piece.assign(**{out_col: list(vectors)})

        return df.mapInPandas(encode, schema)


class HashedBigrams:
    """Built-in provider: word-bigram counts hashed to ``dimension`` and scaled to length one."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension
        self.name = f"hashed_bigrams_{dimension}"

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        terms = df.withColumn("_terms", F.coalesce(word_bigrams(words(F.col(text_col))), F.array()))
        hashed = HashingTF(numFeatures=self.dimension, inputCol="_terms", outputCol="_tf").transform(
            terms
        )
        unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed)
        return unit.withColumn(out_col, vector_to_array("_unit")).drop("_terms", "_tf", "_unit")


def embed_table(
    df: DataFrame, provider: EmbeddingProvider, text_col: str = "text_to_compare"
) -> DataFrame:
    """Rows with a text, plus ``embedding`` and its metadata. No rows in, no rows out."""
    embedded = provider.embed(df.where(F.col(text_col).isNotNull()), text_col, "embedding")
    return with_metadata(embedded, provider.name)


def with_metadata(df: DataFrame, provider_name: str, vector_col: str = "embedding") -> DataFrame:
    return df.withColumn("embedding_provider", F.lit(provider_name)).withColumn(
        "embedding_dimension", F.size(vector_col)
    )


def embed_missing(
    df: DataFrame,
    stored: DataFrame,
    provider: EmbeddingProvider,
    key: str = "row_id",
    text_col: str = "text_to_compare",
    recreate: bool = False,
) -> DataFrame:
    """Stored embeddings plus freshly made ones for rows not stored yet; ``recreate`` makes all anew."""
    if recreate:
        return embed_table(df, provider, text_col)
    fresh = embed_table(df.join(stored.select(key), key, "left_anti"), provider, text_col)
    return stored.unionByName(fresh)


def project_2d(
    df: DataFrame, id_col: str = "row_id", vector_col: str = "embedding", limit: int | None = None
) -> tuple[DataFrame, list[float]]:
    """``(id, x, y)`` on the two main axes of the centred vectors, and their variance ratios.

    Each axis points so that its largest loading is positive. The covariance is summed over the
    cluster; only a square of the vector length reaches the driver. ``limit`` keeps the first rows by
    id, for a plot.
    """
    rows = df.where(F.col(vector_col).isNotNull())
    if limit is not None:
        rows = rows.orderBy(id_col).limit(limit)
    rows = rows.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("_v"))
    centred = (
        StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c")
        .fit(rows)
        .transform(rows)
    )
    model = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = [float(np.sign(axis[np.abs(axis).argmax()])) for axis in loadings.T]
    point = vector_to_array("_p")
    plane = model.transform(centred).select(
        id_col, (point[0] * signs[0]).alias("x"), (point[1] * signs[1]).alias("y")
    )
    return plane, [float(r) for r in model.explainedVariance.toArray()]


def points_by_group(points: DataFrame, groups: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Points with their ``group_id``, -1 where there is none."""
    members = groups.select(F.col("member_id").alias(id_col), "group_id")
    return points.join(members, id_col, "left").withColumn(
        "group_id", F.coalesce("group_id", F.lit(-1))
    )


def text_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row_id, term, k)``: word bigrams of each id's text and how often they occur.

    A text's terms are counted where the text stands. Only those of an id that stands on several rows, or of none, are summed
    over rows.
    """
    named = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("_text"))
    ids = named.groupBy("row_id").agg(F.count("*").alias("_n")).where(F.col("row_id").isNull() | (F.col("_n") > 1))
    shared = materialize(ids.select("row_id"), "shared_ids")
    alone = named.where(F.col("row_id").isNotNull())
    some = not shared.isEmpty()
    if some:
        alone = alone.join(shared, "row_id", "left_anti")
    terms = F.sort_array(word_bigrams(words(F.col("_text"))))
    counted = spread(alone, "row_id").select("row_id", F.inline(runs(terms)))
    if not some:
        return counted
    rest = named.join(shared.withColumnRenamed("row_id", "_id"), F.col("row_id").eqNullSafe(F.col("_id")), "left_semi")
    exploded = rest.select("row_id", F.explode(word_bigrams(words(F.col("_text")))).alias("term"))
    return counted.unionByName(exploded.groupBy("row_id", "term").agg(F.count("*").alias("k")))


def group_sample(groups: DataFrame, k: int, seed: Sequence[int] | int = 42) -> DataFrame:
    """Members of ``k`` groups drawn by a seeded hash of the group id."""
    drawn = (
        groups.select("group_id")
        .distinct()
        .orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("group_id").cast("string"))))
        .limit(k)
    )
    return groups.join(F.broadcast(drawn), "group_id", "left_semi")
