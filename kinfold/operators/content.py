"""Embeddings stored by content: one vector a distinct text, provider and version.

A row finds its vector through the digest of its text, so a text that changes under the same key gets a new
vector, equal texts are embedded once, and a new version of a provider replaces the old vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.embed import EmbeddingProvider, with_metadata

IDENTITY = ["text_digest", "embedding_provider", "embedding_version"]
STORE_COLUMNS = [*IDENTITY, "embedding_dimension", "embedding"]


def _identified(df: DataFrame, provider: EmbeddingProvider, version: str, text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull()).withColumns(
        {
            "text_digest": F.sha2(F.col(text_col).cast("binary"), 256),
            "embedding_provider": F.lit(provider.name),
            "embedding_version": F.lit(version),
        }
    )


def _texts(df: DataFrame, provider: EmbeddingProvider, version: str, text_col: str) -> DataFrame:
    """Each distinct text once; copies fold before the shuffle."""
    rows = _identified(df, provider, version, text_col)
    return rows.groupBy(*IDENTITY).agg(F.any_value(text_col).alias("_text"))


def made(df: DataFrame, provider: EmbeddingProvider, version: str = "1", text_col: str = "text_to_compare") -> DataFrame:
    """A fresh store of the distinct texts of ``df``."""
    texts = _texts(df, provider, version, text_col)
    vectors = with_metadata(provider.embed(texts, "_text", "embedding"), provider.name)
    return vectors.select(*STORE_COLUMNS)


def merged(
    df: DataFrame,
    store: DataFrame,
    provider: EmbeddingProvider,
    version: str = "1",
    text_col: str = "text_to_compare",
) -> DataFrame:
    """The store after ``df``: its entries that are still used, and vectors of the texts that it lacks.

    Only the lacking texts reach the provider. Entries of other providers or versions, and of texts that no row
    has any more, are left out.
    """
    texts = _texts(df, provider, version, text_col)
    used = store.join(texts.select(*IDENTITY), IDENTITY, "left_semi").select(*STORE_COLUMNS)
    lacking = texts.join(store.select(*IDENTITY), IDENTITY, "left_anti")
    vectors = with_metadata(provider.embed(lacking, "_text", "embedding"), provider.name)
    return used.unionByName(vectors.select(*STORE_COLUMNS))


def changes(
    df: DataFrame,
    store: DataFrame,
    provider: EmbeddingProvider,
    version: str = "1",
    text_col: str = "text_to_compare",
) -> DataFrame:
    """One row ``(kept, added, removed)``: what ``merged`` does to the entries of the store."""
    now = _texts(df, provider, version, text_col).select(*IDENTITY, F.lit(True).alias("_now"))
    both = store.select(*IDENTITY, F.lit(True).alias("_old")).join(now, IDENTITY, "full")
    old, new = F.col("_old").isNotNull(), F.col("_now").isNotNull()
    return both.agg(
        F.count_if(old & new).alias("kept"),
        F.count_if(~old & new).alias("added"),
        F.count_if(old & ~new).alias("removed"),
    )


def embedded(
    df: DataFrame,
    store: DataFrame,
    provider: EmbeddingProvider,
    version: str = "1",
    text_col: str = "text_to_compare",
) -> DataFrame:
    """Rows with a text, with the vector that the store has for it, if any, and the vector's metadata."""
    vectors = store.select(*STORE_COLUMNS)
    return _identified(df, provider, version, text_col).join(vectors, IDENTITY, "left")
