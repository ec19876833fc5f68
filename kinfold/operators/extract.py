"""Relationship extraction: filters, comparison text, document prefixes, unions, focus documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import contains_ignore_case, text_to_compare

# Relationship and entity types.
DEVELOPED_BY = "DEVELOPED_BY"
COLLABORATION = "COLLABORATION"
ORGANIZATION = "Organization"
INNOVATION = "Innovation"

FOCUS_TEXT_COLUMNS = [
    "target_english_id",
    "source_english_id",
    "target_description",
    "source_description",
    "relationship_description",
]


@dataclass(frozen=True)
class Domain:
    """One relationship table: prefix of its document keys, place in row order, row filter."""

    prefix: str
    order: int
    drop_source_type: str | None = None


@dataclass(frozen=True)
class Focus:
    """The organization of interest: its id and a pattern found in names and descriptions."""

    org_id: str
    pattern: str


FOCUS_DOMAIN = Domain("FOC", 0)
COMPARISON_DOMAIN = Domain("COMP", 1, ORGANIZATION)


def _numbered(df: DataFrame, domain: Domain) -> DataFrame:
    number = F.coalesce(F.col("document_number").cast("string"), F.lit(""))
    return df.withColumn("document_number", F.concat(F.lit(domain.prefix), number)).withColumn(
        "domain_order", F.lit(domain.order)
    )


def developed_by(df: DataFrame, domain: Domain) -> DataFrame:
    """DEVELOPED_BY rows of one domain with comparison text and prefixed document key.

    A row without a source type is kept by the type filter.
    """
    rows = df.where(F.col("relationship_type") == DEVELOPED_BY)
    if domain.drop_source_type is not None:
        rows = rows.where(~F.col("source_type").eqNullSafe(domain.drop_source_type))
    return _numbered(
        rows.withColumn(
            "text_to_compare",
            text_to_compare(
                F.col("source_id"), F.col("source_description"), F.col("target_english_id")
            ),
        ),
        domain,
    )


def combined(
    focus: DataFrame,
    comparison: DataFrame,
    focus_domain: Domain = FOCUS_DOMAIN,
    comparison_domain: Domain = COMPARISON_DOMAIN,
) -> DataFrame:
    """Filtered rows of both domains under common columns."""
    return developed_by(focus, focus_domain).unionByName(
        developed_by(comparison, comparison_domain), allowMissingColumns=True
    )


def unfiltered(
    focus: DataFrame,
    comparison: DataFrame,
    focus_domain: Domain = FOCUS_DOMAIN,
    comparison_domain: Domain = COMPARISON_DOMAIN,
) -> DataFrame:
    """All rows of both domains with prefixed document keys."""
    return _numbered(focus, focus_domain).unionByName(
        _numbered(comparison, comparison_domain), allowMissingColumns=True
    )


def focus_documents(df: DataFrame, focus: Focus) -> DataFrame:
    """All rows of the documents in which the focus organization shows up anywhere."""
    ids = [F.coalesce(F.col(c) == focus.org_id, F.lit(False)) for c in ("target_id", "source_id")]
    texts = [contains_ignore_case(F.col(c), focus.pattern) for c in FOCUS_TEXT_COLUMNS]
    hits = df.where(reduce(or_, ids + texts)).select("document_number").distinct()
    return df.join(hits, "document_number", "left_semi")
