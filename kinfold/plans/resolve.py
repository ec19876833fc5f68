"""From combined relationships to validated groups and unified records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import dedup, review, sparse, unify
from kinfold.sources.worktable import materialize


@dataclass(frozen=True)
class Resolution:
    """The stages of one run; each is a DataFrame, written where later stages read it repeatedly."""

    rows: DataFrame  # first row of each description
    vectors: DataFrame
    groups: DataFrame  # group_id, member_id


def resolve(combined: DataFrame, threshold: float) -> Resolution:
    """Exact dedup, vectors and groups of the combined relationships, which are written first."""
    combined = materialize(combined, "combined")
    rows = materialize(
        dedup.first_of_each(combined, "source_description", ["domain_order", "row_id"]), "rows"
    )
    vectors = sparse.text_vectors(rows, "row_id", "source_description")
    groups = materialize(sparse.similar_groups(vectors, threshold), "groups")
    return Resolution(rows, vectors, groups)


def members(run: Resolution) -> DataFrame:
    """Group members with their rows, numbered for review."""
    placed = run.groups.select("group_id", F.col("member_id").alias("row_id"))
    return review.numbered_members(placed.join(run.rows, "row_id"))


def validated(run: Resolution, threshold: float) -> DataFrame:
    """Members that the rule reviewer keeps, numbered afresh."""
    numbered = materialize(members(run), "members")
    wrong = review.rule_verdicts(numbered, run.vectors, threshold)
    return review.renumbered(materialize(review.apply_verdicts(numbered, wrong), "reviewed"))


def unified_inputs(kept: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, summaries, documents)`` that unified records are made of."""
    kept = materialize(kept, "kept")
    documents = materialize(unify.group_documents(kept, relationships), "documents")
    return kept, review.rule_summaries(kept), documents
