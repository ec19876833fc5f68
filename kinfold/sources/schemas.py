"""Declared schemas of the tables the library reads."""

from __future__ import annotations

import re

# The column headers of a relationship CSV.
RELATIONSHIP_HEADERS = [
    "Document number",
    "source type",
    "source id",
    "source english_id",
    "source description",
    "relationship type",
    "relationship description",
    "target id",
    "target english_id",
    "target description",
]
OPTIONAL_HEADERS = ["Source Company", "Source Text"]

# The fields of a labelled record, all text.
RECORD_FIELDS = [
    "source_id",
    "source_english_id",
    "source_description",
    "relationship_description",
    "target_id",
    "target_english_id",
    "document_number",
    "source_company",
]


def snake(name: str) -> str:
    return re.sub(r"\W+", "_", name.strip().lower())


RELATIONSHIP_COLUMNS = [snake(h) for h in RELATIONSHIP_HEADERS]
RECORD_TYPE = "struct<" + ",".join(f"{f}:string" for f in RECORD_FIELDS) + ">"
ROW_TYPE = "struct<" + ",".join(f"`{h}`:string" for h in RELATIONSHIP_HEADERS) + ">"
VERDICT_SCHEMA = "group_id bigint, part int, false_positives array<int>, reasoning string"
SUMMARY_SCHEMA = "group_id bigint, part int, title string, description string"
