"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The base patterns find assignments, access keys and long hex runs. The method adds what no pattern
names: a long string near a sensitive word is a secret if a compressor that already knows the corpus's
identifiers and the surrounding text still needs many bytes for it. The marginal cost of a candidate is
the compressed size of its context with it, less the size without it, both primed with a dictionary of
the most frequent assigned names of all documents. Readable names cost little, random strings much.

A run of candidate characters is cut at its assignment signs and at base spans. Each piece is scored alone,
and the words before it, those of its own run (``private_key=...``) and those after it are its context.

Texts are scanned whole, in one pass of tasks without a shuffle. The dictionary is counted over all
documents with map-side sums; only its ``DICTIONARY_NAMES`` most frequent names reach the driver.

Nulls and edges: a null text is an empty one and has no spans (redaction leaves it null); a base span
stays whatever the method says; what a base span covers is not reported twice, the rest of its run is
scored; the name of a base assignment is no candidate; a text of any length takes time in proportion to it; repeated rows are scanned alike; other columns are untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import text_of

# Kinds of base spans with their patterns and least lengths.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a longest run of hex digits, of 32 or more
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ["assign", "access", "hex", "novel"]

#: Words that make the 64 characters on either side of them a sensitive context. They stand alone or in one another's
#: company, as words or parts of identifiers (``api_key``, ``apiKey``, ``AUTHTOKEN``), and not inside others (``author``, ``monkey``).
SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
    r"(?ai:(?:secret|token|passw(?:or)?d|passphrase|pwd|api|key|auth|authorization|authentication|cred|credential|bearer"
    r"|private|access|signature|cookie|session)+s?)"
    r"(?![a-z])(?!(?<=[A-Z])[A-Z])"
)
CONTEXT = 64
#: Candidates: runs of this length or more, and what assigns a value inside one (``=`` at its end pads it).
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SIGN = re.compile(r"=+(?!=|$)")
#: Least lengths of a name, and of a value (as in base assignments); beside a base span any length counts.
NAME_LEAST, VALUE_LEAST = 16, 8
#: Characters around a candidate that the compressor sees.
SURROUNDING = 256
#: Least marginal compressed bytes for each character of a candidate.
NOVELTY = 0.45
DICTIONARY_NAMES = 4_000
LEVEL = 9
NAME = r"([A-Za-z_][A-Za-z0-9_]{2,31})[\"']?\x20*[:=]"

Span = tuple[str, int, int]


def identifier_dictionary(docs: DataFrame, names: int = DICTIONARY_NAMES) -> bytes:
    """The most frequent assigned names of all documents, most frequent last as compressors prefer."""
    found = docs.select(F.explode(F.regexp_extract_all(text_of(), F.lit(NAME), 1)).alias("name"))
    top = found.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(names)
    return "\n".join(reversed([r["name"] for r in top.collect()])).encode()


def base_spans(text: str) -> list[Span]:
    found = [
        ("assign", m.start(), m.end())
        for m in ASSIGN.finditer(text)
        if m.end(1) - m.start(1) >= ASSIGN_LEAST
    ]
    found += [
        ("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST
    ]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def novelty(compressor: zstandard.ZstdCompressor, text: str, start: int, end: int) -> float:
    """Marginal compressed bytes for each character of ``text[start:end]`` in its surroundings."""
    before, after = text[max(0, start - SURROUNDING) : start], text[end : end + SURROUNDING]
    size = lambda part: len(compressor.compress(part.encode("utf-8", "replace")))
    return (size(before + text[start:end] + after) - size(before + after)) / (end - start)


def overlaps(known: list[Span]) -> Callable[[int, int], list[Span]]:
    """A function that lists the spans of ``known`` that meet a range; spans of one kind do not overlap."""
    kinds = [sorted(k for k in known if k[0] == kind) for kind in KINDS]
    edges = [([s for _, s, _ in spans], [e for _, _, e in spans], spans) for spans in kinds]

    def meeting(start: int, end: int) -> list[Span]:
        return [k for starts, ends, spans in edges for k in spans[bisect_right(ends, start) : bisect_left(starts, end)]]

    return meeting


def pieces(text: str, start: int, end: int, inside: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of a run that may be secrets: outside the base spans that meet it and assignment signs."""
    signs = [(start + m.start(), start + m.end()) for m in SIGN.finditer(text[start:end])]
    cuts = sorted([*signs, *((s, e) for _, s, e in inside), (end, end)])
    of_name = {s for s, _ in signs} | {s for kind, s, _ in inside if kind == "assign"}
    assigned = {s for kind, s, _ in inside if kind == "assign"}
    edges = {at for _, s, e in inside for at in (s, e)}
    at = start
    for s, e in cuts:
        if s > at and s not in assigned:
            least = NAME_LEAST if s in of_name else 1 if edges & {at, s} else VALUE_LEAST
            if s - at >= least:
                yield at, s
        at = max(at, e)


def novel_spans(compressor: zstandard.ZstdCompressor, text: str, known: list[Span]) -> list[Span]:
    found, meeting = [], overlaps(known)
    for m in CANDIDATE.finditer(text):
        for start, end in pieces(text, *m.span(), meeting(*m.span())):
            before = SENSITIVE.search(text, max(0, start - CONTEXT), start)
            if not before and not SENSITIVE.search(text, end, end + CONTEXT):
                continue
            if novelty(compressor, text, start, end) >= NOVELTY:
                found.append(("novel", start, end))
    return found


def scanner(dictionary: bytes) -> Callable[[str | None], list[Span]]:
    """A function from a text to its spans, by start and then by kind; built once a task."""
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed)

    def scan(text: str | None) -> list[Span]:
        if not text:
            return []
        known = base_spans(text)
        found = known + novel_spans(compressor, text, known)
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    return scan


def scan(docs: DataFrame, key: str = "doc_id", dictionary: bytes | None = None) -> DataFrame:
    """``(key, spans)`` of every row; a span is ``(kind, start, end)`` in code points, end exclusive."""
    known = identifier_dictionary(docs) if dictionary is None else dictionary
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = scanner(known)
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py())]
                for t in batch.column(1)
            ]
            columns = [batch.column(0), pa.array(spans, type=kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "spans"])

    slim = docs.select(key, F.col("text").alias("_text"))
    of_key = docs.schema[key].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return slim.mapInArrow(run, f"`{key}` {of_key}, spans {spans}")


def redacted_text(text: str, spans: list[Span], mark: str = "[{kind}]") -> str:
    """``text`` with every span replaced; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by their kind; all columns and rows stay."""
    known = identifier_dictionary(docs) if dictionary is None else dictionary
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = scanner(known)
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                spans = spans_of(text)
                texts.append(redacted_text(text, spans) if spans else text)
            column = pa.array(texts, type=batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), column)

    return docs.mapInArrow(run, docs.schema)
