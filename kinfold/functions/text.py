"""Text cleaning, keys and word-bigram terms as native expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "MISSING"
KEY_SEPARATOR = "||"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and let ``body`` use it several times, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends (``trim`` only knows the blank)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Null to empty, line breaks and tabs to blanks, other control characters dropped,
    whitespace runs collapsed; text with nothing left becomes ``MISSING``."""
    spaced = F.translate(text.cast("string"), "\r\n\t", "   ")
    printable = F.regexp_replace(spaced, r"[\x00-\x1f]", "")
    tidy = F.trim(F.regexp_replace(printable, r"(?U)\s+", " "))
    return F.coalesce(F.regexp_replace(tidy, "^$", MISSING), F.lit(""))


def text_to_compare(source_id: Column, description: Column, developer: Column) -> Column:
    """Comparison text of a relationship; null only when the source id is null."""
    return F.concat(
        source_id,
        F.lit(" - "),
        F.coalesce(description, F.lit("")),
        F.lit(" | Developed by "),
        F.coalesce(developer, F.lit("")),
    )


def composite_key(parts: Iterable[Column], clean: bool = False) -> Column:
    """Trimmed parts joined by ``||``; a missing part is empty.

    ``clean=True`` first applies ``clean_text``, for comparing cleaned with raw records.
    """
    prepare = (lambda c: clean_text(c)) if clean else strip
    return F.concat_ws(
        KEY_SEPARATOR, *[F.coalesce(prepare(p.cast("string")), F.lit("")) for p in parts]
    )


def shorten(text: Column, limit: int = 100) -> Column:
    """First ``limit`` characters with dots when something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def contains_ignore_case(text: Column, pattern: str) -> Column:
    """Case-insensitive substring test, false on null."""
    escaped = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return F.coalesce(text.ilike(f"%{escaped}%"), F.lit(False))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    pieces = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(pieces, lambda w: w != "")


def word_bigrams(word_list: Column) -> Column:
    """Neighbouring word pairs of a list of words, in order, repeats kept."""

    def pair_up(w: Column) -> Column:
        pairs = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(
            F.slice(w, F.lit(1), pairs),
            F.slice(w, F.lit(2), pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )

    return bind(word_list, pair_up)
