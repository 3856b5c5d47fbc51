"""Text expressions shared by the operators. All are JVM built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z][a-z0-9]+"


def squeeze(text: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    return unless(F.trim(text), F.lit(""))


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Every match in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def token_set(text: Column, pattern: str = WORD) -> Column:
    return F.array_distinct(tokens(text, pattern))


def any_of(text: Column, terms: Sequence[str]) -> Column:
    """True where one of the literal terms occurs."""
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def head_tail(text: Column, limit: Column | int) -> Column:
    """Text over the limit keeps its first 70 % and last 30 %, with the omitted count between."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.floor(limit * 0.7).cast("int")
    tail = (limit - head).cast("int")
    omitted = F.length(text) - limit
    marker = F.concat(F.lit("\n... ["), omitted.cast("string"), F.lit(" omitted] ...\n"))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, F.lit(1), head), marker, F.right(text, tail))
    )


def clip(text: Column, limit: int, mark: str = "...") -> Column:
    """First ``limit`` characters, marked if cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def unless(value: Column | str, other: Column) -> Column:
    """The value, or null where it equals ``other``."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value != other, value)
