"""Predicates: optional facets, versioned reads, null-tolerant bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions given; those that are None are no filter."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def optional_equals(column: Column, value) -> Column | None:
    return None if value is None else column == F.lit(value)


def contains_any(needle: str | None, *columns: Column) -> Column | None:
    """Case-insensitive contains over several columns; `%` and `_` of the input are wildcards."""
    if not needle:
        return None
    return any_of(*(F.coalesce(c.ilike(f"%{needle}%"), F.lit(False)) for c in columns))


def contains_literal(needle: str | None, *columns: Column) -> Column | None:
    """The same without wildcards."""
    if not needle:
        return None
    return any_of(*(F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns))


def versioned(raw: Column, version: Column, current: int) -> Column:
    """A derived value, null unless its producer's version is the current one."""
    return F.when(version == current, raw)


def stale(version: Column, current: int) -> Column:
    """Version missing or other (null-safe)."""
    return ~version.eqNullSafe(F.lit(current))


def needs_analysis(verdict: Column, version: Column, analyzed: Column, report: Column, current: int) -> Column:
    """No verdict, never analysed, no report, or an old verdict. An empty report is present."""
    return verdict.isNull() | analyzed.isNull() | report.isNull() | stale(version, current)


def to_reanalyse(status: Column, verdict: Column, version: Column, analyzed: Column, report: Column, current: int) -> Column:
    """Pending rows never analysed, without a report, or with an old verdict; an empty report
    marks a final failure and is not taken up again."""
    return (status == "pending") & (analyzed.isNull() | report.isNull() | (verdict.isNotNull() & stale(version, current)))


def within_band(a: Column, b: Column, tolerance: float) -> Column:
    """Either side null, or at most `tolerance` apart."""
    return a.isNull() | b.isNull() | (F.abs(a - b) <= tolerance)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def normal_path(column: Column) -> Column:
    """Paths compared across systems: trimmed, with slashes, in lower case."""
    return F.lower(F.translate(F.trim(column), "\\", "/"))


def duration_mismatch(declared: Column, decoded: Column, seconds: float = 1.0) -> Column:
    """Declared and decoded durations more than `seconds` apart; never without a decoded one."""
    return F.coalesce((decoded > 0) & (F.abs(declared - decoded) > seconds), F.lit(False))


def queue_search(needle: str | None, otherwise: Column, *columns: Column) -> Column:
    """A literal search over the columns; while nothing is searched, `otherwise` filters."""
    found = contains_literal((needle or "").strip(), *columns)
    return otherwise if found is None else found
