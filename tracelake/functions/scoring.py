"""Trajectory and output scores as column expressions; arrays keep order and repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_match(actual: Column, expected: Column) -> Column:
    """Share of expected steps that stand at their own place. An empty expectation divides by zero and raises."""
    n = F.least(F.size(actual), F.size(expected))
    same = F.zip_with(F.slice(actual, F.lit(1), n), F.slice(expected, F.lit(1), n), lambda a, e: a.eqNullSafe(e))
    return F.size(F.filter(same, lambda x: x)).cast("double") / F.size(expected)


def in_order_match(actual: Column, expected: Column) -> Column:
    """Share of expected steps met by a greedy walk through the actual ones, in order; 1 without expectations."""
    met = F.aggregate(actual, F.lit(0), lambda i, x: F.when((i < F.size(expected)) & x.eqNullSafe(F.try_element_at(expected, i + 1)), i + 1).otherwise(i))
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.try_divide(met.cast("double"), F.size(expected)))


def any_order_match(actual: Column, expected: Column) -> Column:
    """Distinct expected steps that occur at all, over all expected ones, repeats counted; 1 without expectations."""
    met = F.size(F.array_intersect(expected, actual)).cast("double")
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.try_divide(met, F.size(expected)))


def as_text(value: Column) -> Column:
    """The text form that a missing output takes in text tests."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def contains(actual: Column, value: Column, case_sensitive: bool = True) -> Column:
    a, v = as_text(actual), value
    return F.contains(a, v) if case_sensitive else F.contains(F.lower(a), F.lower(v))


def starts_with(actual: Column, value: Column, case_sensitive: bool = True) -> Column:
    a, v = as_text(actual), value
    return F.startswith(a, v) if case_sensitive else F.startswith(F.lower(a), F.lower(v))


def equals(actual: Column, expected: Column, value: Column | None = None) -> Column:
    """Equality with nulls equal; ``value`` takes the place of the expectation where it is given."""
    return actual.eqNullSafe(expected if value is None else F.coalesce(value, expected))


def blank_to_null(value: Column) -> Column:
    """Empty text counts as missing, as it does in chains of fallbacks."""
    return F.nullif(value, F.lit(""))


def token_estimate(text: Column) -> Column:
    """Three characters a token, at least one; none for an empty or missing text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3))).cast("long")


def exceeds_context(tokens: Column, limit: int = 200_000, share: float = 0.65) -> Column:
    return tokens > int(limit * share)


def confidence(level: Column) -> Column:
    """Numbers of the confidence levels; unknown ones count as 0."""
    return F.when(level == "low", 0.5).when(level == "medium", 0.75).when(level == "high", 0.9).otherwise(0.0)


def cut_middle(text: Column, limit: int = 600_000, note: str = "\n... [middle left out] ...\n") -> Column:
    """Head and tail of a text that is too long."""
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(note), F.right(text, F.lit(half))))


def parse_time(raw: Column) -> Column:
    """Timestamps from nanosecond or second numbers, digit strings, or ISO text; null where none of them."""
    text = raw.cast("string")
    number = text.try_cast("double")
    digits = text.rlike(r"^\d+$")
    exact = F.when(digits, text).otherwise(F.lit(None)).try_cast("long")
    from_ns = F.timestamp_micros(F.call_function("div", exact, F.lit(1000)))  # whole numbers: doubles lose digits here
    from_number = F.when(number > 1e12, F.timestamp_micros(F.floor(number / 1000).cast("long"))).otherwise(F.timestamp_micros((number * 1_000_000).cast("long")))
    return F.when(digits, from_ns).when(text.rlike(r"^[\d.]+$"), from_number).otherwise(F.try_to_timestamp(text))
