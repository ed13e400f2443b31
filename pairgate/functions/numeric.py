"""Tolerant casts and the NULL-for-undefined policy.

Undefined numbers are NULL everywhere: NaN and infinities coming from files or arithmetic are
mapped to NULL at the edge, because Spark orders NaN above every number and treats it as equal
to itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(value: Column | str) -> Column:
    """True only for a number that is neither NULL, NaN nor infinite.

    NaN is above infinity in Spark.  The value is named once: Spark puts the expression of a computed
    column in place of its every name, and beyond a few kilobytes generated code is not compiled.
    """
    return F.coalesce(F.abs(as_column(value).cast("double")) < F.lit(INFINITY), F.lit(False))


def finite_or_null(value: Column | str) -> Column:
    c = as_column(value).cast("double")
    return F.when(is_finite(c), c)


def nan_to_null(value: Column | str) -> Column:
    c = as_column(value).cast("double")
    return F.when(~F.isnan(c), c)


def to_double(text: Column | str) -> Column:
    """Text to double; blank, malformed and NaN text become NULL."""
    return nan_to_null(F.trim(as_column(text)).try_cast("double"))


def to_int_or_zero(text: Column | str) -> Column:
    """Text to integer through double, truncating; anything unreadable is 0."""
    return F.coalesce(finite_or_null(to_double(text)).try_cast("long"), F.lit(0).cast("long"))


def strict_double(text: Column | str) -> Column:
    """Text to double; unreadable, blank and missing text raises."""
    c = as_column(text)
    filled = F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "", c)
    return F.coalesce(filled, F.raise_error(F.lit("a number is missing")).cast("string")).cast("double")


def missing_flag(text: Column | str) -> Column:
    """1.0 for text that holds no finite number, else 0.0."""
    return F.when(is_finite(F.trim(as_column(text)).try_cast("double")), 0.0).otherwise(1.0)


def oriented(metric: Column | str, value: Column | str, lower_is_better: Iterable[str]) -> Column:
    """Sign-flip the metrics where smaller is better, so that higher always means positive."""
    value = as_column(value)
    lower = list(lower_is_better)
    return F.when(as_column(metric).isin(lower), -value).otherwise(value) if lower else value


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator, NULL on a zero denominator."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def at_least(score: Column | str, threshold: Column | float) -> Column:
    """score >= threshold where an undefined score never passes."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(nan_to_null(score) >= limit, F.lit(False))


def below(score: Column | str, threshold: float) -> Column:
    """score < threshold where an undefined score never passes."""
    return F.coalesce(nan_to_null(score) < F.lit(float(threshold)), F.lit(False))


def all_finite(names: Iterable[str]) -> Column:
    """True when every named column holds a finite number."""
    condition = F.lit(True)
    for name in names:
        condition = condition & is_finite(name)
    return condition
