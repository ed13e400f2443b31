"""Element-wise array arithmetic on embeddings and feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairgate.functions.numeric import as_column


def as_doubles(v: Column | str) -> Column:
    return as_column(v).cast("array<double>")


def concat_pair(a: Column | str, b: Column | str) -> Column:
    return F.concat(as_doubles(a), as_doubles(b))


def hadamard(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)


def total(v: Column | str) -> Column:
    return F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(hadamard(a, b))


def linear_logit(
    names: Sequence[str],
    mean: Sequence[float],
    std: Sequence[float],
    intercept: float,
    coef: Sequence[float],
) -> Column:
    """intercept + sum of coef * (x - mean) / std over named columns: one codegen expression."""
    logit = F.lit(float(intercept))
    for name, m, s, c in zip(names, mean, std, coef, strict=True):
        logit = logit + (F.col(name).cast("double") - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(c))
    return logit
