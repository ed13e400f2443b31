"""Exact running totals, ranks and dense numbering over an order, without one-task windows.

A window without a partition key (or with one hot key) sorts everything in a single task.
Here rows are first placed into order buckets cut at approximate quantiles; windows run inside
a bucket, the totals of the earlier buckets are added from a small table.  Where the cuts fall
changes only the balance, never the result: equal scores always share a bucket, and a score
that fills whole buckets on its own is divided further along the tie-break column.

The cuts (one number per ``rows_per_bucket`` rows) are collected before the plan is built, so that
every branch of the plan places rows alike.  Inputs that fit one bucket get the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
# More buckets than this are cut in two steps, so that a sketch costs the same per row at every size.
BUCKETS_AT_ONCE, RANGES = 5_000, 100
_BUCKET, _TIE = "__order_bucket", "__tie_bucket"


@dataclass(frozen=True)
class OrderCuts:
    """Strictly increasing cuts of the score, the buckets of one repeated score, tie cuts."""

    score_cuts: tuple[float, ...] = ()
    hot_buckets: tuple[int, ...] = ()
    tie_cuts: tuple[float, ...] = ()

    @property
    def trivial(self) -> bool:
        return not self.score_cuts

    def mirrored(self) -> OrderCuts:
        """The cuts of the negated score, without tie cuts."""
        return OrderCuts(tuple(sorted(math.nextafter(-c, math.inf) for c in self.score_cuts)))


def _sketched(column: str, buckets: int):
    fractions = [i / buckets for i in range(1, buckets)]
    return F.percentile_approx(F.col(column).cast("double"), fractions, max(10_000, 10 * buckets)).alias("q")


def _quantiles(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Approximate quantiles, repeated where one value fills buckets."""
    if buckets <= BUCKETS_AT_ONCE:
        return list(df.agg(_sketched(column, buckets)).first()["q"] or [])
    # Ranges first, then the quantiles of each: one fine sketch of all rows would be longer than the
    # runs of rows that are merged into it.
    coarse = list(df.agg(_sketched(column, RANGES)).first()["q"] or [])
    ranged = _cut(df.select(column).dropna(), column, sorted(set(coarse)), "__range")
    fine = ranged.groupBy("__range").agg(_sketched(column, math.ceil(buckets / RANGES))).collect()
    return sorted([*coarse, *(v for r in fine for v in r["q"] or [])])


def plan_cuts(
    df: DataFrame, score: str, tie: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET
) -> OrderCuts:
    n = df.count()
    buckets = math.ceil(n / rows_per_bucket)
    if buckets <= 1:
        return OrderCuts()
    found = _quantiles(df, score, buckets)
    repeated = {a for a, b in zip(found, found[1:]) if a == b} if tie else set()
    cuts = sorted({*found, *(math.nextafter(v, math.inf) for v in repeated)})
    hot = tuple(cuts.index(v) + 1 for v in sorted(repeated))
    ties = tuple(sorted(set(_quantiles(df, tie, buckets)))) if repeated else ()
    return OrderCuts(tuple(cuts), hot, ties)


def _cut(df: DataFrame, column: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Bucket number by binary search: bucket i holds cuts[i-1] <= value < cuts[i]."""
    splits = [-math.inf, *cuts, math.inf]
    staged = df.withColumn("__cut_in", F.col(column).cast("double"))
    placed = Bucketizer(splits=splits, inputCol="__cut_in", outputCol="__cut_out").transform(staged)
    return placed.withColumn(out, F.col("__cut_out").cast("int")).drop("__cut_in", "__cut_out")


def place(df: DataFrame, score: str, tie: str | None, cuts: OrderCuts) -> DataFrame:
    """Add the order bucket and the tie bucket of every row."""
    if cuts.trivial:
        return df.withColumn(_BUCKET, F.lit(0)).withColumn(_TIE, F.lit(0))
    placed = _cut(df, score, cuts.score_cuts, _BUCKET)
    if not cuts.hot_buckets or not cuts.tie_cuts:
        return placed.withColumn(_TIE, F.lit(0))
    placed = _cut(placed, tie, cuts.tie_cuts, _TIE)
    in_hot = F.col(_BUCKET).isin(list(cuts.hot_buckets))
    return placed.withColumn(_TIE, F.when(in_hot, F.col(_TIE)).otherwise(F.lit(0)))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    sums: Sequence[str],
    *,
    tie: str | None = None,
    then: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    sizing: DataFrame | None = None,
    cuts: OrderCuts | None = None,
) -> DataFrame:
    """Add ``before_<c>``: the total of ``c`` over the rows that come earlier in (score, tie).

    Order is ascending; (keys, score, tie, then...) must identify a row.  Keys must not be NULL.
    ``then`` orders rows that agree on score and tie; such rows stay in one bucket.
    ``sizing`` may name the cheaper rows ``df`` was aggregated from, to place the cuts with; ``cuts``
    are those of an earlier plan of the same order.
    """
    if cuts is None:
        cuts = plan_cuts(df if sizing is None else sizing, score, tie, rows_per_bucket)
    order = [F.col(c) for c in [score, *([tie] if tie else []), *then]]

    def earlier(partition: Sequence[str]) -> Window:
        spec = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
        return spec.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    if cuts.trivial:
        w = earlier(keys)
        return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{c}") for c in sums])

    parts = [*keys, _BUCKET, _TIE]
    placed = place(df, score, tie, cuts)
    w = earlier(parts)
    local = placed.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__in_{c}") for c in sums])
    totals = placed.groupBy(*parts).agg(*[F.sum(c).alias(f"__all_{c}") for c in sums])
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    across = spec.orderBy(_BUCKET, _TIE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *parts, *[F.coalesce(F.sum(f"__all_{c}").over(across), F.lit(0)).alias(f"__off_{c}") for c in sums]
    )
    joined = local.join(offsets, parts)
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"__in_{c}") + F.col(f"__off_{c}")).alias(f"before_{c}") for c in sums],
    )


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    tie: str | None = None,
    name: str = "index",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """0-based position of every row in (order, tie) within its keys."""
    counted = df.withColumn("__one", F.lit(1).cast("long"))
    out = running_totals(counted, keys, order, ["__one"], tie=tie, rows_per_bucket=rows_per_bucket)
    return out.withColumn(name, F.col("before___one").cast("long")).drop("__one", "before___one")


def lexical_index(df: DataFrame, column: str, *, name: str = "index", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """0-based position of every distinct text in byte order.

    Buckets are cut on the first six bytes read as a number, then on the next six.
    """

    def bytes_as_number(start: int):
        digits = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), start, 6)), 12, "0")
        return F.conv(digits, 16, 10).cast("double")

    keyed = df.select("*", bytes_as_number(1).alias("__p"), bytes_as_number(7).alias("__q"), F.lit(1).cast("long").alias("__one"))
    out = running_totals(keyed, [], "__p", ["__one"], tie="__q", then=[column], rows_per_bucket=rows_per_bucket)
    return out.withColumn(name, F.col("before___one").cast("long")).drop("__p", "__q", "__one", "before___one")


def average_ranks(
    df: DataFrame, value: str, keys: Sequence[str] = (), *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """One row per (keys, distinct value): its count and its average 1-based rank.

    Repeated values are merged before anything is sorted; join back on (keys, value) when
    ranks are wanted per row.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_tied"))
    ordered = running_totals(
        counts, keys, value, ["n_tied"], rows_per_bucket=rows_per_bucket, sizing=df
    )
    rank = F.col("before_n_tied") + (F.col("n_tied") + 1) / F.lit(2.0)
    return ordered.select(*keys, value, "n_tied", rank.alias("avg_rank"))


def medians(
    df: DataFrame, keys: Sequence[str], value: str, *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Exact median per group from merged counts; no group's values meet in one task's memory."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    ordered = running_totals(
        counts, keys, value, ["__n"], rows_per_bucket=rows_per_bucket, sizing=df
    ).join(sizes, list(keys))
    lo, hi = F.floor((F.col("__m") - 1) / 2), F.floor(F.col("__m") / 2)
    start, stop = F.col("before___n"), F.col("before___n") + F.col("__n")

    def holds(position):
        return (position >= start) & (position < stop)

    middle = ordered.where(holds(lo) | holds(hi))
    return middle.groupBy(*keys).agg(
        ((F.max(value) + F.min(value)) / F.lit(2.0)).alias("median")
    )
