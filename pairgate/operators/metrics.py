"""Ranking and threshold metrics of a score against a 0/1 label, per group.

Every metric takes long rows (keys..., score, label) and returns one row per group.  Rows whose
score is not finite or whose label is NULL take no part, except in ``confusion``, where an
undefined score predicts negative.  Scores are merged to counts per distinct value before they
are sorted, so a value shared by a third of all rows costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgate import constants as C
from pairgate.functions.numeric import at_least, finite_or_null, is_finite, oriented, ratio
from pairgate.operators.ordered import ROWS_PER_BUCKET, OrderCuts, plan_cuts, running_totals


def _clean(df: DataFrame, keys: Sequence[str], score: str, label: str, *extra: str) -> DataFrame:
    # + 0.0 turns -0.0 into 0.0, so the two share one tie group.
    return df.where(is_finite(score) & F.col(label).isNotNull()).select(
        *keys,
        (F.col(score).cast("double") + F.lit(0.0)).alias("s"),
        F.col(label).cast("long").alias("y"),
        *extra,
    )


def _grouped(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def _counts(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, order, p, n): positives and negatives at each distinct score."""
    return rows.groupBy(*keys, order).agg(
        F.sum("y").alias("p"), F.sum(F.lit(1) - F.col("y")).alias("n")
    )


def ranking_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    cuts: OrderCuts | None = None,
) -> DataFrame:
    """n, n_positive, n_negative, tie-aware AUROC and Spearman rho with the label, per group.

    AUROC = sum over scores of p * (negatives below + half the tied negatives) / (P * N).
    The label has two average ranks, so the rank correlation needs no second ranking.
    """
    rows = _clean(df, keys, score, label)
    counts = _counts(rows, keys, "s").withColumn("c", F.col("p") + F.col("n"))
    ordered = running_totals(
        counts, keys, "s", ["n", "c"], rows_per_bucket=rows_per_bucket, sizing=rows, cuts=cuts
    )
    rank = F.col("before_c") + (F.col("c") + 1) / F.lit(2.0)
    sums = _grouped(ordered, keys).agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_positive"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_negative"),
        F.sum(F.col("p") * (F.col("before_n") + F.col("n") / F.lit(2.0))).alias("u"),
        F.sum(F.col("p") * rank).alias("pr"),
        F.sum(F.col("c") * rank * rank).alias("crr"),
    )
    p, n = F.col("n_positive").cast("double"), F.col("n_negative").cast("double")
    m = p + n
    mean_rank = (m + 1) / F.lit(2.0)
    positive_part = F.col("pr") - p * mean_rank
    rank_variance = F.col("crr") - m * mean_rank * mean_rank
    both = (p > 0) & (n > 0)
    rho = F.try_divide(positive_part * F.sqrt(m), F.sqrt(F.greatest(rank_variance, F.lit(0.0)) * p * n))
    return sums.select(
        *keys,
        (F.col("n_positive") + F.col("n_negative")).alias("n"),
        "n_positive",
        "n_negative",
        F.when(both, F.col("u") / (p * n)).alias("auroc"),
        F.when(both, rho).alias("spearman_rho"),
    )


def auroc(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", **kw) -> DataFrame:
    return ranking_metrics(df, keys, score, label, **kw).drop("spearman_rho")


def _descending(df: DataFrame, keys: Sequence[str], score: str, label: str, ordinal: str) -> DataFrame:
    return _clean(df, keys, score, label, F.col(ordinal).cast("long").alias("o")).select(
        *keys, (-F.col("s")).alias("down"), "y", "o", F.lit(1).cast("long").alias("one")
    )


def average_precision(
    df: DataFrame,
    keys: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    ordinal: str = "ordinal",
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    cuts: OrderCuts | None = None,
) -> DataFrame:
    """Average precision per group; ties are taken in the order of the numeric ``ordinal``."""
    rows = _descending(df, keys, score, label, ordinal)
    ordered = running_totals(rows, keys, "down", ["y", "one"], tie="o", rows_per_bucket=rows_per_bucket, cuts=cuts)
    precision = (F.col("before_y") + 1) / (F.col("before_one") + 1).cast("double")
    return (
        _grouped(ordered, keys)
        .agg(
            F.sum(F.when(F.col("y") == 1, precision)).alias("hits"),
            F.coalesce(F.sum("y"), F.lit(0)).alias("n_positive"),
        )
        .select(*keys, F.when(F.col("n_positive") > 0, F.col("hits") / F.col("n_positive")).alias("ap"))
    )


def spearman(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rank correlation of two numeric columns per group, with average ranks for ties.

    Rows are merged to counts per (x, y) first; ranks are joined to that table and weighted by
    the counts.  Undefined (NULL) below two rows or without variance.
    """
    pairs = (
        df.where(is_finite(x) & is_finite(y))
        .select(*keys, (F.col(x).cast("double") + 0.0).alias("a"), (F.col(y).cast("double") + 0.0).alias("b"))
        .groupBy(*keys, "a", "b")
        .agg(F.count(F.lit(1)).alias("w"))
    )

    def ranks(v: str, out: str) -> DataFrame:
        merged = pairs.groupBy(*keys, v).agg(F.sum("w").alias("c"))
        ordered = running_totals(merged, keys, v, ["c"], rows_per_bucket=rows_per_bucket)
        return ordered.select(*keys, v, (F.col("before_c") + (F.col("c") + 1) / F.lit(2.0)).alias(out))

    ranked = pairs.join(ranks("a", "ra"), [*keys, "a"]).join(ranks("b", "rb"), [*keys, "b"])
    w = F.col("w")
    sums = _grouped(ranked, keys).agg(
        F.sum("w").alias("m"),
        F.sum(w * F.col("ra") * F.col("rb")).alias("ab"),
        F.sum(w * F.col("ra") * F.col("ra")).alias("aa"),
        F.sum(w * F.col("rb") * F.col("rb")).alias("bb"),
    )
    m = F.col("m").cast("double")
    centre = m * ((m + 1) / 2.0) * ((m + 1) / 2.0)
    va, vb = F.col("aa") - centre, F.col("bb") - centre
    rho = F.try_divide(F.col("ab") - centre, F.sqrt(F.greatest(va * vb, F.lit(0.0))))
    return sums.select(
        *keys, F.coalesce(F.col("m"), F.lit(0)).alias("n"), F.when(F.col("m") >= 2, rho).alias("spearman_rho")
    )


def confusion(
    df: DataFrame,
    threshold: float | Column,
    keys: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Counts and rates when a score at or above the threshold predicts positive."""
    called = at_least(score, threshold)
    positive = F.col(label).cast("int") == 1
    counts = _grouped(df.where(F.col(label).isNotNull()), keys).agg(
        F.count_if(called & positive).alias("tp"),
        F.count_if(called & ~positive).alias("fp"),
        F.count_if(~called & positive).alias("fn"),
        F.count_if(~called & ~positive).alias("tn"),
    )
    return counts.select(
        "*",
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
        ratio("tn", F.col("tn") + F.col("fp")).alias("specificity"),
        ratio("fp", F.col("fp") + F.col("tn")).alias("fpr"),
    )


def ppv(recall: Column, specificity: Column, prevalence: Column) -> Column:
    """Precision to expect at a prevalence, by Bayes; NULL when nothing would be called."""
    true_mass = recall * prevalence
    false_mass = (F.lit(1.0) - specificity) * (F.lit(1.0) - prevalence)
    return F.when(true_mass + false_mass > 0, true_mass / (true_mass + false_mass))


def ppv_sweep(rates: DataFrame, prevalences: Sequence[float] = C.PREVALENCE_GRID) -> DataFrame:
    """One row per prevalence for every row of rates (recall, specificity)."""
    grid = F.array(*[F.lit(float(p)) for p in prevalences])
    swept = rates.withColumn("prevalence", F.explode(grid))
    return swept.withColumn("ppv", ppv(F.col("recall"), F.col("specificity"), F.col("prevalence")))


def gate_summary(df: DataFrame, threshold: float | Column, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Metrics at a threshold together with the prevalence sweep, one row per prevalence."""
    return ppv_sweep(confusion(df, threshold, keys, score, label))


@F.pandas_udf(T.DoubleType())
def next_above(value: pd.Series) -> pd.Series:
    """The smallest double above the value."""
    return pd.Series(np.nextafter(value.to_numpy(dtype=float), np.inf))


@F.pandas_udf(T.DoubleType())
def next_below(value: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(value.to_numpy(dtype=float), -np.inf))


def threshold_for_precision(
    df: DataFrame,
    target_precision: float,
    keys: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Lowest operating point whose precision reaches the target, else the most precise one.

    Candidates are "call everything" and, for each distinct score u, "call scores above u".
    ``cut`` is u (NULL for "call everything"); ``threshold`` is the equivalent inclusive limit.
    """
    rows = _clean(df, keys, score, label).withColumn("down", -F.col("s"))
    ordered = running_totals(
        _counts(rows, keys, "down"),
        keys,
        "down",
        ["p", "n"],
        rows_per_bucket=rows_per_bucket,
        sizing=rows,
    ).withColumn("s", -F.col("down"))
    called = F.col("before_p") + F.col("before_n")
    precision = F.try_divide(F.col("before_p").cast("double"), called.cast("double"))
    scored = ordered.withColumn("precision", precision)
    target = F.lit(float(target_precision))
    best = F.struct("precision", (-F.col("s")).alias("neg_s"))
    picked = _grouped(scored, keys).agg(
        F.sum("p").alias("P"),
        F.sum("n").alias("N"),
        F.min("s").alias("lowest"),
        F.min(F.when(F.col("precision") >= target, F.col("s"))).alias("hit"),
        F.max(F.when(F.col("precision").isNotNull(), best)).alias("best"),
    )
    everything = F.try_divide(F.col("P").cast("double"), (F.col("P") + F.col("N")).cast("double"))
    floor_hits = (everything >= target) & (F.col("P") > 0)
    floor_best = F.col("best").isNull() | (everything >= F.col("best.precision"))
    hit = F.when(F.col("P") > 0, F.col("hit"))
    use_floor = floor_hits | (hit.isNull() & floor_best)
    cut = F.when(use_floor, F.lit(None).cast("double")).otherwise(
        F.coalesce(hit, -F.col("best.neg_s"))
    )
    chosen = picked.select(
        *keys,
        cut.alias("cut"),
        F.col("lowest"),
        F.when(use_floor, everything).alias("_floor_precision"),
        F.coalesce(F.when(floor_hits, True), hit.isNotNull()).alias("reached"),
    )
    threshold = (
        F.when(F.col("cut").isNotNull(), next_above("cut"))
        .when(F.col("lowest").isNotNull(), next_below("lowest"))
        .otherwise(F.lit(0.0))
    )
    return chosen.select(*keys, "cut", threshold.alias("threshold"), "reached")


def recall_at_precision(
    df: DataFrame, target_precision: float, keys: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """Recall at the operating point chosen for a precision target."""
    picks = threshold_for_precision(df, target_precision, keys, score, label)
    if not keys:
        threshold = picks.first()["threshold"]
        return confusion(df, threshold, (), score, label).select(
            F.lit(threshold).alias("threshold"), "recall"
        )
    joined = df.join(picks.select(*keys, "threshold"), list(keys))
    return confusion(joined, F.col("threshold"), [*keys, "threshold"], score, label).select(
        *keys, "threshold", "recall"
    )


def metric_table(
    df: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    label: str = "label",
    ordinal: str = "ordinal",
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """n, class counts, baseline AP, Spearman, AUROC and AP per group, after the finite filter.

    A group none of whose scores is defined keeps its row, with counts 0 and NULL metrics.
    """
    if not keys:
        whole = df.withColumn("__all", F.lit(0))
        return metric_table(whole, ["__all"], score, label, ordinal, rows_per_bucket=rows_per_bucket).drop("__all")
    # Both orders are cut alike: the rows are counted and their quantiles taken once.
    cuts = plan_cuts(_descending(df, keys, score, label, ordinal), "down", "o", rows_per_bucket)
    ranking = ranking_metrics(df, keys, score, label, rows_per_bucket=rows_per_bucket, cuts=cuts.mirrored())
    ap = average_precision(df, keys, score, label, ordinal, rows_per_bucket=rows_per_bucket, cuts=cuts)
    groups = df.select(*keys).distinct().dropna(subset=list(keys))
    joined = groups.join(ranking, list(keys), "left").join(ap, list(keys), "left")
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    return joined.select(
        *keys,
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "n_positive", "n_negative")],
        ratio("n_positive", "n").alias("baseline_ap"),
        "spearman_rho",
        "auroc",
        F.when(both, F.col("ap")).alias("ap"),
    )


def with_totals_stratum(df: DataFrame, stratum: str, name: str = "stratum") -> DataFrame:
    """Each row once under 'all' and once under its own non-blank stratum value."""
    own = F.when(F.coalesce(F.col(stratum), F.lit("")) != "", F.array(F.lit("all"), F.col(stratum)))
    return df.withColumn(name, F.explode(F.coalesce(own, F.array(F.lit("all")))))


def unpivot_metrics(
    df: DataFrame, ids: Sequence[str], metrics: Sequence[str], lower_is_better: Sequence[str] = ()
) -> DataFrame:
    """Wide metric columns to long (ids, metric, score), sign-flipped where smaller is better."""
    wide = df.select(*ids, *[finite_or_null(m).alias(m) for m in metrics])
    long = wide.unpivot(list(ids), list(metrics), "metric", "score")
    return long.withColumn("score", oriented("metric", "score", lower_is_better))


def bucket_summary(
    df: DataFrame,
    value: str,
    metrics: Sequence[str],
    edges: Sequence[tuple[str, float, float]],
) -> DataFrame:
    """Count, mean and population std of every metric per half-open (lo, hi] bucket of ``value``.

    Empty buckets are kept, with count 0 and NULL statistics.
    """
    v = F.col(value).cast("double")
    bucket = F.lit(None).cast("string")
    for name, lo, hi in reversed(list(edges)):
        inside = ~F.isnan(v) & (v > F.lit(float(lo))) & (v <= F.lit(float(hi)))
        bucket = F.when(inside, F.lit(name)).otherwise(bucket)
    stats = []
    for m in metrics:
        clean = F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
        stats += [F.avg(clean).alias(f"{m}_mean"), F.stddev_pop(clean).alias(f"{m}_std")]
    grouped = (
        df.withColumn("bucket", bucket)
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), *stats)
    )
    names = df.sparkSession.createDataFrame(
        [(i, name) for i, (name, _, _) in enumerate(edges)], "bucket_ord int, bucket string"
    )
    return names.join(grouped, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def standardizer(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, mean, std) with population std; a constant column gets std 1."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "feature", "x"
    )
    std = F.stddev_pop("x")
    return long.groupBy(*keys, "feature").agg(
        F.avg("x").alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std")
    )
