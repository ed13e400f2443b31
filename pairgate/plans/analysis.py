"""Score-table analyses: metric tables per label and stratum, contrasts, logistic tables, grids."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.functions.numeric import all_finite, below, nan_to_null, oriented
from pairgate.functions.text import pair_parts
from pairgate.operators import linear, resampling, sampling
from pairgate.operators import metrics as M
from pairgate.operators import relational as R

RMSD_BUCKETS = (("<=4 Å", -math.inf, 4.0), ("4-8 Å", 4.0, 8.0), (">8 Å", 8.0, math.inf))


def label_metrics(
    rows: DataFrame,
    labels: Mapping[str, Column],
    metrics: Sequence[str],
    lower_is_better: Sequence[str],
    *,
    stratum: str | None = None,
    n_boot: int = 0,
) -> DataFrame:
    """Metric table per label, metric and (with ``stratum``) stratum, in one grouped pass.

    ``rows`` has one row per example with an ordinal.
    """
    labelled = R.label_rows(rows, labels)
    labelled = M.with_totals_stratum(labelled, stratum) if stratum else labelled.withColumn("stratum", F.lit("all"))
    keys = ["stratum", "label", "metric"]
    long = M.unpivot_metrics(labelled, ["stratum", "label", "y", "ordinal"], metrics, lower_is_better)
    table = M.metric_table(long, keys, "score", "y", "ordinal")
    if n_boot:
        for name in ("auroc", "ap"):
            ci = resampling.bootstrap_ci(long, name, keys, "score", "y", "ordinal", n_boot=n_boot)
            table = table.join(ci.select(*keys, F.col("ci_low").alias(f"{name}_ci_low"), F.col("ci_high").alias(f"{name}_ci_high")), keys, "left")
    return table


def contrast_metrics(rows: DataFrame, metrics: Sequence[str], lower_is_better: Sequence[str], n_boot: int = 0) -> DataFrame:
    """Metric table of the fixed binder contrasts."""
    contrasted = R.contrast_rows(rows)
    keys = ["comparison", "metric"]
    long = M.unpivot_metrics(contrasted, ["comparison", "y", "ordinal"], metrics, lower_is_better)
    table = M.metric_table(long, keys, "score", "y", "ordinal")
    if n_boot:
        for name in ("auroc", "ap"):
            ci = resampling.bootstrap_ci(long, name, keys, "score", "y", "ordinal", n_boot=n_boot)
            table = table.join(ci.select(*keys, F.col("ci_low").alias(f"{name}_ci_low"), F.col("ci_high").alias(f"{name}_ci_high")), keys, "left")
    return table


def confidence_against_quality(
    confidence: DataFrame, rmsd: DataFrame, dockq: DataFrame, *, stratify: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(metric table, bucket table) of predictor confidence against pose quality."""
    joined = R.join_scores(confidence, rmsd, dockq, C.CONFIDENCE_METRICS)
    table = label_metrics(
        joined, R.quality_labels(), C.CONFIDENCE_METRICS, C.CONFIDENCE_LOWER_IS_BETTER,
        stratum="binder_format" if stratify else None,
    )
    return table, M.bucket_summary(joined, "rmsd", C.CONFIDENCE_METRICS, RMSD_BUCKETS)


def with_negatives(real: DataFrame, negatives: DataFrame, metrics: Sequence[str], cutoff: float) -> DataFrame:
    """Near-native real rows (y 1) and negative controls (y 0) in one table."""
    cols = ["ordinal", "binder_format", *metrics]
    usable = negatives.where(nan_to_null("value").isNotNull())
    controls = usable.select("ordinal", "binder_format", *[F.col(f"extras.{m}").alias(m) for m in metrics])
    near = real.where(below("rmsd", cutoff)).select(*cols)
    shift = real.agg(F.coalesce(F.max("ordinal"), F.lit(0)) + 1).scalar()
    return near.withColumn("y", F.lit(1)).unionByName(
        controls.withColumn("ordinal", F.col("ordinal") + shift).withColumn("y", F.lit(0))
    )


def negatives_against_real(
    real: DataFrame, negatives: DataFrame, name: str, *, cutoff: float = 8.0, stratify: bool = False, n_boot: int = 0
) -> DataFrame:
    """Metric table of near-native complexes against one kind of negative control."""
    rows = with_negatives(real, negatives, C.CONFIDENCE_METRICS, cutoff)
    return label_metrics(
        rows.withColumnRenamed("y", "__y"), {name: F.col("__y")}, C.CONFIDENCE_METRICS, C.CONFIDENCE_LOWER_IS_BETTER,
        stratum="binder_format" if stratify else None, n_boot=n_boot,
    )


def loo_logistic(
    rows: DataFrame,
    label: str,
    feature_sets: Sequence[tuple[str, Sequence[str]]],
    lower_is_better: Sequence[str],
    *,
    l2: float = 1.0,
) -> DataFrame:
    """Leave-one-out metrics per feature set with the full model on the unscaled features.

    Features are sign-flipped like the metrics.  Below three rows or with one class nothing is fitted.
    """
    names = sorted({f for _, fs in feature_sets for f in fs})
    flipped = rows.select("ordinal", label, *[oriented(F.lit(f), f, lower_is_better).alias(f) for f in names]).persist()
    spark = rows.sparkSession
    out = []
    for name, features in feature_sets:
        usable = flipped.where(all_finite(features) & F.col(label).isNotNull())
        size = usable.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
        n, p = size["n"], int(size["p"] or 0)
        info = {"feature_set": name, "features": ";".join(features), "l2": l2, "n": n, "n_positive": p, "n_negative": n - p}
        if n < 3 or p == 0 or p == n:
            empty = spark.createDataFrame([(name,)], "feature_set string")
            blank = ["spearman_rho", "auroc", "ap", "intercept"]
            row = empty.select("feature_set", *[F.lit(None).cast("double").alias(b) for b in blank], F.lit("{}").alias("coefficients_json"))
        else:
            scored = linear.leave_one_out(usable, [(name, list(features))], label, "ordinal", l2=l2)
            found = M.metric_table(scored, ["feature_set"], "score", "y", "ordinal").select("feature_set", "spearman_rho", "auroc", "ap")
            intercept, coef = linear.raw_scale(linear.fit_full(usable, list(features), label, l2=l2))
            packed = json.dumps(dict(sorted(zip(features, coef, strict=True))))
            row = found.select("*", F.lit(intercept).alias("intercept"), F.lit(packed).alias("coefficients_json"))
        out.append(row.select("*", *[F.lit(v).alias(k) for k, v in info.items() if k != "feature_set"]))
    table = out[0]
    for part in out[1:]:
        table = table.unionByName(part)
    return table


def ablation_sets() -> list[tuple[str, tuple[str, ...]]]:
    """Eleven single metrics, every PAE with every pLDDT, and the default set."""
    singles = [("single", (m,)) for m in C.CONFIDENCE_METRICS]
    pairs = [("pae_plddt_pair", (a, b)) for a in C.CONFIDENCE_LOWER_IS_BETTER for b in C.PLDDT_METRICS]
    named = [*singles, *pairs, ("default_all", C.DEFAULT_LOGISTIC_FEATURES)]
    return [(f"{kind}:{';'.join(fs)}", fs) for kind, fs in named]


def structural_against_quality(structural: DataFrame, rmsd: DataFrame) -> DataFrame:
    """Structural metrics against the quality labels; a missing DockQ counts as not accepted."""
    quality = R.last_wins(rmsd, ["example_id"], "ordinal").select(
        "example_id", F.col("value").alias("rmsd"), F.col("extras.dockq_best").alias("dockq_best")
    )
    rows = structural_columns(structural).join(quality, "example_id")
    table = label_metrics(
        rows, R.quality_labels(missing_dockq_negative=True), C.STRUCTURE_METRICS, C.STRUCTURE_LOWER_IS_BETTER
    )
    return table.withColumnRenamed("label", "comparison").drop("stratum")


def structural_columns(scores: DataFrame) -> DataFrame:
    """Wide structural metrics of a score table read with the structural keys."""
    metrics = [m for m in C.STRUCTURE_METRICS if m != "value"]
    return scores.select(
        "example_id", "label", "ordinal", nan_to_null("value").alias("value"),
        *[F.col(f"extras.{m}").alias(m) for m in metrics], F.col("extras.atom_close_contact_fraction_3a").alias("__close"),
    ).drop("__close")


def value_or_extra(key: str, value_key: str = "iptm") -> Column:
    """A metric of a score row: ``value`` holds one of them, the extras the others; NaN is undefined."""
    return nan_to_null("value") if key == value_key else nan_to_null(f"extras.{key}")


def confidence_columns(scores: DataFrame, metrics: Sequence[str] = C.CONFIDENCE_METRICS) -> DataFrame:
    """Wide confidence metrics of a score table whose ``value`` is the interface score."""
    return scores.select("example_id", "label", "ordinal", *[value_or_extra(m).alias(m) for m in metrics])


def champloo_structural_rows(structural: DataFrame, cells: DataFrame) -> DataFrame:
    """Structural rows with their matrix score; missing predictions and unknown pairs are dropped."""
    keyed = structural.where(F.coalesce("missing", F.lit("")) != "prediction").withColumn("__p", pair_parts("example_id"))
    left = keyed.select("*", F.col("__p.left").alias("vhh_pdb"), F.col("__p.right").alias("antigen_pdb")).drop("__p")
    scores = cells.select(
        F.upper(F.trim("row_key")).alias("vhh_pdb"), F.upper(F.trim("col_key")).alias("antigen_pdb"), F.col("value").alias("iptm")
    )
    features = [f for f in C.STRUCTURE_FEATURES]
    joined = left.join(scores, ["vhh_pdb", "antigen_pdb"])
    cognate = (F.upper(F.trim("label")) == "COGNATE").cast("int")
    return joined.select(
        F.col("example_id").alias("pair_id"), "vhh_pdb", "antigen_pdb", cognate.alias("label"), "ordinal", "iptm",
        *[oriented(F.lit(f), F.col(f"extras.{f}"), C.STRUCTURE_MODEL_LOWER_IS_BETTER).alias(f) for f in features],
    )


def classifier_grid(
    pairs: DataFrame, models: Mapping[str, Sequence[str]], raw: Sequence[str], predictor: str, *, n_splits: int, seed: int, l2: float
) -> DataFrame:
    """Raw scores and logistic models under the three grouped splits, one metric row each."""
    rows = pairs.persist()
    long = None
    for name in raw:
        part = rows.select(
            F.lit("all").alias("split"), F.lit(f"raw_{name}").alias("model"), F.lit(name).alias("features"),
            F.col(name).cast("double").alias("score"), F.col("label").alias("y"), "ordinal",
        )
        long = part if long is None else long.unionByName(part)
    for split, group in (("random_pair", "pair_id"), ("held_out_vhh", "vhh_pdb"), ("held_out_antigen", "antigen_pdb")):
        folded = sampling.assign_folds(rows, group, n_splits=n_splits, seed=seed)
        for model, features in models.items():
            scored = linear.out_of_fold(folded, list(features), "label", "fold", l2=l2)
            part = scored.select(
                F.lit(split).alias("split"), F.lit(model).alias("model"), F.lit(";".join(features)).alias("features"),
                F.col("oof").alias("score"), F.col("label").alias("y"), "ordinal",
            )
            long = long.unionByName(part)
    keys = ["split", "model", "features"]
    table = M.metric_table(long, keys, "score", "y", "ordinal").withColumn("predictor", F.lit(predictor))
    return table.orderBy(R.order_rank("split", C.SPLIT_ORDER), "model")
