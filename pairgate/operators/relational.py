"""Joins, picks, label rules and leaderboards on plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.functions.numeric import below, is_finite, nan_to_null, to_double, to_int_or_zero


class LeakageError(ValueError):
    """Raised when evaluation rows also occur in the training set."""


def _pick(df: DataFrame, keys: Sequence[str], ordinal: str, last: bool, count: str | None) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    choose = F.max_by if last else F.min_by
    # The aggregate combines on the map side, so a hot key shuffles one row per task.
    aggs = [choose(F.struct(*rest), F.col(ordinal)).alias("__row")]
    if count is not None:
        aggs.append(F.count(F.lit(1)).alias(count))
    picked = df.groupBy(*keys).agg(*aggs)
    out = [*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]]
    return picked.select(*out, *([count] if count is not None else []))


def first_wins(df: DataFrame, keys: Sequence[str], ordinal: str, count: str | None = None) -> DataFrame:
    """One row per key, the earliest by ordinal; optionally how many rows it stands for."""
    return _pick(df, keys, ordinal, False, count)


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str, count: str | None = None) -> DataFrame:
    """One row per key, the latest by ordinal."""
    return _pick(df, keys, ordinal, True, count)


def first_seen(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """Distinct values with the ordinal at which each was first seen."""
    return df.groupBy(column).agg(F.min(ordinal).alias(ordinal))


def strict_lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Left join that raises at run time for a row without a match in ``dim``."""
    marked = df.join(dim.withColumn("__hit", F.lit(True)), list(keys), "left")
    key_text = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    found = F.when(F.col("__hit"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"no {what} for "), key_text))
    )
    return marked.where(found).drop("__hit")


def members_of(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys occur in ``other``."""
    return df.join(other.select(*keys), list(keys), "left_semi")


def absent_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys do not occur in ``other``."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def shared_keys(eval_rows: DataFrame, train_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct evaluation keys that training has too."""
    return members_of(eval_rows, train_rows, keys).select(*keys).distinct()


def two_sided_lookup(df: DataFrame, dim: DataFrame, key: str, sides: dict[str, dict[str, str]]) -> DataFrame:
    """Look both ends of a pair up in one table: ``sides`` maps a column of ``df`` to the columns of
    ``dim`` it fetches and their new names.  Rows without a match on a side are dropped."""
    for column, fetched in sides.items():
        side = dim.select(F.col(key).alias(column), *[F.col(c).alias(n) for c, n in fetched.items()])
        df = df.join(side, column)
    return df


def leakage_guard(eval_rows: DataFrame, train_rows: DataFrame, keys: Sequence[str]) -> None:
    """Raise when any evaluation key is present among the training keys."""
    found = shared_keys(eval_rows, train_rows, keys).limit(5).collect()
    if found:
        raise LeakageError(f"evaluation rows present in training, e.g. {[tuple(r) for r in found]}")


def join_scores(
    confidence: DataFrame, reference: DataFrame, quality: DataFrame, metrics: Sequence[str]
) -> DataFrame:
    """confidence join reference left-join quality on example_id, last duplicate winning.

    Rows without a headline confidence or reference value are dropped before the join.
    """
    conf = last_wins(confidence, ["example_id"], "ordinal").where(nan_to_null("value").isNotNull())
    ref = last_wins(reference, ["example_id"], "ordinal").where(nan_to_null("value").isNotNull())
    qual = last_wins(quality, ["example_id"], "ordinal")
    fmt = F.coalesce(F.nullif("c.binder_format", F.lit("")), F.nullif("r.binder_format", F.lit("")), F.lit(""))
    return (
        conf.alias("c")
        .join(ref.alias("r"), "example_id")
        .join(qual.alias("q"), "example_id", "left")
        .select(
            "example_id",
            F.col("c.ordinal").alias("ordinal"),
            *[F.col(f"c.extras.{m}").alias(m) for m in metrics],
            F.col("r.value").alias("rmsd"),
            F.col("q.extras.dockq_best").alias("dockq_best"),
            fmt.alias("binder_format"),
        )
    )


def quality_labels(
    rmsd: str = "rmsd", dockq: str = "dockq_best", *, missing_dockq_negative: bool = False
) -> dict[str, Column]:
    """The three pose-quality labels; a missing DockQ is no label, or a negative if asked."""
    score = nan_to_null(dockq)
    accepted = (score >= F.lit(C.DOCKQ_ACCEPTABLE)).cast("int")
    return {
        "rmsd<4A": below(rmsd, 4.0).cast("int"),
        "rmsd<8A": below(rmsd, 8.0).cast("int"),
        "dockq_best>=0.23": F.coalesce(accepted, F.lit(0)) if missing_dockq_negative else accepted,
    }


def near_native_label(is_real: Column, rmsd: str, cutoff: float) -> Column:
    """1 for a near-native real row, NULL for any other real row, 0 for a negative control."""
    return F.when(~is_real, F.lit(0)).when(below(rmsd, cutoff), F.lit(1))


# Fixed contrasts: name, positive labels, negative labels.
BINDER_CONTRASTS = (
    ("POS_vs_all_negatives", ("POS",), ("SCR", "OFF")),
    ("POS_vs_SCR", ("POS",), ("SCR",)),
    ("POS_vs_OFF", ("POS",), ("OFF",)),
)


def contrast_rows(
    df: DataFrame,
    label: str = "label",
    contrasts: Sequence[tuple[str, Sequence[str], Sequence[str]]] = BINDER_CONTRASTS,
) -> DataFrame:
    """Each row once per contrast it belongs to, with the contrast's name and 0/1 label."""
    entries = []
    for name, positives, negatives in contrasts:
        y = F.when(F.col(label).isin(list(positives)), 1).when(F.col(label).isin(list(negatives)), 0)
        entries.append(F.when(y.isNotNull(), F.struct(F.lit(name).alias("comparison"), y.alias("y"))))
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.withColumn("__c", F.explode(kept)).select("*", "__c.comparison", "__c.y").drop("__c")


def label_rows(df: DataFrame, labels: Mapping[str, Column], name: str = "label") -> DataFrame:
    """Each row once per named label that is defined for it."""
    entries = [
        F.when(y.isNotNull(), F.struct(F.lit(key).alias(name), y.cast("int").alias("y")))
        for key, y in labels.items()
    ]
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.withColumn("__l", F.explode(kept)).select("*", f"__l.{name}", "__l.y").drop("__l")


def keep_included(flag: str = "is_excluded") -> Column:
    """Only an explicit FALSE keeps the row."""
    return F.coalesce(F.upper(F.trim(flag)) == "FALSE", F.lit(False))


def keep_not_excluded(flag: str = "is_excluded") -> Column:
    """Everything but an explicit TRUE keeps the row."""
    return F.coalesce(F.upper(F.trim(flag)), F.lit("")) != "TRUE"


def unpivot_matrix(df: DataFrame, row_key: str, columns: Sequence[str]) -> DataFrame:
    """Square matrix to (row_key, col_key, value); blank and unreadable cells are dropped."""
    cells = df.select(row_key, *[to_double(F.col(f"`{c}`")).alias(c) for c in columns])
    # unpivot is one expand over the scanned row: no join and no shuffle.
    return (
        cells.unpivot([row_key], [F.col(f"`{c}`") for c in columns], "col_key", "value")
        .withColumnRenamed(row_key, "row_key")
        .where(F.col("value").isNotNull())
    )


def matrix_pairs(cells: DataFrame, meta: DataFrame, key: str, row_meta: Mapping[str, str], col_meta: Mapping[str, str]) -> DataFrame:
    """Matrix cells whose row and column are both described; label 1 on the diagonal.

    Starting from the filled cells, two equi-joins replace a cross product of the keys.
    """
    rows = meta.select(F.col(key).alias("row_key"), *[F.col(c).alias(a) for c, a in row_meta.items()])
    cols = meta.select(F.col(key).alias("col_key"), *[F.col(c).alias(a) for c, a in col_meta.items()])
    return (
        cells.join(rows, "row_key")
        .join(cols, "col_key")
        .select(
            F.concat("row_key", F.lit("__"), "col_key").alias("pair_id"),
            F.col("row_key").alias("vhh_pdb"),
            F.col("col_key").alias("antigen_pdb"),
            (F.col("row_key") == F.col("col_key")).cast("int").alias("label"),
            "value",
            *row_meta.values(),
            *col_meta.values(),
        )
    )


def overlapping_ids(members: DataFrame, cluster: str = "cluster", origin: str = "origin") -> DataFrame:
    """Ids of the 'eval' origin whose cluster also holds a 'train' member."""
    trained = members.where(F.col(origin) == "train").select(cluster).distinct()
    return members.where(F.col(origin) == "eval").join(trained, cluster, "left_semi")


def family_candidates(
    table: DataFrame, family: str, metrics: Sequence[str], source: str, *, totals_only: bool
) -> DataFrame:
    """Leaderboard candidates of one metric family out of a text metric table."""
    have = set(table.columns)

    def text(*names: str) -> Column:
        present = [F.nullif(F.col(n), F.lit("")) for n in names if n in have]
        return F.coalesce(*present, F.lit("")) if present else F.lit("")

    rows = table
    if totals_only and "stratum" in have:
        rows = rows.where(F.coalesce("stratum", F.lit("all")) == "all")
    auroc, ap = to_double(text("auroc")), to_double(text("ap"))
    n, n_positive = to_int_or_zero(text("n")), to_int_or_zero(text("n_positive"))
    baseline = to_double(text("baseline_ap"))
    baseline = F.when(is_finite(baseline), baseline).otherwise(
        F.try_divide(n_positive.cast("double"), n.cast("double"))
    )
    return rows.select(
        text("comparison", "label").alias("comparison"),
        F.lit(family).alias("family"),
        F.lit(source).alias("source_table"),
        text("metric", "model").alias("best_metric"),
        n.alias("n"),
        n_positive.alias("n_positive"),
        to_int_or_zero(text("n_negative")).alias("n_negative"),
        baseline.alias("baseline_ap"),
        auroc.alias("auroc"),
        ap.alias("ap"),
    ).where(
        F.col("best_metric").isin(list(metrics)) & (F.col("comparison") != "") & is_finite("auroc") & is_finite("ap")
    )


def best_per_group(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The candidate with the highest (ap, auroc, metric name) of each group, sorted by group."""
    rest = [c for c in candidates.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("ap", "auroc", "best_metric")).alias("__row")
    picked = candidates.groupBy(*keys).agg(best)
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).orderBy(*keys)


def order_rank(column: str, order: Mapping[str, int], unknown: int = 99) -> Column:
    """Position of a value in a custom order; unlisted values sort last."""
    rank = F.lit(unknown)
    for value, position in order.items():
        rank = F.when(F.col(column) == value, F.lit(position)).otherwise(rank)
    return rank


def combine_predictor_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of classifier tables in predictor, split, model order."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged.orderBy("predictor", order_rank("split", C.SPLIT_ORDER), order_rank("model", C.MODEL_ORDER))


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows per group, ranked 1..k.

    Spark keeps only k rows per group and task before the shuffle (window group limit), so a hot
    group moves k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def proportional_quotas(sizes: Mapping[str, int], n: int) -> dict[str, int]:
    """Quota per stratum: its rounded share, at least one for each that has rows, ``n`` in all.

    An excess comes off the largest quotas, as if a water level sank over them: all quotas above
    the level are cut down to it, and what that takes too much the last of them get back.  What is
    missing goes to the largest stratum.
    """
    whole = sum(sizes.values())
    if whole == 0:
        return {}
    names = list(sizes)
    wish = np.array([max(min(1, sizes[k]), round(n * sizes[k] / whole)) for k in names])
    excess = int(wish.sum()) - n
    if excess > 0:
        levels = np.arange(wish.max() + 1)
        removed = np.maximum(wish[None, :] - levels[:, None], 0).sum(axis=1)
        level = int(levels[removed >= excess].max())
        spare = int(removed[level]) - excess
        high = np.flatnonzero(wish > level)
        wish = np.minimum(wish, level)
        wish[high[len(high) - spare :]] += 1
    elif excess < 0:
        wish[int(np.argmax([sizes[k] for k in names]))] -= excess
    return {k: int(v) for k, v in zip(names, wish, strict=True)}


def quota_head(df: DataFrame, stratum: str, ordinal: str, n: int, quotas: Mapping[str, int] | None = None) -> DataFrame:
    """The first rows of every stratum up to its quota."""
    if quotas is None:
        counted = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("c"), F.min(ordinal).alias("o"))
        sizes = {r[stratum]: r["c"] for r in counted.orderBy("o").collect()}
        quotas = proportional_quotas(sizes, n)
    if not quotas:
        return df.limit(0)
    limit = F.lit(0)
    for name, quota in quotas.items():
        limit = F.when(F.col(stratum) == name, F.lit(quota)).otherwise(limit)
    top = top_k_per_group(df, [stratum], [F.col(ordinal)], max(max(quotas.values()), 1))
    return top.where(F.col("rank") <= limit).drop("rank")


def near_then_far(df: DataFrame, n: int, rmsd: str = "rmsd", tie: str = "example_id") -> DataFrame:
    """The n best rows: near-native first, then by rmsd and id."""
    near = below(rmsd, C.NEAR_NATIVE_RMSD)
    return df.orderBy(near.desc(), F.col(rmsd).asc_nulls_last(), tie).limit(n)


def round_robin(df: DataFrame, index: str, shards: int) -> DataFrame:
    if shards < 1:
        raise ValueError(f"shards must be at least 1, got {shards}")
    return df.withColumn("shard", F.pmod(F.col(index), F.lit(shards)).cast("int"))


def chunked(df: DataFrame, index: str, size: int) -> DataFrame:
    """Task number of every row when consecutive rows are cut into chunks."""
    return df.withColumn("task", F.floor(F.col(index) / F.lit(size)).cast("int"))


def failure_rate(ok: str) -> Column:
    """Share of rows whose flag is below one half; NULL without rows."""
    return F.lit(1.0) - F.avg((F.col(ok) >= 0.5).cast("double"))
