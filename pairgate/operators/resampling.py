"""Class-stratified bootstrap confidence intervals, also paired between two score columns.

One method for every size.  Rates at a threshold need only counts: a resampled class has a
binomial (paired: multinomial) number of calls.  AUROC and average precision resample rows without
bringing them together: rows are merged to counts per distinct (scores, label) and hashed to
blocks; each replicate first splits its class total over the blocks by one multinomial on the block
sizes, then inside a block over its rows, which together is exactly a draw of n rows with
replacement.  A replicate's statistic is then summed over order buckets of the scores, as in
``ordered``.

The point estimates are those of ``metrics`` on the same rows: threshold statistics take every row
with a label (an undefined score is not called, an infinite one is), ranking statistics the rows
with a finite score.  In a replicate of average precision, equal scores put positives first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairgate.functions.numeric import at_least, is_finite
from pairgate.operators.metrics import auroc, average_precision
from pairgate.operators.ordered import place, plan_cuts
from pairgate.operators.statistics import Statistic
from pairgate.session import cut_lineage

REPLICATES_PER_TASK = 50
ROWS_PER_BLOCK = 50_000
ROWS_PER_ARM_BUCKET = 100_000


def _rate(numerator: float, denominator: float) -> float:
    return float(numerator) / float(denominator) if denominator else np.nan


RANKING = ("auroc", "ap")
RATES = ("recall", "specificity", "precision")


def check_statistic(name: str, threshold: float | None) -> None:
    if name not in RANKING and not (name in RATES and threshold is not None):
        raise ValueError(f"unknown statistic {name!r}")


def _rows(
    df: DataFrame, keys: Sequence[str], scores: Sequence[str], label: str, ordinal: str, threshold: float | None
) -> DataFrame:
    """(keys, y, s*, o): scores, or with a threshold the calls (1 or 0) made at it."""
    usable = F.col(label).isNotNull()
    if threshold is None:
        for s in scores:
            usable = usable & is_finite(s)
        values = [(F.col(s).cast("double") + 0.0) for s in scores]
    else:
        values = [at_least(s, threshold).cast("double") for s in scores]
    return df.where(usable).select(
        *keys,
        F.col(label).cast("int").alias("y"),
        *[v.alias(f"s{i}") for i, v in enumerate(values)],
        F.col(ordinal).cast("long").alias("o"),
    )


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def _seeded(seed: int, *parts) -> np.random.Generator:
    """Generator that depends only on the seed and the parts, not on task or attempt."""
    return np.random.default_rng([seed, *[zlib.crc32(repr(p).encode()) for p in parts]])


def _threshold_draws(rows: DataFrame, keys: Sequence[str], name: str, n_boot: int, seed: int) -> DataFrame:
    """Threshold rates need four counts: resampled classes have binomial numbers of calls."""
    called = F.col("s0") == 1.0
    counts = rows.groupBy(*keys).agg(
        F.count_if(called & (F.col("y") == 1)).alias("tp"),
        F.count_if(called & (F.col("y") == 0)).alias("fp"),
        F.count_if(F.col("y") == 1).alias("P"),
        F.count_if(F.col("y") == 0).alias("N"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                rng = _seeded(seed, *[r[k] for k in keys])
                tp = rng.binomial(r["P"], r["tp"] / r["P"], n_boot) if r["P"] else np.zeros(n_boot)
                fp = rng.binomial(r["N"], r["fp"] / r["N"], n_boot) if r["N"] else np.zeros(n_boot)
                rates = {
                    "recall": lambda t, f: _rate(t, r["P"]),
                    "specificity": lambda t, f: _rate(r["N"] - f, r["N"]),
                    "precision": lambda t, f: _rate(t, t + f),
                }
                fn = rates[name]
                found = [v for v in map(fn, tp, fp) if np.isfinite(v)]
                out.append({**{k: r[k] for k in keys}, "point": fn(r["tp"], r["fp"]), "v": found})
            yield pd.DataFrame(out, columns=[*keys, "point", "v"])

    return counts.mapInPandas(run, f"{_key_ddl(rows, keys)}point double, v array<double>")


def _weights(rows: DataFrame, keys: Sequence[str], arms: int, n_boot: int, seed: int) -> DataFrame:
    """(keys, y, s*, chunk, w): resampled count of each merged row, per chunk of replicates.

    Chunk -1 holds the original counts, as if they were one more replicate.
    """
    scores = [f"s{i}" for i in range(arms)]
    blocks = max(8, rows.count() // ROWS_PER_BLOCK)
    unit = rows.groupBy(*keys, "y", *scores).agg(F.count(F.lit(1)).alias("c"))
    unit = unit.withColumn("block", F.pmod(F.xxhash64(*scores), F.lit(blocks)).cast("int"))
    group = [*keys, "y"]
    chunks = -(-n_boot // REPLICATES_PER_TASK)
    chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    sizes = unit.groupBy(*group, "block").agg(F.sum("c").alias("c")).select("*", chunk)

    def split(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        c, k = g["c"].to_numpy(), int(g["chunk"].iloc[0])
        reps = min(REPLICATES_PER_TASK, n_boot - k * REPLICATES_PER_TASK)
        rng = _seeded(seed, "blocks", k, *[g[x].iloc[0] for x in group])
        m = rng.multinomial(c.sum(), c / c.sum(), size=reps)
        return g[[*group, "block", "chunk"]].assign(m=[col.tolist() for col in m.T])

    ddl = _key_ddl(rows, group)
    drawn = sizes.groupBy(*group, "chunk").applyInPandas(split, f"{ddl}block int, chunk int, m array<long>")
    on = [*group, "block", "chunk"]

    def inside(u: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        u = u.sort_values(scores)
        c, m = u["c"].to_numpy(), d["m"].iloc[0]
        rng = _seeded(seed, "rows", *[u[x].iloc[0] for x in on])
        w = np.stack([rng.multinomial(int(k), c / c.sum()) for k in m])
        return u[[*group, *scores, "chunk"]].assign(w=[col.tolist() for col in w.T])

    score_ddl = "".join(f"{s} double, " for s in scores)
    resampled = unit.select("*", chunk).groupBy(*on).cogroup(drawn.groupBy(*on)).applyInPandas(
        inside, f"{ddl}{score_ddl}chunk int, w array<long>"
    )
    original = unit.select(*group, *scores, F.lit(-1).alias("chunk"), F.array("c").alias("w"))
    return resampled.unionByName(original)


def _arm_statistic(weighted: DataFrame, keys: Sequence[str], arm: int, name: str, rows_per_bucket: int) -> DataFrame:
    """(keys, chunk, rep, value): the statistic of one score column for every replicate."""
    s = f"s{arm}"
    down = weighted.select(*keys, "chunk", "y", (-F.col(s)).alias("down"), "w")
    cuts = plan_cuts(down.where("chunk = -1"), "down", None, rows_per_bucket)
    placed = place(down, "down", None, cuts).drop("__tie_bucket")
    bucket = [*keys, "chunk", "__order_bucket"]
    ddl = _key_ddl(weighted, keys) + "chunk int, `__order_bucket` int, "
    merged = placed.select(*bucket, "down", "y", F.posexplode("w").alias("rep", "k")).where("k > 0")
    totals = merged.groupBy(*bucket, "rep").agg(
        F.sum(F.when(F.col("y") == 1, F.col("k")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("y") == 0, F.col("k")).otherwise(0)).alias("n"),
    )
    w = Window.partitionBy(*keys, "chunk", "rep").orderBy("__order_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Renamed to themselves: both sides of the cogroup come from ``placed``.
    offsets = totals.select(
        *[F.col(c).alias(c) for c in bucket], "rep", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}0") for c in ("p", "n")]
    )

    def run(u: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        u = u.sort_values("down")
        w_all, y = np.stack(u["w"].to_numpy()), u["y"].to_numpy()
        ends = np.flatnonzero(np.append(np.diff(u["down"].to_numpy()) != 0, True))
        starts = np.append(0, ends[:-1] + 1)
        out = []
        for r in o.itertuples(index=False):
            k = w_all[:, r.rep].astype(float)
            p = np.add.reduceat(np.where(y == 1, k, 0.0), starts)
            n = np.add.reduceat(np.where(y == 0, k, 0.0), starts)
            p_above, n_above = r.p0 + np.cumsum(p) - p, r.n0 + np.cumsum(n) - n
            # Pairs won by the negatives above a positive, and precision at every positive.
            lost = float((p * (n_above + n / 2.0)).sum())
            hits = 0.0
            if name == "ap":
                # Equal scores: resampled positives come before negatives.
                which = np.repeat(np.arange(len(p)), p.astype(int))
                nth = np.arange(len(which)) - np.repeat(np.cumsum(p) - p, p.astype(int)) + 1
                tp = p_above[which] + nth
                hits = float((tp / (tp + n_above[which])).sum())
            out.append((r.rep, p.sum(), n.sum(), lost, hits))
        part = pd.DataFrame(out, columns=["rep", "p", "n", "lost", "hits"])
        for x in bucket:
            part[x] = u[x].iloc[0]
        return part[[*bucket, "rep", "p", "n", "lost", "hits"]]

    schema = f"{ddl}rep int, p double, n double, lost double, hits double"
    parts = placed.groupBy(*bucket).cogroup(offsets.groupBy(*bucket)).applyInPandas(run, schema)
    sums = parts.groupBy(*keys, "chunk", "rep").agg(*[F.sum(c).alias(c) for c in ("p", "n", "lost", "hits")])
    if name == "ap":
        value = F.when(F.col("p") > 0, F.col("hits") / F.col("p"))
    else:
        value = F.when((F.col("p") > 0) & (F.col("n") > 0), F.lit(1.0) - F.col("lost") / (F.col("p") * F.col("n")))
    return sums.select(*keys, "chunk", "rep", value.alias(f"v{arm}"))


def _given_statistic(
    weighted: DataFrame, keys: Sequence[str], arm: int, statistic: Statistic, rows_per_bucket: int
) -> DataFrame:
    """(keys, chunk, rep, value): a caller's statistic of one score column for every replicate."""
    s = f"s{arm}"
    rows = weighted.select(*keys, "chunk", "y", s, "w")
    cuts = plan_cuts(rows.where("chunk = -1"), s, None, rows_per_bucket)
    placed = place(rows, s, None, cuts).drop("__tie_bucket")
    group, bucket = [*keys, "chunk"], [*keys, "chunk", "__order_bucket"]
    ddl = _key_ddl(weighted, keys)
    drawn = placed.select(*bucket, "y", F.posexplode("w").alias("rep", "k"))
    sums = drawn.groupBy(*bucket, "rep").agg(
        *[F.sum(F.when(F.col("y") == y, F.col("k")).otherwise(0)).cast("double").alias(f"w{y}") for y in (0, 1)]
    )
    order = Window.partitionBy(*group, "rep").orderBy("__order_bucket")
    earlier, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group, "rep")
    # Renamed to themselves: both sides of the cogroup come from ``placed``.
    known = sums.select(
        *[F.col(c).alias(c) for c in bucket],
        "rep",
        *[F.coalesce(F.sum(f"w{y}").over(earlier), F.lit(0.0)).alias(f"b{y}") for y in (0, 1)],
        *[F.sum(f"w{y}").over(everything).alias(f"t{y}") for y in (0, 1)],
    )
    states = [f"z{k}" for k in range(statistic.size)]

    def run(u: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        u, o = u.sort_values(s), o.sort_values("rep")
        weight = np.stack(u["w"].to_numpy()).astype(float)
        found = statistic.update(
            u[s].to_numpy(), u["y"].to_numpy(), weight, o[["b0", "b1"]].to_numpy(), o[["t0", "t1"]].to_numpy()
        )
        out = o[["rep", "t0", "t1"]].assign(**{z: found[:, k] for k, z in enumerate(states)})
        for x in group:
            out[x] = u[x].iloc[0]
        return out[[*group, "rep", "t0", "t1", *states]]

    numbers = "".join(f", {c} double" for c in ("t0", "t1", *states))
    parts = placed.groupBy(*bucket).cogroup(known.groupBy(*bucket)).applyInPandas(run, f"{ddl}chunk int, rep int{numbers}")
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    merged = parts.groupBy(*group, "rep", "t0", "t1").agg(*[how[m](z).alias(z) for m, z in zip(statistic.merge, states, strict=True)])

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = statistic.finish(batch[states].to_numpy(), batch[["t0", "t1"]].to_numpy())
            yield batch[[*group, "rep"]].assign(value=value)

    values = merged.mapInPandas(finished, f"{ddl}chunk int, rep int, value double")
    return values.select(*group, "rep", F.when(~F.isnan("value"), F.col("value")).alias(f"v{arm}"))


def _given(rows: DataFrame, keys: Sequence[str], statistic: Statistic, arms: int, n_boot: int, seed: int, rows_per_bucket: int) -> DataFrame:
    """(keys, point, v) of a caller's statistic: the replicates and, as chunk -1, the rows themselves."""
    weighted = cut_lineage(_weights(rows, keys, arms, n_boot, seed))
    values = _given_statistic(weighted, keys, 0, statistic, rows_per_bucket)
    for arm in range(1, arms):
        values = values.join(_given_statistic(weighted, keys, arm, statistic, rows_per_bucket), [*keys, "chunk", "rep"])
    delta = F.col("v0") - F.col("v1") if arms == 2 else F.col("v0")
    return values.groupBy(*keys).agg(
        F.max(F.when(F.col("chunk") == -1, delta)).alias("point"), F.collect_list(F.when(F.col("chunk") >= 0, delta)).alias("v")
    )


def _distributed(rows: DataFrame, keys: Sequence[str], name: str, arms: int, n_boot: int, seed: int, rows_per_bucket: int) -> DataFrame:
    weighted = cut_lineage(_weights(rows, keys, arms, n_boot, seed))
    values = _arm_statistic(weighted, keys, 0, name, rows_per_bucket)
    for arm in range(1, arms):
        values = values.join(_arm_statistic(weighted, keys, arm, name, rows_per_bucket), [*keys, "chunk", "rep"])
    delta = F.col("v0") - F.col("v1") if arms == 2 else F.col("v0")
    draws = F.collect_list(F.when(F.col("chunk") >= 0, delta)).alias("v")  # n_boot numbers
    return values.groupBy(*keys).agg(draws).join(_points(rows, keys, name, arms), list(keys)).select(*keys, "point", "v")


def _points(rows: DataFrame, keys: Sequence[str], name: str, arms: int) -> DataFrame:
    """(keys, point): the statistic of the rows themselves, as ``metrics`` defines it."""
    found = None
    for arm in range(arms):
        s = f"s{arm}"
        one = auroc(rows, keys, s, "y") if name == "auroc" else average_precision(rows, keys, s, "y", "o")
        one = one.select(*keys, F.col(name).alias(f"p{arm}"))
        found = one if found is None else found.join(one, list(keys))
    point = F.col("p0") - F.col("p1") if arms == 2 else F.col("p0")
    return found.select(*keys, point.alias("point"))


def _interval(found: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """Percentile interval with linear interpolation between order statistics."""
    ordered = F.array_sort("v")
    m = F.size("v")

    def quantile(q: float):
        at = F.lit(q) * (m - 1)
        low = F.floor(at).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, m - 1))
        return F.when(m > 0, a + (b - a) * (at - low))

    defined = F.when(~F.isnan("point"), F.col("point"))
    return found.select(*keys, defined.alias("point"), quantile(alpha / 2).alias("ci_low"), quantile(1 - alpha / 2).alias("ci_high"))


def _bootstrap(df, keys, scores, label, ordinal, name, threshold, n_boot, seed, alpha, rows_per_bucket):
    if isinstance(name, str):
        check_statistic(name, threshold)
    if not keys:
        whole = df.withColumn("__all", F.lit(0))
        found = _bootstrap(whole, ["__all"], scores, label, ordinal, name, threshold, n_boot, seed, alpha, rows_per_bucket)
        return found.drop("__all")
    if not isinstance(name, str):
        draws = _given(_rows(df, keys, scores, label, ordinal, None), keys, name, len(scores), n_boot, seed, rows_per_bucket)
    elif name in RANKING:
        rows = _rows(df, keys, scores, label, ordinal, None)
        draws = _distributed(rows, keys, name, len(scores), n_boot, seed, rows_per_bucket)
    else:
        rows = _rows(df, keys, scores, label, ordinal, threshold)
        draw = _threshold_draws if len(scores) == 1 else _paired_rates
        draws = draw(rows, keys, name, n_boot, seed)
    return _interval(draws, keys, alpha)


def _paired_rates(flags: DataFrame, keys: Sequence[str], name: str, n_boot: int, seed: int) -> DataFrame:
    """Delta of a threshold rate from the counts of each (label, call, call) pattern."""
    patterns = [(y, a, b) for y in (0, 1) for a in (0.0, 1.0) for b in (0.0, 1.0)]
    counts = flags.groupBy(*keys).agg(
        *[F.count_if((F.col("y") == y) & (F.col("s0") == a) & (F.col("s1") == b)).alias(f"c{i}") for i, (y, a, b) in enumerate(patterns)]
    )
    y = np.array([p[0] for p in patterns])

    def rate(c: np.ndarray) -> float:
        out = []
        for arm in (1, 2):
            hit = np.array([p[arm] for p in patterns]) == 1.0
            tp, fp = c[hit & (y == 1)].sum(), c[hit & (y == 0)].sum()
            if name == "recall":
                out.append(_rate(tp, c[y == 1].sum()))
            elif name == "specificity":
                out.append(_rate(c[(y == 0)].sum() - fp, c[y == 0].sum()))
            else:
                out.append(_rate(tp, tp + fp))
        return out[0] - out[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                c = np.array([r[f"c{i}"] for i in range(len(patterns))])
                rng = _seeded(seed, *[r[k] for k in keys])
                half = len(patterns) // 2
                draws = [rng.multinomial(p.sum(), p / max(p.sum(), 1), n_boot) for p in (c[:half], c[half:])]
                found = [v for v in map(rate, np.hstack(draws)) if np.isfinite(v)]
                out.append({**{k: r[k] for k in keys}, "point": rate(c), "v": found})
            yield pd.DataFrame(out, columns=[*keys, "point", "v"])

    return counts.mapInPandas(run, f"{_key_ddl(flags, keys)}point double, v array<double>")


def bootstrap_ci(
    df: DataFrame,
    name: str | Statistic,
    keys: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    ordinal: str = "ordinal",
    *,
    threshold: float | None = None,
    n_boot: int = 1000,
    seed: int = 0,
    alpha: float = 0.05,
    rows_per_bucket: int = ROWS_PER_ARM_BUCKET,
) -> DataFrame:
    """(keys, point, ci_low, ci_high) of a statistic; NULL where it is undefined.

    ``name`` is one of the built-in names or a ``statistics.Statistic`` of the caller, which sees the
    rows with a label and a finite score.
    """
    return _bootstrap(df, keys, [score], label, ordinal, name, threshold, n_boot, seed, alpha, rows_per_bucket)


def paired_delta(
    df: DataFrame,
    name: str | Statistic,
    score_a: str,
    score_b: str,
    keys: Sequence[str] = (),
    label: str = "label",
    ordinal: str = "ordinal",
    *,
    threshold: float | None = None,
    n_boot: int = 1000,
    seed: int = 0,
    alpha: float = 0.05,
    rows_per_bucket: int = ROWS_PER_ARM_BUCKET,
) -> DataFrame:
    """Interval of statistic(a) - statistic(b), both arms resampled with the same rows."""
    return _bootstrap(df, keys, [score_a, score_b], label, ordinal, name, threshold, n_boot, seed, alpha, rows_per_bucket)
