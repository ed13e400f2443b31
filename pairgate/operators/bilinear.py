"""Low-rank bilinear logistic model: score = (A u) . (G v) + b for a pair of vectors (u, v).

Full-batch gradient descent with clipped gradients.  Every iteration is one Spark pass, in which
partitions sum their gradients for all models (folds advance together) and only 2 rank d + 1
numbers per model, added up in a few slots, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairgate.operators.linear import _merge, add_arrays, load_json, save_json
from pairgate.operators.metrics import threshold_for_precision


@dataclass(frozen=True)
class BilinearGate:
    """Frozen bilinear model, applied to the concatenation [u | v]."""

    feature_dim: int
    rank: int
    mean_a: list[float]
    std_a: list[float]
    mean_g: list[float]
    std_g: list[float]
    proj_a: list[list[float]]
    proj_g: list[list[float]]
    intercept: float
    threshold: float
    target_precision: float

    def logit(self, x: Column | str) -> Column:
        """Arrow-batched logit of an array column holding [u | v]."""
        d = self.feature_dim
        ma, sa, mg, sg = (np.array(v) for v in (self.mean_a, self.std_a, self.mean_g, self.std_g))
        pa, pg, b = np.array(self.proj_a), np.array(self.proj_g), self.intercept

        @F.pandas_udf(T.DoubleType())
        def score(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), dtype=float).reshape(len(v), 2 * d)
            return pd.Series(_logits((x[:, :d] - ma) / sa, (x[:, d:] - mg) / sg, pa, pg, b))

        return score(F.col(x) if isinstance(x, str) else x)

    def save(self, path: str) -> None:
        save_json(asdict(self), path)

    @classmethod
    def load(cls, path: str) -> BilinearGate:
        return cls(**load_json(path, cls))


@dataclass(frozen=True)
class Training:
    """Hyper-parameters of a fit."""

    rank: int
    l2: float
    lr: float
    n_iter: int
    seed: int
    max_grad_norm: float = 1.0


def _logits(u, v, proj_a, proj_g, intercept):
    return ((u @ proj_a.T) * (v @ proj_g.T)).sum(axis=1) + intercept


def _gradient_sums(u, v, y, proj_a, proj_g, intercept):
    """Summed (not averaged) data gradients of both projections and the intercept."""
    pu, pv = u @ proj_a.T, v @ proj_g.T
    z = np.clip((pu * pv).sum(axis=1) + intercept, -40.0, 40.0)
    residual = 1.0 / (1.0 + np.exp(-z)) - y
    return (residual[:, None] * pv).T @ u, (residual[:, None] * pu).T @ v, float(residual.sum())


class _Descent:
    """Projections and intercept between steps."""

    def __init__(self, d_a: int, d_g: int, t: Training) -> None:
        rng = np.random.default_rng(t.seed)
        self.t = t
        self.a = rng.normal(0.0, 1.0 / math.sqrt(d_a), size=(t.rank, d_a))
        self.g = rng.normal(0.0, 1.0 / math.sqrt(d_g), size=(t.rank, d_g))
        self.b = 0.0

    def step(self, ga: np.ndarray, gg: np.ndarray, gb: float, n: int) -> None:
        ga, gg = self._clipped(ga / n + self.t.l2 * self.a), self._clipped(gg / n + self.t.l2 * self.g)
        self.a = self.a - self.t.lr * ga
        self.g = self.g - self.t.lr * gg
        self.b -= self.t.lr * gb / n

    def _clipped(self, grad: np.ndarray) -> np.ndarray:
        norm = float(np.linalg.norm(grad))
        return grad * (self.t.max_grad_norm / norm) if norm > self.t.max_grad_norm else grad


def pair_rows(df: DataFrame, u: str, v: str, label: str, fold: str | None) -> DataFrame:
    held = F.col(fold).cast("double") if fold else F.lit(None).cast("double")
    return df.where(F.col(label).isNotNull()).select(
        F.concat(F.col(u).cast("array<double>"), F.col(v).cast("array<double>")).alias("x"),
        F.col(label).cast("double").alias("y"),
        held.alias("fold"),
    )


def _fit_rows(rows: DataFrame, held_out: Sequence[float | None], d: int, t: Training, n_parts: int) -> list[tuple]:
    stats = rows.select("fold", "y", F.posexplode("x").alias("j", "v")).groupBy("fold", "j").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.avg("v").alias("m"), F.var_pop("v").alias("s")
    )
    per_fold: dict[float | None, list] = {}
    for r in stats.collect():
        cell = per_fold.setdefault(r["fold"], [r["n"], r["p"], np.zeros(2 * d), np.zeros(2 * d)])
        cell[2][r["j"]], cell[3][r["j"]] = r["m"], r["s"] * r["n"]
    states, scales, sizes = {}, {}, {}
    for k, held in enumerate(held_out):
        kept = [tuple(m) for f, m in per_fold.items() if held is None or f != held]
        if not kept:
            continue
        n, p, mean, ss = _merge(kept)
        if 0 < p < n:
            std = np.sqrt(ss / n)
            states[k], scales[k], sizes[k] = _Descent(d, d, t), (mean, np.where(std == 0, 1.0, std)), n
    for _ in range(t.n_iter):
        current = {k: (held_out[k], *scales[k], s.a, s.g, s.b) for k, s in states.items()}
        for k, v in _gradient_pass(rows, current, d, n_parts).items():
            cut = t.rank * d
            states[k].step(v[:cut].reshape(t.rank, d), v[cut : 2 * cut].reshape(t.rank, d), float(v[-1]), sizes[k])
    return [
        (held_out[k], scales[k][0].tolist(), scales[k][1].tolist(), s.a.ravel().tolist(), s.g.ravel().tolist(), s.b)
        for k, s in states.items()
    ]


def _gradient_pass(rows: DataFrame, models: dict, d: int, n_parts: int) -> dict[int, np.ndarray]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.empty:
                continue
            x = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), 2 * d)
            y, fold = batch["y"].to_numpy(float), batch["fold"].to_numpy(float)
            for k, (held, mean, std, a, g, b) in models.items():
                keep = slice(None) if held is None else fold != held
                z = (x[keep] - mean) / std
                ga, gg, gb = _gradient_sums(z[:, :d], z[:, d:], y[keep], a, g, b)
                v = np.concatenate([ga.ravel(), gg.ravel(), [gb]])
                totals[k] = totals[k] + v if k in totals else v
        if totals:  # a partition may be empty, and Arrow converts no empty column of arrays
            yield pd.DataFrame({"k": list(totals), "v": list(totals.values())})

    return add_arrays(rows.mapInPandas(run, "k int, v array<double>"), n_parts)


def fit(rows: DataFrame, held_out: Sequence[float | None], d: int, training: Training) -> list[tuple]:
    """(held_out, mean, std, a, g, b) per model that saw two classes."""
    cached = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_rows(cached, held_out, d, training, cached.rdd.getNumPartitions())
    finally:
        cached.unpersist()


def _gate(model: tuple, d: int, rank: int, threshold: float, target: float) -> BilinearGate:
    _, mean, std, a, g, b = model
    shape = lambda w: np.array(w).reshape(rank, d).tolist()
    return BilinearGate(
        d, rank, list(mean[:d]), list(std[:d]), list(mean[d:]), list(std[d:]), shape(a), shape(g), float(b), threshold, target
    )


def out_of_fold(
    df: DataFrame, u: str, v: str, label: str, fold: str, d: int, training: Training, *, name: str = "oof"
) -> DataFrame:
    """Add the logit of the model trained on the other folds (NULL when it had one class)."""
    rows = pair_rows(df, u, v, label, fold)
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())
    models = fit(rows, folds, d, training)
    x = F.concat(F.col(u).cast("array<double>"), F.col(v).cast("array<double>"))
    score = F.lit(None).cast("double")
    for m in models:
        logit = _gate(m, d, training.rank, 0.0, 0.0).logit(x)
        score = F.when(F.col(fold).cast("double") == F.lit(m[0]), logit).otherwise(score)
    return df.withColumn(name, score)


def freeze(
    df: DataFrame, u: str, v: str, label: str, d: int, training: Training, *, target_precision: float
) -> BilinearGate:
    """Full fit with its threshold chosen on the model's own logits."""
    models = fit(pair_rows(df, u, v, label, None), [None], d, training)
    if not models:
        raise ValueError("cannot freeze a gate on rows of one class")
    gate = _gate(models[0], d, training.rank, 0.0, target_precision)
    x = F.concat(F.col(u).cast("array<double>"), F.col(v).cast("array<double>"))
    scored = df.select(gate.logit(x).alias("score"), F.col(label).alias("label"))
    threshold = threshold_for_precision(scored, target_precision).first()["threshold"]
    return _gate(models[0], d, training.rank, float(threshold), float(target_precision))
