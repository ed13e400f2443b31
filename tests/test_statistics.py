import numpy as np
import pytest

from pairgate.operators import resampling as B
from pairgate.operators.statistics import Auroc, Spread, TrimmedMean


def rows(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(rng.normal(y * 0.7, 1.0), 1)
    t = np.round(s + rng.normal(0, 0.5, n), 1)
    data = [(int(i), "ab"[i % 2], float(s[i]), float(t[i]), int(y[i])) for i in range(n)]
    data += [(n, "a", float("nan"), 0.0, 1), (n + 1, "a", 5.0, 5.0, None), (n + 2, "c", 1.0, 1.0, 1)]
    return spark.createDataFrame(data, "ordinal long, g string, score double, other double, label int")


def by_group(df):
    return {r["g"]: (r["point"], r["ci_low"], r["ci_high"]) for r in df.collect()}


def test_auroc_as_a_given_statistic_equals_the_built_in(spark):
    df = rows(spark)
    for rows_per_bucket in (10**6, 25):
        options = {"n_boot": 60, "seed": 3, "rows_per_bucket": rows_per_bucket}
        given = by_group(B.bootstrap_ci(df, Auroc(), ["g"], **options))
        built_in = by_group(B.bootstrap_ci(df, "auroc", ["g"], **options))
        assert given["a"] == pytest.approx(built_in["a"], abs=1e-12) and given["b"] == pytest.approx(built_in["b"], abs=1e-12)
        assert given["c"] == (None, None, None)
    a = B.paired_delta(df, Auroc(), "score", "other", n_boot=50).first()
    b = B.paired_delta(df, "auroc", "score", "other", n_boot=50).first()
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-12)


def test_trimmed_mean_and_spread(spark):
    df = rows(spark).where("g <> 'c'")
    values = {g: sorted(r["score"] for r in df.where(f"g = '{g}' AND label IS NOT NULL AND NOT isnan(score)").collect()) for g in "ab"}
    for rows_per_bucket in (10**6, 20):
        got = by_group(B.bootstrap_ci(df, TrimmedMean(0.1, 0.9), ["g"], n_boot=40, rows_per_bucket=rows_per_bucket))
        for g, v in values.items():
            n, v = len(v), np.array(v)
            at = np.arange(n)
            inside = np.clip(np.minimum(at + 1, 0.9 * n) - np.maximum(at, 0.1 * n), 0, None)
            assert got[g][0] == pytest.approx((v * inside).sum() / (0.8 * n))
            assert got[g][1] < got[g][0] < got[g][2]
        wide = by_group(B.bootstrap_ci(df, Spread(), ["g"], n_boot=20, rows_per_bucket=rows_per_bucket))
        assert all(wide[g][0] == pytest.approx(v[-1] - v[0]) for g, v in values.items())
        assert all(wide[g][2] <= wide[g][0] + 1e-12 for g in values)
