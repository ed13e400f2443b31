"""Metrics against closed forms and against a brute-force definition."""

import math

import numpy as np
import pytest

from pairgate.operators import metrics as M
from pairgate.operators.ordered import average_ranks, dense_index, lexical_index, running_totals
from pyspark.sql import functions as F


def frame(spark, scores, labels, **extra):
    rows = [
        (i, float(s) if s is not None else None, int(y), *[v[i] for v in extra.values()])
        for i, (s, y) in enumerate(zip(scores, labels))
    ]
    cols = "ordinal long, score double, label int" + "".join(f", {k} string" for k in extra)
    return spark.createDataFrame(rows, cols)


def brute_auroc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / (len(pos) * len(neg))


def brute_ap(s, y):
    order = np.argsort(-s, kind="stable")
    ys = y[order].astype(float)
    return float((np.cumsum(ys) / np.arange(1, len(ys) + 1) * ys).sum() / ys.sum())


def brute_threshold(s, y, target):
    """Scan every candidate cut in ascending order."""
    best, fallback, fallback_p = None, None, -1.0
    for cut in [None, *sorted(set(s))]:
        called = np.ones(len(s), bool) if cut is None else s > cut
        if not called.any():
            continue
        p = y[called].mean()
        if p > fallback_p:
            fallback, fallback_p = cut, p
        if p >= target and best is None and y[called].sum() > 0:
            best = ("hit", cut)
    return best[1] if best else fallback


def test_closed_forms(spark):
    r = M.metric_table(frame(spark, [0, 1, 1, 2], [0, 0, 1, 1]), []).first()
    assert r["auroc"] == 0.875
    assert M.auroc(frame(spark, [1, 1, 1, 1], [0, 1, 0, 1])).first()["auroc"] == 0.5
    assert M.auroc(frame(spark, [1, 2], [1, 1])).first()["auroc"] is None
    ap = M.average_precision(frame(spark, [0.9, 0.8, 0.7, 0.6], [1, 0, 1, 0])).first()["ap"]
    assert ap == pytest.approx((1 + 2 / 3) / 2)


@pytest.mark.parametrize("rows_per_bucket", [10**6, 40])
def test_against_brute_force_with_heavy_ties(spark, rows_per_bucket):
    rng = np.random.default_rng(3)
    n = 400
    s = np.round(rng.normal(size=n), 1)
    s[rng.random(n) < 0.35] = 0.5  # one score holds a third of the rows
    y = (rng.random(n) < 0.3 + 0.2 * (s > 0)).astype(int)
    g = np.where(rng.random(n) < 0.8, "a", "b")
    df = frame(spark, s, y, grp=list(g))
    got = {r["grp"]: r for r in M.metric_table(df, ["grp"], rows_per_bucket=rows_per_bucket).collect()}
    for key in ("a", "b"):
        m = g == key
        assert got[key]["auroc"] == pytest.approx(brute_auroc(s[m], y[m]), abs=1e-12)
        assert got[key]["ap"] == pytest.approx(brute_ap(s[m], y[m]), abs=1e-12)
        ranks = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        rho = np.corrcoef(ranks(s[m]), ranks(y[m]))[0, 1]
        assert got[key]["spearman_rho"] == pytest.approx(rho, abs=1e-9)
        general = M.spearman(df.where(F.col("grp") == key), "score", "label", rows_per_bucket=rows_per_bucket)
        assert general.first()["spearman_rho"] == pytest.approx(rho, abs=1e-9)


@pytest.mark.parametrize("target", [0.2, 0.6, 0.75, 0.99])
@pytest.mark.parametrize("rows_per_bucket", [10**6, 15])
def test_threshold_for_precision(spark, target, rows_per_bucket):
    for seed in range(2):
        rng = np.random.default_rng(seed)
        s = np.round(rng.normal(size=60), 1)
        y = (rng.random(60) < 0.4).astype(int)
        r = M.threshold_for_precision(frame(spark, s, y), target, rows_per_bucket=rows_per_bucket).first()
        want = brute_threshold(s, y, target)
        assert r["cut"] == want
        limit = np.nextafter(s.min(), -np.inf) if want is None else np.nextafter(want, np.inf)
        assert r["threshold"] == limit


def test_non_finite_scores(spark):
    df = frame(spark, [0.1, 0.9, math.nan, math.inf, None], [0, 1, 1, 0, 1])
    r = M.auroc(df).first()
    assert (r["n"], r["auroc"]) == (2, 1.0)
    c = M.confusion(df, 0.5).first()
    # NaN and NULL never reach a threshold; infinity does.
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (1, 1, 2, 1)


def test_confusion_undefined_rates(spark):
    c = M.confusion(frame(spark, [0.1, 0.2], [0, 0]), 0.5).first()
    assert c["precision"] is None and c["recall"] is None and c["specificity"] == 1.0


def test_ppv(spark):
    df = spark.createDataFrame([(0.9, 0.9)], "recall double, specificity double")
    got = {r["prevalence"]: r["ppv"] for r in M.ppv_sweep(df).collect()}
    assert got[0.5] == pytest.approx(0.9)
    assert got[0.01] == pytest.approx(0.009 / (0.009 + 0.1 * 0.99))


def test_running_totals_in_buckets(spark):
    rng = np.random.default_rng(0)
    v = np.where(rng.random(300) < 0.4, 7.0, rng.integers(0, 50, 300).astype(float))
    df = spark.createDataFrame([(int(i), float(x), 1) for i, x in enumerate(v)], "i long, v double, one long")
    got = {r["i"]: r["before_one"] for r in running_totals(df, [], "v", ["one"], tie="i", rows_per_bucket=20).collect()}
    order = np.lexsort((np.arange(300), v))
    assert got == {int(i): pos for pos, i in enumerate(order)}
    ranks = {r["v"]: r["avg_rank"] for r in average_ranks(df, "v", rows_per_bucket=20).collect()}
    assert ranks[7.0] == (v < 7).sum() + ((v == 7).sum() + 1) / 2
    assert dense_index(df, [], "i", rows_per_bucket=20).where("index != i").count() == 0


def test_bucket_summary_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 4.0), (9.0, math.nan)], "rmsd double, m double")
    edges = [("<=4", -math.inf, 4.0), ("4-8", 4.0, 8.0), (">8", 8.0, math.inf)]
    got = {r["bucket"]: r for r in M.bucket_summary(df, "rmsd", ["m"], edges).collect()}
    assert (got["<=4"]["n"], got["<=4"]["m_mean"], got["<=4"]["m_std"]) == (2, 3.0, 1.0)
    assert (got["4-8"]["n"], got["4-8"]["m_mean"]) == (0, None)
    assert (got[">8"]["n"], got[">8"]["m_mean"]) == (1, None)


@pytest.mark.parametrize("rows_per_bucket", [10**6, 5])
def test_lexical_index(spark, rows_per_bucket):
    words = sorted({f"sabdab-{i % 7}{'x' * (i % 3)}-{i}" for i in range(40)} | {"", "a", "é", "zzz", "sabdab-1"}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w,) for w in words[::-1]], "w string")
    got = {r["w"]: r["index"] for r in lexical_index(df, "w", rows_per_bucket=rows_per_bucket).collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_metric_table_plans_its_cuts_once(spark, monkeypatch):
    """One plan serves both orders; many buckets are cut in ranges, with sketches of bounded size."""
    from pairgate.operators import ordered as O

    rng = np.random.default_rng(21)
    rows = [(("a", "b")[i % 2], float(rng.integers(0, 9) if i % 3 else rng.normal()), int(rng.integers(0, 2)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "grp string, score double, label int, ordinal long")
    want = {r["grp"]: r for r in M.metric_table(df, ["grp"]).collect()}
    sketches, plans = [], []
    sketched, planned = O._sketched, O.plan_cuts
    monkeypatch.setattr(O, "BUCKETS_AT_ONCE", 8)
    monkeypatch.setattr(O, "RANGES", 5)
    monkeypatch.setattr(O, "_sketched", lambda c, b: sketches.append(b) or sketched(c, b))
    monkeypatch.setattr(M, "plan_cuts", lambda *a: plans.append(planned(*a)) or plans[-1])
    got = {r["grp"]: r for r in M.metric_table(df, ["grp"], rows_per_bucket=20).collect()}
    assert len(plans) == 1 and plans[0].hot_buckets and max(sketches) <= 6
    assert len(plans[0].mirrored().score_cuts) == len(plans[0].score_cuts) > 9
    for k, row in want.items():
        assert tuple(got[k])[:4] == tuple(row)[:4] and tuple(got[k])[4:] == pytest.approx(tuple(row)[4:], abs=1e-12)
