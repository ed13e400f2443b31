import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgate.catalogue import models
from pairgate.operators import bilinear as B
from pairgate.operators import linear as L
from pairgate.operators import metrics as M
from pairgate.operators import resampling as R


def data(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (x[:, 0] + 0.3 * (x[:, 1] - 3) + rng.normal(size=n) > 0.2).astype(int)
    rows = [(i, *map(float, r), int(v), i % 4) for i, (r, v) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "i long, a double, b double, c double, y int, fold int")


def plain_fit(x, y, l2):
    """Gradient of the penalised loss driven to zero by damped Newton."""
    d = np.column_stack([np.ones(len(x)), x])
    pen = np.r_[0.0, np.full(x.shape[1], l2)]
    beta = np.zeros(d.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-d @ beta))
        beta -= np.linalg.solve((d.T * (p * (1 - p))) @ d + np.diag(pen), d.T @ (p - y) + pen * beta)
    return beta


def test_full_fit_and_out_of_fold(spark):
    x, y, df = data(spark)
    fit = L.fit_full(df, ["a", "b", "c"], "y", l2=1.0)
    mean, std = x.mean(0), x.std(0)
    want = plain_fit((x - mean) / std, y, 1.0)
    assert [fit.intercept, *fit.coef] == pytest.approx(want, abs=1e-7)
    intercept, coef = L.raw_scale(fit)
    assert coef == pytest.approx(want[1:] / std, abs=1e-6)
    assert intercept == pytest.approx(want[0] - (mean / std) @ want[1:], abs=1e-6)
    got = L.out_of_fold(df, ["a", "b", "c"], "y", "fold", l2=1.0).orderBy("i").collect()
    oof = np.array([r["oof"] for r in got])
    folds = np.arange(len(y)) % 4
    for f in range(4):
        tr = folds != f
        m, s = x[tr].mean(0), x[tr].std(0)
        b = plain_fit((x[tr] - m) / s, y[tr], 1.0)
        assert oof[~tr] == pytest.approx(b[0] + ((x[~tr] - m) / s) @ b[1:], abs=1e-6)


def test_fits_over_many_partitions(spark):
    """The sums of one model leave slots empty, and partitions may hold no rows."""
    _, _, df = data(spark)
    want = L.fit_full(df.coalesce(1), ["a", "b", "c"], "y", l2=1.0)
    far = spark.range(0, 20, 1, 20).select("id", *[F.lit(None).cast(t).alias(c) for c, t in df.dtypes[1:]]).toDF(*df.columns)
    spread = df.repartition(20).unionByName(far)
    fit = L.fit_full(spread, ["a", "b", "c"], "y", l2=1.0)
    assert [fit.intercept, *fit.coef] == pytest.approx([want.intercept, *want.coef], abs=1e-9)
    t = B.Training(rank=1, l2=0.01, lr=0.5, n_iter=3, seed=1)
    sides = lambda d: d.select("i", F.array("a", "b").alias("u"), F.array("b", "c").alias("v"), "y", "fold")
    scores = [
        [r["oof"] for r in B.out_of_fold(sides(d), "u", "v", "y", "fold", 2, t).where("y IS NOT NULL").orderBy("i").collect()]
        for d in (df.coalesce(1), spread)
    ]
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_undefined_rows_and_single_class(spark):
    rows = [(0, 1.0, 1, 0), (1, 2.0, 1, 0), (2, 0.0, 0, 1), (3, None, 1, 1), (4, 0.5, 0, 1)]
    df = spark.createDataFrame(rows, "i long, a double, y int, fold int")
    got = {r["i"]: r["oof"] for r in L.out_of_fold(df, ["a"], "y", "fold", l2=1.0).collect()}
    assert all(v is None for v in got.values())  # each training side has one class


def test_leave_one_out(spark):
    x, y, df = data(spark, n=16, seed=2)
    got = L.leave_one_out(df, [("ab", ["a", "b"])], "y", "i", l2=1.0).orderBy("i").collect()
    for i, r in enumerate(got):
        keep = np.arange(16) != i
        z = x[:, :2]
        m, s = z[keep].mean(0), z[keep].std(0)
        b = plain_fit((z[keep] - m) / s, y[keep], 1.0)
        assert r["score"] == pytest.approx(b[0] + ((z[i] - m) / s) @ b[1:], abs=1e-5)


def test_freeze_round_trip(spark, tmp_path):
    x, y, df = data(spark)
    gate = L.freeze(df, ["a", "b", "c"], "y", l2=1.0, target_precision=0.9)
    called = df.select((gate.logit() >= gate.threshold).alias("c"), "y").where("c")
    assert called.agg(F.avg("y")).first()[0] >= 0.9
    path = str(tmp_path / "m.json")
    gate.save(path)
    assert L.LinearGate.load(path) == gate
    (tmp_path / "bad.json").write_text('{"coef": []}')
    with pytest.raises(TypeError):
        L.LinearGate.load(str(tmp_path / "bad.json"))
    top = L.attribution(df, ["a", "b", "c"], "y", l2=1.0).collect()
    assert [r["abs_contribution"] for r in top] == sorted((r["abs_contribution"] for r in top), reverse=True)


def interaction(spark, n=160, d=3):
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    y = (u[:, 0] * v[:, 0] > 0).astype(int)
    rows = [(i, list(map(float, u[i])), list(map(float, v[i])), int(y[i]), i % 2) for i in range(n)]
    return u, v, y, spark.createDataFrame(rows, "ordinal long, u array<double>, v array<double>, y int, fold int")


def plain_descent(u, v, y, t):
    """One step after another on arrays in memory."""
    u, v = ((x - x.mean(0)) / x.std(0) for x in (u, v))
    rng = np.random.default_rng(t.seed)
    a = rng.normal(0.0, u.shape[1] ** -0.5, size=(t.rank, u.shape[1]))
    g = rng.normal(0.0, v.shape[1] ** -0.5, size=(t.rank, v.shape[1]))
    b = 0.0
    for _ in range(t.n_iter):
        r = (1 / (1 + np.exp(-(((u @ a.T) * (v @ g.T)).sum(1) + b))) - y) / len(y)
        da = np.einsum("n,nr,nd->rd", r, v @ g.T, u) + t.l2 * a
        dg = np.einsum("n,nr,nd->rd", r, u @ a.T, v) + t.l2 * g
        da, dg = (x * min(1.0, t.max_grad_norm / np.linalg.norm(x)) for x in (da, dg))
        a, g, b = a - t.lr * da, g - t.lr * dg, b - t.lr * r.sum()
    return a.ravel(), g.ravel(), b


def test_bilinear_equals_plain_descent_and_finds_the_interaction(spark, tmp_path):
    u, v, y, df = interaction(spark)
    t = B.Training(rank=2, l2=1e-3, lr=0.5, n_iter=15, seed=1)
    fold = np.arange(len(y)) % 2
    fits = {m[0]: m for m in B.fit(B.pair_rows(df.repartition(3), "u", "v", "y", "fold"), [None, 0.0], 3, t)}
    for held, keep in ((None, fold >= 0), (0.0, fold != 0)):
        for got, want in zip(fits[held][3:], plain_descent(u[keep], v[keep], y[keep], t)):
            assert np.allclose(got, want, atol=1e-9)
    t = B.Training(rank=2, l2=1e-3, lr=2.0, n_iter=60, seed=1)
    gate = B.freeze(df, "u", "v", "y", 3, t, target_precision=0.9)
    x = F.concat("u", "v")
    scored = df.select(gate.logit(x).alias("score"), F.col("y").alias("label"))
    from pairgate.operators.metrics import auroc

    assert auroc(scored).first()["auroc"] > 0.9
    gate.save(str(tmp_path / "b.json"))
    assert B.BilinearGate.load(str(tmp_path / "b.json")) == gate
    t = B.Training(rank=2, l2=1e-3, lr=2.0, n_iter=5, seed=1)
    oof = B.out_of_fold(df, "u", "v", "y", "fold", 3, t)
    assert oof.where("oof is null").count() == 0


def scores(spark, n=300, seed=4):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(int)
    a = np.round(y + rng.normal(size=n), 1)
    b = np.round(0.3 * y + rng.normal(size=n), 1)
    rows = [(i, float(a[i]), float(b[i]), int(y[i])) for i in range(n)]
    return a, b, y, spark.createDataFrame(rows, "ordinal long, a double, b double, label int")


def plain_interval(fn, y, n_boot, seed):
    """Stratified percentile bootstrap with one numpy generator."""
    rng = np.random.default_rng(seed)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    vals = []
    for _ in range(n_boot):
        at = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        vals.append(fn(at))
    return np.quantile(vals, [0.025, 0.975])


def plain_statistic(name, threshold):
    def auroc(s, y):
        pairs = np.sign(s[y == 1][:, None] - s[y == 0][None, :])
        return float((pairs + 1).mean() / 2)

    def ap(s, y):
        hits = y[np.argsort(-s, kind="stable")]
        return float((np.cumsum(hits) / np.arange(1, len(y) + 1))[hits == 1].mean())

    def rate(s, y):
        called = s >= threshold
        rates = {"recall": called[y == 1], "specificity": ~called[y == 0], "precision": y[called] == 1}
        return float(np.mean(rates[name]))

    return {"auroc": auroc, "ap": ap}.get(name, rate)


@pytest.mark.parametrize("name", ["auroc", "ap", "recall", "precision"])
def test_bootstrap_point_and_interval(spark, name):
    a, b, y, df = scores(spark)
    thr = 0.5 if name in ("recall", "precision") else None
    fn = plain_statistic(name, thr)
    low, high = plain_interval(lambda at: fn(a[at], y[at]), y, 400, 7)
    for rows_per_bucket in (60, 10_000):
        got = R.bootstrap_ci(df, name, score="a", threshold=thr, n_boot=400, seed=7, rows_per_bucket=rows_per_bucket).first()
        assert got["point"] == pytest.approx(fn(a, y), abs=1e-12)
        assert abs(got["ci_low"] - low) < 0.35 * (high - low) and abs(got["ci_high"] - high) < 0.35 * (high - low)


def test_bootstrap_of_tied_and_undefined_scores(spark):
    tied = spark.createDataFrame([(i, 0.5, int(i >= 30)) for i in range(40)], "ordinal long, score double, label int")
    point = R.bootstrap_ci(tied, "ap", n_boot=20).first()["point"]
    assert point == pytest.approx(M.average_precision(tied).first()["ap"], abs=1e-12)
    rows = [(0, 1.0, 1), (1, None, 1), (2, float("inf"), 1), (3, float("nan"), 1), (4, 0.1, 1), (5, 2.0, 0), (6, None, 0), (7, 3.0, None)]
    df = spark.createDataFrame(rows, "ordinal long, score double, label int")
    rates = M.confusion(df, 0.5).first()
    for name in ("recall", "specificity", "precision"):
        assert R.bootstrap_ci(df, name, threshold=0.5, n_boot=20).first()["point"] == pytest.approx(rates[name], abs=1e-12)
    assert rates["recall"] == pytest.approx(0.4)
    with pytest.raises(ValueError):
        R.bootstrap_ci(df, "recall")


def test_metric_table_keeps_groups_without_scores(spark):
    rows = [("a", 0, 1.0, 1), ("a", 1, 0.0, 0), ("b", 2, None, 1), ("b", 3, float("nan"), 0)]
    df = spark.createDataFrame(rows, "g string, ordinal long, score double, label int")
    got = {r["g"]: r for r in M.metric_table(df, ["g"]).collect()}
    assert got["a"]["n"] == 2 and got["a"]["auroc"] == 1.0
    assert (got["b"]["n"], got["b"]["n_positive"], got["b"]["auroc"], got["b"]["ap"]) == (0, 0, None, None)


def test_paired_delta(spark):
    a, b, y, df = scores(spark)
    same = R.paired_delta(df, "auroc", "a", "a", n_boot=60, rows_per_bucket=60).first()
    assert (same["point"], same["ci_low"], same["ci_high"]) == pytest.approx((0, 0, 0), abs=1e-12)
    fn = plain_statistic("auroc", None)
    low, high = plain_interval(lambda at: fn(a[at], y[at]) - fn(b[at], y[at]), y, 150, 3)
    got = R.paired_delta(df, "auroc", "a", "b", n_boot=300, seed=3, rows_per_bucket=60).first()
    assert got["point"] == pytest.approx(fn(a, y) - fn(b, y), abs=1e-12)
    assert abs(got["ci_low"] - low) < 0.4 * (high - low)
    rate = R.paired_delta(df, "precision", "a", "b", threshold=0.5, n_boot=100).first()
    fn = plain_statistic("precision", 0.5)
    assert rate["point"] == pytest.approx(fn(a, y) - fn(b, y)) and rate["ci_low"] < rate["point"] < rate["ci_high"]


def test_split_table_reads_texts_once(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, "".join(rng.choice(list("ACDEFKRW"), 5 + i % 7)), f"s{i % 6}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(rng.random() < 0.5)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = models.grouped_split_table(spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if "documents" in f or "labels" in f]
    assert {r["split"]: r["n"] for r in out.collect()} == {"random_pair": 60, "held_out_antigen": 60}


def test_out_of_fold_logit_is_named_once_a_row(spark):
    """Filters and sums of the score repeat no arithmetic, and packed rows give each fold's moments."""
    rng = np.random.default_rng(12)
    x, fold = rng.normal(5, 2, (300, 2)), rng.integers(0, 4, 300)
    rows = [(int(f), int(rng.integers(0, 2)), float(a), float(b)) for f, (a, b) in zip(fold, x)]
    df = spark.createDataFrame(rows, "fold int, y int, a double, b double").repartition(3)
    scored = L.out_of_fold(df, ["a", "b"], "y", "fold", l2=1.0)
    plan = scored.where("isnotnull(oof) AND NOT isnan(oof) AND abs(oof) < 9").groupBy("oof").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/ __s#") == 2  # one for each feature, however many folds
    found = L._fold_moments(L._pack(L.design_rows(df, ["a", "b"], "y", "fold"), 2), 2, 99)
    assert set(found) == {0.0, 1.0, 2.0, 3.0}
    for f, (n, p, mean, ss) in found.items():
        mine = x[fold == f]
        assert (n, p) == (len(mine), sum(r[1] for r in rows if r[0] == f))
        assert mean == pytest.approx(mine.mean(0)) and ss == pytest.approx(len(mine) * mine.var(0))
    none = L._fold_moments(L._pack(L.design_rows(df, ["a", "b"], "y", None), 2), 2, 3)
    assert set(none) == {None} and none[None][0] == 300
    assert L._fold_moments(L._pack(L.design_rows(df.limit(0), ["a", "b"], "y", "fold"), 2), 2, 99) == {}
