"""Fits, out-of-fold scores and bootstrap intervals over labelled documents, lines and embeddings.

Where SQL cannot fit a model, it checks the optimum: at the solution the penalised gradient is
zero for every weight, and the frozen threshold meets its precision.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgate.catalogue import SL, labelled_documents, query, rounded, table
from pairgate.functions import vectors as V
from pairgate.functions.sequence import chain_features
from pairgate.operators import bilinear as B
from pairgate.operators import leave_one_out as LOO
from pairgate.operators import linear as L
from pairgate.operators import metrics as M
from pairgate.operators import resampling as R
from pairgate.operators import wide as W
from pairgate.operators.sampling import assign_folds
from pairgate.operators.statistics import TrimmedMean
from pairgate.session import cut_lineage

_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    """Line items labelled by a returned flag; the fold comes from the order, so no order straddles."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        *_LINE_FEATURES,
    )


def _document_features(spark, sf_dir):
    """Labelled documents with composition features of their whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", *chain_features("text", "binder"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.join(labels, "doc_id").withColumn("ordinal", F.col("doc_id"))


_DOC_FEATURES = [f"binder_{n}" for n in ("length", "net_charge", "aromatic_frac", "hydrophobic_frac", "polar_frac")]


@query(
    "logistic_optimum",
    """SELECT UNNEST(['intercept', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS weight, 0.0::DOUBLE AS gradient
FROM (SELECT COUNT(*) AS n FROM lineitem)""",
)
def logistic_optimum(spark, sf_dir):
    """Gradient of the penalised loss at the fitted weights; zero at the optimum."""
    lines = _lines(spark, sf_dir)
    fit = L.fit_full(lines, _LINE_FEATURES, "label", l2=1.0)
    logit = V.linear_logit(_LINE_FEATURES, fit.mean, fit.std, fit.intercept, fit.coef)
    residual = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)) - F.col("label")
    terms = [F.sum(residual).alias("intercept")]
    for name, m, s, c in zip(_LINE_FEATURES, fit.mean, fit.std, fit.coef, strict=True):
        z = (F.col(name) - F.lit(float(m))) / F.lit(float(s))
        terms.append((F.sum(residual * z) + F.lit(float(c))).alias(name))
    names = ["intercept", *_LINE_FEATURES]
    return rounded(lines.agg(*terms).unpivot([], names, "weight", "gradient"), 3)


@query("logistic_oof")
def logistic_oof(spark, sf_dir):
    """AUROC of out-of-fold logits per fold."""
    scored = L.out_of_fold(_lines(spark, sf_dir), _LINE_FEATURES, "label", "fold", l2=1.0)
    return rounded(M.auroc(scored, ["fold"], "oof", "label"))


@query("logistic_oof_coverage", "SELECT (l_orderkey % 5)::INT AS fold, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def logistic_oof_coverage(spark, sf_dir):
    """Every line gets a held-out logit."""
    scored = L.out_of_fold(_lines(spark, sf_dir), _LINE_FEATURES, "label", "fold", l2=1.0)
    return scored.where(F.col("oof").isNotNull()).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("logistic_loo")
def logistic_loo(spark, sf_dir):
    docs = cut_lineage(_document_features(spark, sf_dir))
    sets = [("length", _DOC_FEATURES[:1]), ("all", _DOC_FEATURES)]
    scored = L.leave_one_out(docs, sets, "label", "ordinal", l2=1.0)
    return rounded(M.metric_table(scored, ["feature_set"], "score", "y", "ordinal"))


@query(
    "leave_one_out_gradient",
    """SELECT label AS y, COUNT(*) AS n, 0.0::DOUBLE AS gradient FROM (SELECT quality::INT AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) GROUP BY label""",
)
def leave_one_out_gradient(spark, sf_dir):
    """Every row's model is the optimum of all other rows: the greatest penalised gradient over the
    models, the weights of all rows checked against the rows themselves, is zero."""
    docs = _document_features(spark, sf_dir).where(F.col("label").isNotNull()).select("ordinal", "label", *_DOC_FEATURES).persist()
    scored = cut_lineage(LOO.leave_one_out_scores(docs, _DOC_FEATURES, "label", "ordinal", l2=1.0))
    whole = docs.agg(
        *[f(c).alias(f"{k}_{c}") for c in _DOC_FEATURES for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    rows = L.design_rows(docs, _DOC_FEATURES, "label", "ordinal").select(F.col("fold").cast("long").alias("id"), "x", "y")
    # Every model meets every row: blocks are packed, models carry their weights.
    models = scored.groupBy(F.col("ordinal").alias("model"), "y", "weights").agg(F.count("*").alias("same"))
    against = LOO.held_out_sums(
        rows, models.select(F.col("model").alias("id"), "weights"), [whole[f"m_{c}"] for c in _DOC_FEATURES], [whole[f"s_{c}"] for c in _DOC_FEATURES]
    )
    n = len(_DOC_FEATURES) + 1
    sums = models.join(against.withColumnRenamed("id", "model"), ["model", "weights"], "left").select(
        "y", "weights", *[(F.col("gradient")[j] * F.col("same")).alias(f"g{j}") for j in range(n)], *[F.col("spread")[j].alias(f"v{j}") for j in range(1, n)]
    )
    parts = [F.abs(F.col("g0"))] + [F.abs(F.col(f"g{j}") + F.col(f"v{j}") * F.col("weights")[j]) for j in range(1, n)]
    found = sums.select(F.col("y").cast("int").alias("y"), F.greatest(*parts).alias("g"))
    return rounded(found.groupBy("y").agg(F.count("*").alias("n"), F.max("g").alias("gradient")), 3)


@query(
    "held_out_gradient",
    "SELECT (l_orderkey % 5)::INT AS fold, COUNT(*) AS n_held_out, (SELECT COUNT(*) FROM lineitem) - COUNT(*) AS n_trained, 0.0::DOUBLE AS gradient FROM lineitem GROUP BY ALL",
)
def held_out_gradient(spark, sf_dir):
    """Each fold's model is the optimum of the other folds: the largest penalised gradient is zero."""
    lines = _lines(spark, sf_dir)
    rows = L.design_rows(lines, _LINE_FEATURES, "label", "fold")
    specs = [L.Spec("oof", tuple(range(len(_LINE_FEATURES))), float(f)) for f in range(5)]
    out = None
    for fit in L.fit_many(rows, specs, len(_LINE_FEATURES), l2=1.0):
        logit = V.linear_logit(_LINE_FEATURES, fit.mean, fit.std, fit.intercept, fit.coef)
        residual = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)) - F.col("label")
        trained = F.col("fold") != int(fit.held_out)
        parts = [F.abs(F.sum(F.when(trained, residual)))]
        for name, m, s, c in zip(_LINE_FEATURES, fit.mean, fit.std, fit.coef, strict=True):
            z = (F.col(name) - F.lit(float(m))) / F.lit(float(s))
            parts.append(F.abs(F.sum(F.when(trained, residual * z)) + F.lit(float(c))))
        row = lines.agg(
            F.count_if(~trained).alias("n_held_out"), F.count_if(trained).alias("n_trained"), F.greatest(*parts).alias("gradient")
        ).select(F.lit(int(fit.held_out)).alias("fold"), "n_held_out", "n_trained", "gradient")
        out = row if out is None else out.unionByName(row)
    return rounded(out, 3)


@query("attribution")
def attribution(spark, sf_dir):
    return rounded(L.attribution(_document_features(spark, sf_dir), _DOC_FEATURES, "label", l2=1.0))


@query(
    "frozen_gate_precision",
    "SELECT TRUE AS met, COUNT(*) AS n, SUM((l_returnflag = 'R')::INT)::BIGINT AS n_positive FROM lineitem",
)
def frozen_gate_precision(spark, sf_dir):
    """The frozen threshold reaches its target precision on the rows it was fitted on."""
    lines = _lines(spark, sf_dir)
    gate = L.freeze(lines, _LINE_FEATURES, "label", l2=1.0, target_precision=0.3)
    scored = lines.withColumn("score", gate.logit())
    found = M.confusion(scored, gate.threshold)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return found.select(
        (F.col("precision") >= 0.3).alias("met"), total.alias("n"), (F.col("tp") + F.col("fn")).alias("n_positive")
    )


@query("grouped_split_table")
def grouped_split_table(spark, sf_dir):
    """Ordinary against grouped splits of the same features."""
    # Texts are read and counted once; fits and metrics pass over the features many times.
    docs = cut_lineage(_document_features(spark, sf_dir))
    out = None
    for split, group in (("random_pair", "doc_id"), ("held_out_antigen", "source")):
        folded = cut_lineage(assign_folds(docs, group, n_splits=5, seed=20260601))
        scored = L.out_of_fold(folded, _DOC_FEATURES, "label", "fold", l2=1.0)
        row = M.metric_table(scored, [], "oof", "label", "ordinal").withColumn("split", F.lit(split))
        out = row if out is None else out.unionByName(row)
    return rounded(out)


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    left = e.select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("u"), F.col("label").alias("la"))
    right = e.select((F.col("vec_id") - 1).alias("ordinal"), F.col("embedding").alias("v"), F.col("label").alias("lb"))
    same = (F.abs(F.col("la") - F.col("lb")) <= 3).cast("int")
    return left.join(right, "ordinal").select(
        "ordinal", "u", "v", same.alias("label"), (F.col("la") % 4).alias("fold")
    )


_TRAINING = B.Training(rank=4, l2=0.01, lr=0.5, n_iter=60, seed=1)


@query("bilinear_oof")
def bilinear_oof(spark, sf_dir):
    scored = B.out_of_fold(_pairs(spark, sf_dir), "u", "v", "label", "fold", 64, _TRAINING)
    return rounded(scored.select("ordinal", "label", "fold", "oof"))


@query("bilinear_fit")
def bilinear_fit(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    gate = B.freeze(pairs, "u", "v", "label", 64, _TRAINING, target_precision=0.9)
    scored = pairs.select(gate.logit(F.concat(V.as_doubles("u"), V.as_doubles("v"))).alias("score"), "label")
    return rounded(M.confusion(scored, gate.threshold))


@query(
    "bootstrap_point",
    f"""WITH {SL},
p AS (SELECT a.lang, AVG(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END)::DOUBLE AS point
  FROM sl a JOIN sl b ON a.lang = b.lang WHERE a.y = 1 AND b.y = 0 GROUP BY a.lang)
SELECT lang, round(point, 6) AS point, TRUE AS inside FROM p""",
)
def bootstrap_point(spark, sf_dir):
    """The interval's point is the AUROC of the rows, and lies inside the interval."""
    found = R.bootstrap_ci(labelled_documents(spark, sf_dir), "auroc", ["lang"], n_boot=200, seed=0)
    inside = (F.col("ci_low") <= F.col("point")) & (F.col("point") <= F.col("ci_high"))
    return rounded(found.where(F.col("point").isNotNull())).select("lang", "point", inside.alias("inside"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir)
    return rounded(R.bootstrap_ci(docs, "auroc", ["lang"], n_boot=500, seed=0))


@query("bootstrap_rate_ci")
def bootstrap_rate_ci(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("score", F.col("l_extendedprice"))
    return rounded(R.bootstrap_ci(lines, "recall", ["fold"], threshold=30000.0, n_boot=1000))


@query("paired_delta")
def paired_delta(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir).withColumn("other", F.length("source").cast("double") + F.col("score") * 0.1)
    return rounded(R.paired_delta(docs, "auroc", "score", "other", n_boot=500, seed=0))


@query(
    "paired_delta_identical",
    "SELECT 0.0::DOUBLE AS point, 0.0::DOUBLE AS ci_low, 0.0::DOUBLE AS ci_high FROM (SELECT COUNT(*) AS n FROM labels)",
)
def paired_delta_identical(spark, sf_dir):
    docs = labelled_documents(spark, sf_dir).withColumn("other", F.col("score"))
    return rounded(R.paired_delta(docs, "auroc", "score", "other", n_boot=200, seed=0))



@query(
    "given_statistic_point",
    f"""WITH {SL},
r AS (SELECT lang, s, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY s, doc_id) - 1 AS i, COUNT(*) OVER (PARTITION BY lang) AS n FROM sl WHERE y IS NOT NULL)
SELECT lang, ROUND(SUM(s * GREATEST(0, LEAST(i + 1, 0.9::DOUBLE * n) - GREATEST(i, 0.1::DOUBLE * n))) / (0.8::DOUBLE * MAX(n)), 4) AS point FROM r GROUP BY lang""",
)
def given_statistic_point(spark, sf_dir):
    """The trimmed mean of text lengths as a caller's statistic of the bootstrap, at the rows themselves."""
    found = R.bootstrap_ci(labelled_documents(spark, sf_dir), TrimmedMean(0.1, 0.9), ["lang"], n_boot=50, seed=0)
    return rounded(found.select("lang", "point"), 4)


@query(
    "wide_held_out_gradient",
    """WITH p AS (SELECT a.label % 4 AS fold FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT fold::INT AS fold, COUNT(*) AS n_held_out, (SELECT COUNT(*) FROM p) - COUNT(*) AS n_trained, 129::INT AS n_weights, 0.0::DOUBLE AS gradient FROM p GROUP BY fold""",
)
def wide_held_out_gradient(spark, sf_dir):
    """Each fold's model on both embeddings (128 features) is the optimum of the other folds: the
    greatest penalised gradient, weight by weight, is zero."""
    pairs = _pairs(spark, sf_dir)
    rows = W.design_rows(pairs, V.concat_pair("u", "v"), "label", "fold").persist()
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())
    out = None
    for fit in W.fit_many(rows, folds, l2=1.0):
        bias, weights = fit.raw()
        scaled = F.zip_with(
            F.zip_with("x", F.lit(fit.mean.tolist()), lambda a, b: a - b), F.lit(fit.std.tolist()), lambda a, b: a / b
        )
        score = F.aggregate(F.zip_with("x", F.lit(weights.tolist()), lambda a, b: a * b), F.lit(bias), lambda t, v: t + v)
        trained = rows.where(F.col("fold") != fit.held_out).select((1 / (1 + F.exp(-score)) - F.col("y")).alias("r"), scaled.alias("z"))
        sides = trained.select("r", F.posexplode(F.concat(F.array(F.lit(1.0)), "z")).alias("k", "z"))
        ridge = F.get(F.lit([0.0, *fit.coef.tolist()]), F.col("k"))
        by_weight = sides.groupBy("k").agg(F.sum(F.col("r") * F.col("z")).alias("g"), F.count("*").alias("n_trained"))
        row = by_weight.agg(
            F.max("n_trained").alias("n_trained"), F.count("*").cast("int").alias("n_weights"), F.max(F.abs(F.col("g") + ridge)).alias("gradient")
        )
        row = row.select(F.lit(int(fit.held_out)).alias("fold"), "*")
        out = row if out is None else out.unionByName(row)
    held = rows.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("n_held_out"))
    return rounded(out.join(held, "fold").select("fold", "n_held_out", "n_trained", "n_weights", "gradient"), 3)
