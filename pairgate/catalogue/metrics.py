"""Ranking and threshold metrics over labelled documents, line items and parts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pairgate.catalogue import ORACLES, SL, labelled_documents, query, rounded, table
from pairgate.operators import metrics as M
from pairgate.operators import relational as R
from pairgate.operators.ordered import average_ranks

_RANK_SQL = """
g AS (SELECT {k} s, SUM(y)::DOUBLE AS p, SUM(1 - y)::DOUBLE AS n FROM {src} GROUP BY {k} s),
c AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY {pk} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cn FROM g)
"""


def _auroc_sql(src: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (
        _RANK_SQL.format(k=k, pk=keys or "1", src=src)
        + f"""
SELECT {k} (SUM(p) + SUM(n))::BIGINT AS n, SUM(p)::BIGINT AS n_positive, SUM(n)::BIGINT AS n_negative,
  CASE WHEN SUM(p) > 0 AND SUM(n) > 0 THEN ROUND(SUM(p * (cn + n / 2)) / (SUM(p) * SUM(n)), 6) END AS auroc
FROM c {group}"""
    )


@query("auroc_basic", f"WITH {SL}, " + _auroc_sql("sl", ""))
def auroc_basic(spark, sf_dir):
    return rounded(M.auroc(labelled_documents(spark, sf_dir)))


@query(
    "auroc_by_stratum",
    f"""WITH {SL}, st AS (SELECT 'all' AS stratum, s, y FROM sl UNION ALL SELECT lang, s, y FROM sl), """
    + _auroc_sql("st", "stratum"),
)
def auroc_by_stratum(spark, sf_dir):
    rows = M.with_totals_stratum(labelled_documents(spark, sf_dir), "lang")
    return rounded(M.auroc(rows, ["stratum"]))


@query(
    "average_precision",
    f"""WITH {SL}, r AS (
  SELECT y, SUM(y) OVER w AS tp, ROW_NUMBER() OVER w AS k FROM sl
  WINDOW w AS (ORDER BY s DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT ROUND(SUM(CASE WHEN y = 1 THEN tp::DOUBLE / k END) / SUM(y), 6) AS ap FROM r""",
)
def average_precision(spark, sf_dir):
    return rounded(M.average_precision(labelled_documents(spark, sf_dir)))


@query(
    "average_rank",
    f"""WITH {SL} SELECT s AS score, COUNT(*) AS n_tied,
  MIN(rk) + (COUNT(*) - 1) / 2.0::DOUBLE AS avg_rank
FROM (SELECT s, RANK() OVER (ORDER BY s) AS rk FROM sl) GROUP BY s""",
)
def average_rank(spark, sf_dir):
    return average_ranks(labelled_documents(spark, sf_dir), "score")


@query(
    "spearman",
    f"""WITH {SL}, r AS (
  SELECT lang, RANK() OVER (PARTITION BY lang ORDER BY s) + (COUNT(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS ra,
         RANK() OVER (PARTITION BY lang ORDER BY toxic) + (COUNT(*) OVER (PARTITION BY lang, toxic) - 1) / 2.0 AS rb FROM sl)
SELECT lang, COUNT(*) AS n, ROUND(CORR(ra::DOUBLE, rb::DOUBLE), 6) AS spearman_rho FROM r GROUP BY lang""",
)
def spearman(spark, sf_dir):
    out = M.spearman(labelled_documents(spark, sf_dir), "score", "toxic", ["lang"])
    return rounded(out.withColumn("n", F.col("n").cast("long")))


_CONFUSION = """SELECT {k} tp, fp, fn, tn,
  CASE WHEN tp + fp > 0 THEN ROUND(tp / (tp + fp)::DOUBLE, 6) END AS precision,
  CASE WHEN tp + fn > 0 THEN ROUND(tp / (tp + fn)::DOUBLE, 6) END AS recall,
  CASE WHEN tn + fp > 0 THEN ROUND(tn / (tn + fp)::DOUBLE, 6) END AS specificity,
  CASE WHEN fp + tn > 0 THEN ROUND(fp / (fp + tn)::DOUBLE, 6) END AS fpr
FROM (SELECT {k} COUNT(*) FILTER (s >= 2000 AND y = 1) AS tp, COUNT(*) FILTER (s >= 2000 AND y = 0) AS fp,
  COUNT(*) FILTER (s < 2000 AND y = 1) AS fn, COUNT(*) FILTER (s < 2000 AND y = 0) AS tn FROM sl {g})"""


@query("confusion_at_threshold", f"WITH {SL} " + _CONFUSION.format(k="lang,", g="GROUP BY lang"))
def confusion_at_threshold(spark, sf_dir):
    return rounded(M.confusion(labelled_documents(spark, sf_dir), 2000.0, ["lang"]))


@query(
    "gate_summary_ppv",
    f"""WITH {SL}, m AS (SELECT SUM(CASE WHEN s >= 2000 AND y = 1 THEN 1 ELSE 0 END)::DOUBLE / SUM(y) AS recall,
  SUM(CASE WHEN s < 2000 AND y = 0 THEN 1 ELSE 0 END)::DOUBLE / SUM(1 - y) AS specificity FROM sl)
SELECT prevalence, ROUND(recall, 6) AS recall, ROUND(specificity, 6) AS specificity,
  ROUND(recall * prevalence / (recall * prevalence + (1 - specificity) * (1 - prevalence)), 6) AS ppv
FROM m, (SELECT UNNEST([0.5, 0.1, 0.01, 0.001, 0.0001])::DOUBLE AS prevalence)""",
)
def gate_summary_ppv(spark, sf_dir):
    out = M.gate_summary(labelled_documents(spark, sf_dir), 2000.0)
    return rounded(out.select("prevalence", "recall", "specificity", "ppv"))


_PICK = """
g AS (SELECT source, s, SUM(y)::BIGINT AS p, COUNT(*) AS m FROM sl GROUP BY source, s),
d AS (SELECT source, s, SUM(p) OVER w AS tp, SUM(m) OVER w AS called FROM g
  WINDOW w AS (PARTITION BY source ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cand AS (SELECT source, s AS cut, tp / called::DOUBLE AS prec, s AS pos FROM d WHERE called > 0
  UNION ALL SELECT source, NULL, SUM(p) / SUM(m)::DOUBLE, -1e300 FROM g GROUP BY source),
pos AS (SELECT source, SUM(p) AS pp FROM g GROUP BY source),
hit AS (SELECT source, MIN(pos) AS pos FROM cand JOIN pos USING (source) WHERE prec >= 0.9 AND pp > 0 GROUP BY source),
best AS (SELECT source, ARG_MAX(pos, ROW(prec, -pos)) AS pos FROM cand GROUP BY source),
pick AS (SELECT b.source, COALESCE(h.pos, b.pos) AS pos, h.pos IS NOT NULL AS reached FROM best b LEFT JOIN hit h USING (source))
"""


@query(
    "threshold_for_precision",
    f"""WITH {SL}, {_PICK} SELECT source, CASE WHEN pos > -1e300 THEN pos END AS cut, reached FROM pick""",
)
def threshold_for_precision(spark, sf_dir):
    picks = M.threshold_for_precision(labelled_documents(spark, sf_dir), 0.9, ["source"])
    return picks.select("source", "cut", "reached")


@query(
    "recall_at_precision",
    f"""WITH {SL}, {_PICK} SELECT source, ROUND(SUM(CASE WHEN s > pos AND y = 1 THEN 1 ELSE 0 END)::DOUBLE / NULLIF(SUM(y), 0), 6) AS recall
FROM sl JOIN pick USING (source) GROUP BY source""",
)
def recall_at_precision(spark, sf_dir):
    out = M.recall_at_precision(labelled_documents(spark, sf_dir), 0.9, ["source"])
    return rounded(out.select("source", "recall"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_ORDINAL = "(l_orderkey * 8 + l_linenumber) * 4194304 + (l_partkey * 1009 + l_suppkey) % 4194304"


@query(
    "metric_table_long",
    """WITH long AS (
  SELECT UNNEST(['l_quantity','l_extendedprice','l_discount','l_tax']) AS metric,
    UNNEST([l_quantity, l_extendedprice, -l_discount, l_tax]) AS s,
    (l_returnflag = 'R')::INT AS y, (l_orderkey * 8 + l_linenumber) * 4194304 + (l_partkey * 1009 + l_suppkey) % 4194304 AS o FROM lineitem),
r AS (SELECT metric, s, y, SUM(y) OVER w AS tp, ROW_NUMBER() OVER w AS k FROM long
  WINDOW w AS (PARTITION BY metric ORDER BY s DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT metric, SUM(CASE WHEN y = 1 THEN tp::DOUBLE / k END) / SUM(y) AS ap FROM r GROUP BY metric),
g AS (SELECT metric, s, SUM(y)::DOUBLE AS p, SUM(1 - y)::DOUBLE AS n FROM long GROUP BY metric, s),
c AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY metric ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cn FROM g),
a AS (SELECT metric, SUM(p) AS p, SUM(n) AS n, SUM(p * (cn + n / 2)) / (SUM(p) * SUM(n)) AS auroc FROM c GROUP BY metric),
rk AS (SELECT metric, RANK() OVER (PARTITION BY metric ORDER BY s) + (COUNT(*) OVER (PARTITION BY metric, s) - 1) / 2.0::DOUBLE AS ra, y FROM long),
rho AS (SELECT metric, CORR(ra, y::DOUBLE) AS rho FROM rk GROUP BY metric)
SELECT metric, (p + n)::BIGINT AS n, p::BIGINT AS n_positive, a.n::BIGINT AS n_negative, ROUND(p / (p + a.n), 6) AS baseline_ap,
  ROUND(rho, 6) AS spearman_rho, ROUND(auroc, 6) AS auroc, ROUND(ap, 6) AS ap
FROM a JOIN ap USING (metric) JOIN rho USING (metric)""",
)
def metric_table_long(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.expr(_LINE_ORDINAL).alias("ordinal"), (F.col("l_returnflag") == "R").cast("int").alias("label"), *_MEASURES
    )
    long = M.unpivot_metrics(lines, ["ordinal", "label"], _MEASURES, lower_is_better=["l_discount"])
    return rounded(M.metric_table(long, ["metric"]))


@query("metric_table_bucketed", ORACLES["metric_table_long"])
def metric_table_bucketed(spark, sf_dir):
    """The same table with order buckets small enough that every size of input has several."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.expr(_LINE_ORDINAL).alias("ordinal"), (F.col("l_returnflag") == "R").cast("int").alias("label"), *_MEASURES
    )
    long = M.unpivot_metrics(lines, ["ordinal", "label"], _MEASURES, lower_is_better=["l_discount"])
    return rounded(M.metric_table(long, ["metric"], rows_per_bucket=20_000))


@query(
    "strata_totals",
    f"""WITH {SL}, st AS (SELECT 'all' AS stratum, s, y, doc_id FROM sl UNION ALL SELECT source, s, y, doc_id FROM sl),
r AS (SELECT stratum, y, SUM(y) OVER w AS tp, ROW_NUMBER() OVER w AS k FROM st
  WINDOW w AS (PARTITION BY stratum ORDER BY s DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT stratum, COUNT(*) AS n, SUM(y)::BIGINT AS n_positive, ROUND(SUM(y) / COUNT(*)::DOUBLE, 6) AS baseline_ap,
  CASE WHEN SUM(y) > 0 AND SUM(y) < COUNT(*) THEN ROUND(SUM(CASE WHEN y = 1 THEN tp::DOUBLE / k END) / SUM(y), 6) END AS ap
FROM r GROUP BY stratum""",
)
def strata_totals(spark, sf_dir):
    rows = M.with_totals_stratum(labelled_documents(spark, sf_dir), "source")
    out = M.metric_table(rows, ["stratum"])
    return rounded(out.select("stratum", "n", "n_positive", "baseline_ap", "ap"))


_EDGES = [("low", -math.inf, 950.0), ("mid", 950.0, 1050.0), ("high", 1050.0, 1e6), ("none", 1e6, math.inf)]


@query(
    "bucket_summary",
    """WITH b AS (SELECT * FROM (VALUES (0, 'low', '-inf'::DOUBLE, 950.0::DOUBLE), (1, 'mid', 950.0, 1050.0), (2, 'high', 1050.0, 1e6), (3, 'none', 1e6, 'inf'::DOUBLE)) t(bucket_ord, bucket, lo, hi))
SELECT bucket, bucket_ord, COUNT(p_partkey) AS n, ROUND(AVG(p_size), 6) AS p_size_mean, ROUND(STDDEV_POP(p_size), 6) AS p_size_std
FROM b LEFT JOIN part ON p_retailprice > lo AND p_retailprice <= hi GROUP BY bucket, bucket_ord""",
)
def bucket_summary(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return rounded(M.bucket_summary(parts, "p_retailprice", ["p_size"], _EDGES))


@query(
    "leaderboard_best_per_group",
    """WITH long AS (
  SELECT l_shipdate, l_linestatus, UNNEST(['l_quantity','l_extendedprice','l_discount','l_tax']) AS metric,
    UNNEST([l_quantity, l_extendedprice, l_discount, l_tax]) AS s,
    (l_returnflag = 'R')::INT AS y, (l_orderkey * 8 + l_linenumber) * 4194304 + (l_partkey * 1009 + l_suppkey) % 4194304 AS o FROM lineitem),
r AS (SELECT l_linestatus, metric, y, SUM(y) OVER w AS tp, ROW_NUMBER() OVER w AS k FROM long
  WINDOW w AS (PARTITION BY l_linestatus, metric ORDER BY s DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT l_linestatus, metric, ROUND(SUM(CASE WHEN y = 1 THEN tp::DOUBLE / k END) / SUM(y), 6) AS ap FROM r GROUP BY ALL),
g AS (SELECT l_linestatus, metric, s, SUM(y)::DOUBLE AS p, SUM(1 - y)::DOUBLE AS n FROM long GROUP BY ALL),
c AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY l_linestatus, metric ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cn FROM g),
a AS (SELECT l_linestatus, metric, SUM(p)::BIGINT AS n_positive, SUM(n)::BIGINT AS n_negative, ROUND(SUM(p * (cn + n / 2)) / (SUM(p) * SUM(n)), 6) AS auroc FROM c GROUP BY ALL),
j AS (SELECT * FROM a JOIN ap USING (l_linestatus, metric)),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_linestatus ORDER BY ap DESC, auroc DESC, metric DESC) AS i FROM j)
SELECT l_linestatus AS comparison, 'lineitem' AS family, 'lineitem' AS source_table, metric AS best_metric,
  n_positive + n_negative AS n, n_positive, n_negative,
  ROUND(n_positive / (n_positive + n_negative)::DOUBLE, 6) AS baseline_ap, auroc, ap FROM k WHERE i = 1""",
)
def leaderboard_best_per_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.expr(_LINE_ORDINAL).alias("ordinal"),
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        *_MEASURES,
    )
    long = M.unpivot_metrics(lines, ["ordinal", "l_linestatus", "label"], _MEASURES)
    metrics = rounded(M.metric_table(long, ["l_linestatus", "metric"]))
    as_text = metrics.select(
        F.col("l_linestatus").alias("comparison"),
        *[F.col(c).cast("string").alias(c) for c in ("metric", "n", "n_positive", "n_negative", "baseline_ap", "auroc", "ap")],
    )
    candidates = R.family_candidates(as_text, "lineitem", _MEASURES, "lineitem", totals_only=True)
    return rounded(R.best_per_group(candidates, ["comparison", "family"]))


@query(
    "standardize",
    """WITH long AS (SELECT l_returnflag, UNNEST(['l_quantity','l_extendedprice','l_discount','l_tax']) AS feature,
  UNNEST([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem)
SELECT l_returnflag, feature, ROUND(AVG(x), 6) AS mean,
  ROUND(CASE WHEN STDDEV_POP(x) = 0 THEN 1.0 ELSE STDDEV_POP(x) END, 6) AS std FROM long GROUP BY ALL""",
)
def standardize(spark, sf_dir):
    return rounded(M.standardizer(table(spark, sf_dir, "lineitem"), _MEASURES, ["l_returnflag"]))
