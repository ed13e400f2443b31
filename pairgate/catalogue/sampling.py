"""Folds and negative construction; draws are MD5-based, so SQL reproduces them exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgate.catalogue import query, table
from pairgate.operators import sampling as S

# Uniform number in [0, 1) from MD5, and an integer below n.
_U = "('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_DRAW = "FLOOR(" + _U + " * ({1}))::BIGINT"


def _positives(spark, sf_dir):
    """Documents as positives: cluster = source, fold and item from their length."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("pair_id"),
        F.concat("lang", F.lit("-"), F.col("n_chars") % 7).alias("antigen_seq"),
        F.col("source").alias("antigen_cluster"),
        (F.col("n_chars") % 5).cast("int").alias("fold"),
    )


_POS = """pos AS (SELECT doc_id::VARCHAR AS pair_id, lang || '-' || (n_chars % 7) AS antigen_seq, source AS antigen_cluster, (n_chars % 5)::INT AS fold FROM documents)"""


@query(
    "neg_sampling_k",
    f"""WITH {_POS},
sizes AS (SELECT fold, antigen_cluster, COUNT(*) AS w FROM pos GROUP BY ALL),
spans AS (SELECT *, COALESCE(SUM(w) OVER (PARTITION BY fold ORDER BY {_U.format("antigen_cluster")}, antigen_cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM sizes),
tot AS (SELECT fold, SUM(w) AS total FROM sizes GROUP BY fold),
d AS (SELECT pair_id, fold, j, lo AS own_lo, w AS own_w, {_DRAW.format("pair_id || '|7|' || j || '|cluster'", "total - w")} AS raw
  FROM pos JOIN spans USING (fold, antigen_cluster) JOIN tot USING (fold), range(5) t(j) WHERE total > w),
e AS (SELECT pair_id, fold, j, raw + CASE WHEN raw >= own_lo THEN own_w ELSE 0 END AS at FROM d),
h AS (SELECT e.pair_id, e.fold, e.j, s.antigen_cluster FROM e JOIN spans s ON s.fold = e.fold AND e.at >= s.lo AND e.at < s.lo + s.w),
pool AS (SELECT fold, antigen_cluster, antigen_seq, ROW_NUMBER() OVER (PARTITION BY fold, antigen_cluster ORDER BY {_U.format("antigen_seq")}, antigen_seq) - 1 AS i,
  COUNT(*) OVER (PARTITION BY fold, antigen_cluster) AS n FROM (SELECT DISTINCT fold, antigen_cluster, antigen_seq FROM pos))
SELECT h.pair_id, h.j::INT AS j, h.fold, h.antigen_cluster, p.antigen_seq FROM h JOIN pool p ON p.fold = h.fold AND p.antigen_cluster = h.antigen_cluster
  AND p.i = {_DRAW.format("h.pair_id || '|7|' || h.j || '|item'", "p.n")}""",
)
def neg_sampling_k(spark, sf_dir):
    return S.shuffled_negatives(_positives(spark, sf_dir), k=5, seed=7)


@query(
    "negative_invariants",
    f"""WITH {_POS},
c AS (SELECT fold, COUNT(DISTINCT antigen_cluster) AS n FROM pos GROUP BY fold)
SELECT 0::BIGINT AS n_violations, 2 * COUNT(*) AS n_negatives, COUNT(DISTINCT pair_id) AS n_positives
FROM pos JOIN c USING (fold) WHERE n > 1""",
)
def negative_invariants(spark, sf_dir):
    """Two negatives for every positive of a fold with several clusters, none breaking an invariant."""
    positives = _positives(spark, sf_dir)
    negatives = S.shuffled_negatives(positives, k=2, seed=11)
    broken = S.pair_violations(negatives, positives).agg(F.count(F.lit(1)).alias("n_violations"))
    made = negatives.agg(
        F.count(F.lit(1)).alias("n_negatives"), F.count_distinct("pair_id").alias("n_positives")
    )
    return broken.join(made)


@query(
    "pool_negatives",
    f"""WITH pool AS (SELECT item, ROW_NUMBER() OVER (ORDER BY {_U.format("item")}, item) - 1 AS i FROM (SELECT DISTINCT text AS item FROM benchmark)),
m AS (SELECT COUNT(*) AS n FROM pool),
d AS (SELECT doc_id::VARCHAR AS row_id, {_DRAW.format("doc_id || '|3|0'", "n")} AS r0, {_DRAW.format("doc_id || '|3|1'", "n - 1")} AS r1, {_DRAW.format("doc_id || '|3|2'", "n - 2")} AS r2 FROM labels, m),
e AS (SELECT row_id, r0 AS i0, r1 + (r1 >= r0)::INT AS i1, r2 FROM d),
f AS (SELECT row_id, i0, i1, r2 + (r2 >= LEAST(i0, i1))::INT AS q FROM e),
x AS (SELECT row_id, UNNEST([0, 1, 2]) AS j, UNNEST([i0, i1, q + (q >= GREATEST(i0, i1))::INT]) AS i FROM f)
SELECT row_id, j::INT AS j, item FROM x JOIN pool USING (i)""",
)
def pool_negatives(spark, sf_dir):
    positives = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("row_id"))
    pool = table(spark, sf_dir, "benchmark").select(F.col("text").alias("item"))
    return S.pool_negatives(positives, pool, k=3, seed=3, row="row_id", item="item")


@query(
    "wrong_target_donors",
    f"""WITH p AS (SELECT p_partkey::VARCHAR AS id, p_brand AS k FROM part),
donors AS (SELECT id, k, ROW_NUMBER() OVER (ORDER BY {_U.format("k")}, k, {_U.format("id")}, id) - 1 AS position FROM p),
spans AS (SELECT k, MIN(position) AS lo, COUNT(*) AS w FROM donors GROUP BY k),
d AS (SELECT id, lo, w, {_DRAW.format("id || '|5|0'", "n - w")} AS r0, {_DRAW.format("id || '|5|1'", "n - w - 1")} AS r1 FROM p JOIN spans USING (k), (SELECT COUNT(*) AS n FROM p)),
x AS (SELECT id, lo, w, UNNEST([1, 2]) AS pick, UNNEST([r0, r1 + (r1 >= r0)::INT]) AS r FROM d)
SELECT x.id AS example_id, pick::INT AS pick, donors.id AS donor_id FROM x JOIN donors ON position = r + CASE WHEN r >= lo THEN w ELSE 0 END""",
)
def wrong_target_donors(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("example_id"), F.col("p_brand").alias("target_key")
    )
    return S.wrong_targets(parts, parts, m=2, seed=5)


@query(
    "theta_self_join",
    """SELECT a.s_suppkey, COUNT(b.s_suppkey) AS n_other FROM supplier a LEFT JOIN supplier b ON a.s_nationkey <> b.s_nationkey GROUP BY a.s_suppkey""",
)
def theta_self_join(spark, sf_dir):
    """How many rows have another key: everything minus the own block, without a non-equi join."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sizes = rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("w"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.join(sizes, "s_nationkey").select("s_suppkey", (total - F.col("w")).alias("n_other"))


@query("grouped_folds_leakfree", "SELECT source, COUNT(*) AS n, 1::BIGINT AS n_folds FROM documents GROUP BY source")
def grouped_folds_leakfree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    folds = S.assign_folds(docs, "source", n_splits=5, seed=20260601)
    return folds.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("n_folds")
    )


@query(
    "grouped_folds",
    f"""WITH g AS (SELECT source, ROW_NUMBER() OVER (ORDER BY {_U.format("source || '|20260601'")}) - 1 AS i FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, (i % 5)::INT AS fold FROM documents JOIN g USING (source)""",
)
def grouped_folds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.assign_folds(docs, "source", n_splits=5, seed=20260601)


_LOOPS = [[0, 1, 2], [4, 5, 6, 7]]


@query(
    "loop_scramble",
    f"""WITH s AS (SELECT doc_id::VARCHAR AS id, substr(text || 'ACDEFGHIKL', 1, 1000000) AS t FROM documents),
loops AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, 2), (1, 4), (1, 5), (1, 6), (1, 7)) v(l, p)),
src AS (SELECT id, t, l, p, ROW_NUMBER() OVER (PARTITION BY id, l ORDER BY {_U.format("id || '|9|1|' || p")}, p) AS k FROM s, loops),
dst AS (SELECT id, l, p, ROW_NUMBER() OVER (PARTITION BY id, l ORDER BY p) AS k FROM s, loops),
m AS (SELECT dst.id, dst.p AS pos, substr(src.t, src.p + 1, 1) AS c FROM dst JOIN src USING (id, l, k))
SELECT id, STRING_AGG(c, '' ORDER BY pos) FILTER (WHERE pos < 3) || substr(ANY_VALUE(t), 4, 1) || STRING_AGG(c, '' ORDER BY pos) FILTER (WHERE pos > 3) || substr(ANY_VALUE(t), 9) AS scrambled
FROM m JOIN s USING (id) GROUP BY id""",
)
def loop_scramble(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat("text", F.lit("ACDEFGHIKL")).alias("t")
    )
    loops = F.array(*[F.array(*[F.lit(p) for p in loop]) for loop in _LOOPS])
    return docs.select("id", S.scramble_loops("t", loops, "id", 9, 1).alias("scrambled"))
