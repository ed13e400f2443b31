"""Joins, picks, labels and orderings over the star schema, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgate.catalogue import query, rounded, table
from pairgate.functions.numeric import missing_flag, to_double, to_int_or_zero
from pairgate.operators import metrics as M
from pairgate.operators import relational as R
from pairgate.operators.ordered import dense_index
from pairgate.plans.analysis import confidence_columns
from pairgate.sources.sinks import distinct_chain_sequences, uncached


@query(
    "first_wins_dedup",
    """SELECT o_custkey, ARG_MIN(o_totalprice, o_orderkey) AS o_totalprice, MIN(o_orderkey) AS o_orderkey, COUNT(*) AS n_systems
FROM orders GROUP BY o_custkey""",
)
def first_wins_dedup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.first_wins(orders, ["o_custkey"], "o_orderkey", count="n_systems")


@query(
    "last_wins_index",
    """SELECT o_custkey, ARG_MAX(o_totalprice, o_orderkey) AS o_totalprice, MAX(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey""",
)
def last_wins_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.last_wins(orders, ["o_custkey"], "o_orderkey")


@query("first_seen_values", "SELECT p_type, MIN(p_partkey) AS p_partkey FROM part GROUP BY p_type")
def first_seen_values(spark, sf_dir):
    return R.first_seen(table(spark, sf_dir, "part"), "p_type", "p_partkey")


@query(
    "distinct_union",
    """SELECT DISTINCT UNNEST(STRING_SPLIT(s, ' ')) AS seq FROM (SELECT p_name AS s FROM part UNION ALL SELECT p_type FROM part)""",
)
def distinct_union(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pairs = part.select(F.col("p_type").alias("binder_seq"), F.replace("p_name", F.lit(" "), F.lit(":")).alias("antigen_seq"))
    return distinct_chain_sequences(pairs).select(F.col("sequence").alias("seq"))


@query(
    "inner_left_join_drop_null",
    """SELECT o_orderkey, c_mktsegment, o_totalprice, MAX(l_tax) AS max_tax FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE o_orderstatus <> 'O' GROUP BY ALL""",
)
def inner_left_join_drop_null(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    returned = (
        table(spark, sf_dir, "lineitem")
        .where("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_tax").alias("max_tax"))
    )
    joined = orders.join(customer, "o_custkey").join(returned, "o_orderkey", "left")
    return joined.select("o_orderkey", "c_mktsegment", "o_totalprice", "max_tax")


@query(
    "score_join",
    """WITH conf AS (SELECT user_id AS id, ARG_MAX(value, event_id) AS v, ARG_MAX((props->>'k')::DOUBLE, event_id) AS k,
    ARG_MAX(event_type, event_id) AS fmt FROM events WHERE event_type <> 'purchase' GROUP BY user_id),
ref AS (SELECT user_id AS id, ARG_MAX(value, event_id) AS rmsd FROM events WHERE event_type = 'purchase' GROUP BY user_id),
q AS (SELECT user_id AS id, ARG_MAX((props->>'k')::DOUBLE, event_id) AS dockq FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT id::VARCHAR AS example_id, k, rmsd, dockq AS dockq_best, fmt AS binder_format FROM conf JOIN ref USING (id) LEFT JOIN q USING (id)""",
)
def score_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("example_id"),
        F.col("event_id").alias("ordinal"),
        "value",
        F.col("event_type").alias("binder_format"),
        F.from_json("props", "k double").alias("extras"),
    )
    clicks = events.where("binder_format = 'click'").withColumn(
        "extras", F.struct(F.col("extras.k").alias("dockq_best"))
    )
    joined = R.join_scores(
        events.where("binder_format <> 'purchase'"), events.where("binder_format = 'purchase'"), clicks, ["k"]
    )
    return joined.drop("ordinal")


@query(
    "value_as_score",
    """SELECT event_id::VARCHAR AS example_id, event_type AS label, value AS iptm, (props->>'k')::DOUBLE AS ptm FROM events""",
)
def value_as_score(spark, sf_dir):
    """Score rows whose value is the interface score and whose extras are the other metrics."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("example_id"),
        F.col("event_type").alias("label"),
        F.col("event_id").alias("ordinal"),
        "value",
        F.from_json(F.replace("props", F.lit('"k"'), F.lit('"ptm"')), "ptm double").alias("extras"),
    )
    return confidence_columns(rows, ("iptm", "ptm")).drop("ordinal")


@query(
    "semi_join",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def semi_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.members_of(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "anti_join",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def anti_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return uncached(docs.withColumnRenamed("doc_id", "id"), done).withColumnRenamed("id", "doc_id")


@query(
    "leakage_keys",
    """SELECT DISTINCT c_nationkey AS nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)""",
)
def leakage_keys(spark, sf_dir):
    train = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    evals = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return R.shared_keys(evals, train, ["nationkey"])


@query(
    "double_dim_join",
    """SELECT l_orderkey, l_linenumber, cn.n_name AS customer_nation, sn.n_name AS supplier_nation FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey""",
)
def double_dim_join(spark, sf_dir):
    return _line_nations(spark, sf_dir).drop("l_extendedprice")


def _line_nations(spark, sf_dir):
    """Line items with the nations of both sides: the nation table joined twice."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    sides = {"c_nationkey": {"n_name": "customer_nation"}, "s_nationkey": {"n_name": "supplier_nation"}}
    keyed = lines.join(orders, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey")
    return R.two_sided_lookup(keyed, nation, "n_nationkey", sides).select(
        "l_orderkey", "l_linenumber", "customer_nation", "supplier_nation", "l_extendedprice"
    )


@query(
    "strict_lookup",
    """SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def strict_lookup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return R.strict_lookup(lines, parts, ["l_partkey"], "part").drop("l_partkey")


_FLAGS = ["A", "N", "R"]


@query(
    "pair_matrix_unpivot",
    """WITH m AS (SELECT l_linestatus AS row_key, l_returnflag AS col_key, ROUND(AVG(l_quantity), 4) AS value FROM lineitem GROUP BY ALL)
SELECT row_key, col_key, value FROM m""",
)
def pair_matrix_unpivot(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    wide = lines.groupBy("l_linestatus").pivot("l_returnflag", _FLAGS).agg(F.avg("l_quantity"))
    as_text = wide.select("l_linestatus", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _FLAGS])
    return rounded(R.unpivot_matrix(as_text, "l_linestatus", _FLAGS), 4)


@query(
    "matrix_pairs",
    """WITH cells AS (SELECT sn.n_name AS r, cn.n_name AS c, ROUND(SUM(l_extendedprice), 2) AS value FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY ALL)
SELECT r || '__' || c AS pair_id, r AS vhh_pdb, c AS antigen_pdb, (r = c)::INT AS label, value, a.n_regionkey AS row_region, b.n_regionkey AS col_region
FROM cells JOIN nation a ON a.n_name = r JOIN nation b ON b.n_name = c""",
)
def matrix_pairs(spark, sf_dir):
    cells = (
        _line_nations(spark, sf_dir)
        .groupBy(F.col("supplier_nation").alias("row_key"), F.col("customer_nation").alias("col_key"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    )
    meta = table(spark, sf_dir, "nation")
    return R.matrix_pairs(cells, meta, "n_name", {"n_regionkey": "row_region"}, {"n_regionkey": "col_region"})


_SPECS = [("view_vs_rest", ["view"], ["click", "error", "purchase"]), ("view_vs_error", ["view"], ["error"])]


@query(
    "label_contrasts",
    """SELECT 'view_vs_rest' AS comparison, (event_type = 'view')::INT AS y, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean_value
FROM events WHERE event_type IN ('view', 'click', 'error', 'purchase') GROUP BY ALL
UNION ALL SELECT 'view_vs_error', (event_type = 'view')::INT, COUNT(*), ROUND(AVG(value), 6) FROM events WHERE event_type IN ('view', 'error') GROUP BY ALL""",
)
def label_contrasts(spark, sf_dir):
    rows = R.contrast_rows(table(spark, sf_dir, "events"), "event_type", _SPECS)
    return rounded(
        rows.groupBy("comparison", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    )


@query(
    "quality_labels",
    """SELECT label, y, COUNT(*) AS n FROM (SELECT UNNEST(['rmsd<4A', 'rmsd<8A', 'dockq_best>=0.23']) AS label,
  UNNEST([(value < 4)::INT, (value < 8)::INT, CASE WHEN event_type = 'click' THEN ((props->>'k')::DOUBLE / 100 >= 0.23)::INT END]) AS y FROM events)
WHERE y IS NOT NULL GROUP BY ALL""",
)
def quality_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("value").alias("rmsd"),
        F.when(F.col("event_type") == "click", F.from_json("props", "k double")["k"] / F.lit(100.0)).alias("dockq_best"),
    )
    return R.label_rows(events, R.quality_labels()).groupBy("label", "y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "near_native_vs_negative",
    """WITH r AS (SELECT event_id, value AS s, CASE WHEN event_type = 'error' THEN 0 WHEN (props->>'k')::DOUBLE < 40 THEN 1 END AS y FROM events),
g AS (SELECT s, SUM(y)::DOUBLE AS p, SUM(1 - y)::DOUBLE AS n FROM r WHERE y IS NOT NULL GROUP BY s),
c AS (SELECT *, COALESCE(SUM(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cn FROM g)
SELECT (SUM(p) + SUM(n))::BIGINT AS n, SUM(p)::BIGINT AS n_positive, SUM(n)::BIGINT AS n_negative, ROUND(SUM(p * (cn + n / 2)) / (SUM(p) * SUM(n)), 6) AS auroc FROM c""",
)
def near_native_vs_negative(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("rmsd", F.from_json("props", "k double")["k"])
    label = R.near_native_label(F.col("event_type") != "error", "rmsd", 40.0)
    return rounded(M.auroc(events.withColumn("y", label), score="value", label="y"))


@query(
    "missing_flag",
    """SELECT event_id, CASE WHEN TRY_CAST(t AS DOUBLE) IS NOT NULL THEN 0.0::DOUBLE ELSE 1.0 END AS flag, TRY_CAST(t AS DOUBLE) AS number
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type ELSE value::VARCHAR END AS t FROM events)""",
)
def missing_flags(spark, sf_dir):
    cell = (
        F.when(F.col("event_id") % 3 == 0, "")
        .when(F.col("event_id") % 3 == 1, F.col("event_type"))
        .otherwise(F.col("value").cast("string"))
    )
    events = table(spark, sf_dir, "events").withColumn("t", cell)
    return events.select("event_id", missing_flag("t").alias("flag"), to_double("t").alias("number"))


@query(
    "tolerant_cast",
    """SELECT p_partkey, COALESCE(TRUNC(TRY_CAST(regexp_replace(p_brand, 'Brand#', '') AS DOUBLE))::BIGINT, 0) AS brand,
COALESCE(TRUNC(TRY_CAST(p_name AS DOUBLE))::BIGINT, 0) AS name_number FROM part""",
)
def tolerant_cast(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        to_int_or_zero(F.regexp_replace("p_brand", "Brand#", "")).alias("brand"),
        to_int_or_zero("p_name").alias("name_number"),
    )


@query(
    "json_extras",
    """SELECT event_type, COUNT(*) AS n, ROUND(AVG((props->>'k')::DOUBLE), 6) AS mean_k, ROUND(MAX((props->>'k')::DOUBLE), 6) AS max_k,
  COUNT(*) FILTER ((props->>'k')::DOUBLE IS NULL) AS n_missing FROM events GROUP BY event_type""",
)
def json_extras(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("e", F.from_json("props", "k double, missing string"))
    k = F.col("e.k")
    return rounded(
        events.groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(k).alias("mean_k"),
            F.max(k).alias("max_k"),
            F.count_if(k.isNull()).alias("n_missing"),
        )
    )


@query(
    "exclusion_flags",
    """SELECT o_orderstatus, COUNT(*) FILTER (o_orderstatus = 'F') AS included, COUNT(*) FILTER (o_orderstatus <> 'O') AS not_excluded FROM orders GROUP BY ALL""",
)
def exclusion_flags(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "F", " false").when(F.col("o_orderstatus") == "O", "TRUE").otherwise("")
    orders = table(spark, sf_dir, "orders").withColumn("is_excluded", flag)
    return orders.groupBy("o_orderstatus").agg(
        F.count_if(R.keep_included()).alias("included"), F.count_if(R.keep_not_excluded()).alias("not_excluded")
    )


_PRIORITY = {"1-URGENT": 0, "5-LOW": 1, "3-MEDIUM": 2}


@query(
    "custom_order_sort",
    """SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END AS position FROM orders GROUP BY ALL""",
)
def custom_order_sort(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("position", R.order_rank("o_orderpriority", _PRIORITY))
    return ranked.orderBy("position", "o_orderpriority", "o_orderstatus")


@query(
    "top_k_per_group",
    """SELECT c_mktsegment, c_custkey, c_acctbal, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) WHERE rank <= 5""",
)
def top_k_per_group(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return R.top_k_per_group(customer, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)


@query(
    "quota_head",
    """WITH q AS (SELECT * FROM (VALUES ('en', 8), ('fr', 8), ('de', 4)) t(lang, quota)),
r AS (SELECT doc_id, d.lang, n_chars, ROW_NUMBER() OVER (PARTITION BY d.lang ORDER BY doc_id) AS k FROM documents d)
SELECT doc_id, lang, n_chars FROM r JOIN q USING (lang) WHERE k <= quota""",
)
def quota_head(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return R.quota_head(docs, "lang", "doc_id", 20, {"en": 8, "fr": 8, "de": 4})


@query(
    "near_then_far",
    """SELECT event_id::VARCHAR AS example_id, value AS rmsd FROM events ORDER BY value < 8 DESC, value, event_id::VARCHAR LIMIT 30""",
)
def near_then_far(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("example_id"), F.col("value").alias("rmsd")
    )
    return R.near_then_far(events, 30)


@query(
    "round_robin_shard",
    """SELECT p_partkey, (i % 7)::INT AS shard, (i // 500)::INT AS task FROM (SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS i FROM part)""",
)
def round_robin_shard(spark, sf_dir):
    parts = dense_index(table(spark, sf_dir, "part").select("p_partkey"), [], "p_partkey")
    return R.chunked(R.round_robin(parts, "index", 7), "index", 500).drop("index")


@query(
    "group_counters",
    """SELECT source, COUNT(*) AS n, COUNT(*) FILTER (quality = 1) AS n_positive, ROUND(1 - AVG((quality >= 0.5)::INT), 6) AS failure_rate
FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def group_counters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(
        docs.groupBy("source").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("quality") == 1).alias("n_positive"),
            R.failure_rate("quality").alias("failure_rate"),
        )
    )


@query(
    "cross_set_overlap",
    """SELECT doc_id, source FROM documents d WHERE lang = 'en' AND source IN (SELECT source FROM documents WHERE lang = 'de')""",
)
def cross_set_overlap(spark, sf_dir):
    origin = F.when(F.col("lang") == "en", "eval").when(F.col("lang") == "de", "train")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", origin.alias("origin"))
    return R.overlapping_ids(docs.where("origin IS NOT NULL"), "source").select("doc_id", "source")


@query(
    "missing_structures",
    """SELECT c_nationkey, COUNT(*) AS n, COUNT(*) FILTER (o_custkey IS NULL) AS n_missing FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY c_nationkey""",
)
def missing_structures(spark, sf_dir):
    index = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    joined = table(spark, sf_dir, "customer").join(index, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_custkey").isNull()).alias("n_missing")
    )


_TABLE_ORDER_SQL = "CASE split WHEN 'all' THEN 0 WHEN 'random_pair' THEN 1 WHEN 'held_out_vhh' THEN 2 WHEN 'held_out_antigen' THEN 3 ELSE 99 END"


@query(
    "combine_predictor_tables",
    f"""WITH t AS (SELECT lang AS predictor, CASE WHEN doc_id % 3 = 0 THEN 'random_pair' WHEN doc_id % 3 = 1 THEN 'all' ELSE 'other' END AS split,
  'raw_iptm' AS model, n_chars FROM documents)
SELECT * FROM (SELECT predictor, split, model, COUNT(*) AS n, SUM(n_chars)::BIGINT AS chars FROM t GROUP BY ALL) ORDER BY predictor, {_TABLE_ORDER_SQL}""",
)
def combine_predictor_tables(spark, sf_dir):
    split = F.when(F.col("doc_id") % 3 == 0, "random_pair").when(F.col("doc_id") % 3 == 1, "all").otherwise("other")
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("predictor"), split.alias("split"), F.lit("raw_iptm").alias("model"), "n_chars"
    )
    per = lambda cond: docs.where(cond).groupBy("predictor", "split", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )
    return R.combine_predictor_tables([per("predictor = 'en'"), per("predictor <> 'en'")])
