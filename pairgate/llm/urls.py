r"""URL filtering by a rule list and by mined association rules, with DataFrame operations only.

Urls are judged once each.  A listed rule (host suffix and path prefix, the longest wins) decides
where one fits.  The urls so decided are the labelled ones: their tokens (host labels, path
segments, query keys) and their label are the transactions of Spark's FP-growth.  Rules of the
form *tokens => block* above a least support and confidence are kept and indexed under their
rarest token; an undecided url looks up its tokens, and a rule found there fires if all its tokens
are in the url.  ``mine`` takes any labelled urls; there need be no list.

Both indexes are broadcast when their counted size is under ``BROADCAST_ROWS`` and joined by key
beyond.  A url on a third of all rows is one row until the last join, whose two sides are plain
tables that Spark may split.

Defined cases: a null url, or one without ``://``, has an empty host and path, no tokens, no rule,
verdict allow; without blocked labels nothing is mined; repeated rows are judged each; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgate.llm.common import fold_case, stash

BROADCAST_ROWS = 50_000
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
BLOCKED = "label:block"


def host_of(url: Column) -> Column:
    return fold_case(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: h: host labels, p: path segments, q: query keys."""

    def parts(text: Column, by: str, mark: str) -> Column:
        return F.transform(
            F.filter(F.split(text, by), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x)
        )

    keys = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "=[^&]*", "")
    return F.array_distinct(
        F.concat(parts(host, r"\.", "h:"), parts(path, "/", "p:"), parts(keys, "&", "q:"))
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, prefix, rule, verdict) of a list of (rule, verdict), a rule as ``host/path``."""
    rows = [
        F.struct(
            F.lit(rule.partition("/")[0]).alias("key"),
            F.lit("/" + rule.partition("/")[2]).alias("prefix"),
            F.lit(rule).alias("rule"),
            F.lit(verdict).alias("verdict"),
        )
        for rule, verdict in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def within_bound(table: DataFrame) -> DataFrame:
    """Broadcast a small side whose rows were counted; leave a larger one to the planner."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def apply_list(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` with rule and verdict of the longest listed rule, null where none fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    own = urls.columns
    met = urls.withColumn("key", F.explode(suffixes)).join(within_bound(rules), "key", "left")
    fits = F.when(F.startswith("path", "prefix"), F.struct(F.length("rule").alias("n"), "rule", "verdict"))
    best = met.groupBy(*own).agg(F.max(fits).alias("best"))
    return best.select(*own, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(token, needed, confidence) of the rules tokens => block; token is the rarest of needed.

    ``labelled`` has tokens (array of string) and verdict (allow or block).
    """
    items = labelled.select(
        F.array_append("tokens", F.concat(F.lit("label:"), F.col("verdict"))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0] == BLOCKED).select(
        F.array_sort("antecedent").alias("needed"), "confidence"
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(
        F.col("items")[0].alias("token"), F.col("freq")
    )
    counted = rules.select("*", F.explode("needed").alias("token")).join(single, "token")
    return counted.groupBy("needed", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))


def apply_mined(urls: DataFrame, index: DataFrame) -> DataFrame:
    """``urls`` with confidence and pattern of the surest mined rule that fires, null where none."""
    own = urls.columns
    met = urls.withColumn("token", F.explode_outer("tokens")).join(within_bound(index), "token", "left")
    fires = F.when(
        F.size(F.array_except("needed", "tokens")) == 0,
        F.struct("confidence", F.array_join("needed", " ").alias("pattern")),
    )
    best = met.groupBy(*own).agg(F.max(fires).alias("best"))
    return best.select(*own, F.col("best.confidence").alias("confidence"), F.col("best.pattern").alias("pattern"))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, pattern for every row of ``pages``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")
    rows = pages.select(F.col(id_col).alias("page_id"), url)
    read = rows.select("url").distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    urls = read.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    listed = stash(apply_list(urls, rule_table(pages.sparkSession, rules)))
    index = stash(mine(listed.where("verdict IS NOT NULL"), min_support, min_confidence))
    judged = apply_mined(listed, index).select(
        "url",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence",
        "pattern",
    )
    return rows.join(stash(judged), "url").drop("url")
