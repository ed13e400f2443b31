"""Every operator as a query over the given tables, with its independent SQL where there is one.

A query takes (spark, folder of Parquet tables) and returns a DataFrame; its SQL, when given, is
plain DuckDB over views of the same tables with the same column names.  Floats are rounded on
both sides because the two engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; -0.0 becomes 0.0."""
    cols: list[Column] = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        is_double = field.dataType.typeName() == "double"
        cols.append((F.round(c, digits) + F.lit(0.0)).alias(field.name) if is_double else c)
    return df.select(*cols)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined with labels: score = n_chars, label = quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id",
        "lang",
        "source",
        F.col("n_chars").cast("double").alias("score"),
        F.col("quality").cast("int").alias("label"),
        F.col("toxic").cast("int").alias("toxic"),
        F.col("doc_id").alias("ordinal"),
    )


# The same rows in SQL.
SL = """sl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars::DOUBLE AS s, l.quality AS y, l.toxic
  FROM documents d JOIN labels l USING (doc_id))"""


def load_all() -> None:
    """Import the topic modules, which register their queries."""
    from pairgate.catalogue import (  # noqa: F401
        features,
        metrics,
        models,
        relational,
        sampling,
        sequences,
        structures,
        text,
    )
