"""Embeddings of long sequences from those of their windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgate.functions.vectors import as_doubles


def pool_windows(df: DataFrame, keys: Sequence[str], embedding: str = "embedding", length: str = "length") -> DataFrame:
    """(keys, embedding, length): the mean of the windows' embeddings weighted by their lengths.

    Sums are added up per dimension, in every partition first, so a key may have any number of
    windows.  Windows without an embedding or of no length count nothing; a key without any other has
    none.  Windows of different widths raise.
    """
    usable = df.where(F.col(embedding).isNotNull() & (F.col(length) > 0))
    flat = usable.select(*keys, F.col(length).alias("__w"), F.size(embedding).alias("__d"), F.posexplode(as_doubles(embedding)).alias("__k", "__x"))
    sums = flat.groupBy(*keys, "__k").agg(
        (F.sum(F.col("__x") * F.col("__w")) / F.sum("__w")).alias("__v"),
        F.sum("__w").alias("__w"),
        F.min("__d").alias("__lo"),
        F.max("__d").alias("__hi"),
    )
    same = F.when(F.min("__lo") == F.max("__hi"), F.lit(True)).otherwise(F.raise_error(F.lit("windows of different widths")))
    ordered = F.array_sort(F.collect_list(F.struct("__k", "__v")))  # as many as dimensions
    pooled = sums.groupBy(*keys).agg(ordered.alias("__o"), F.max("__w").alias(length), same.alias("__same"))
    return pooled.where("__same").select(*keys, F.col("__o.__v").alias(embedding), length)
