"""Shared pieces: the shared folder, written intermediate tables, text expressions, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D], and the letters folded by them.
WHITE = b" \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Rows of text that one Arrow batch may hold; texts may be long, and a task holds a few batches.
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session without one (a test) must set it first."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage is cut there,
    work above it is done once, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairgate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_text_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for operators that read whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def fold_case(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in pc.cast(column, kind).to_pylist()]


def chunks(items: Iterator, size: int) -> Iterator[list]:
    held: list = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
