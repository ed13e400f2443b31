"""Table functions for SQL text: windows and chains of a sequence, ordered partitions of a table.

``register`` makes them known to a session.  They exist for queries written in SQL; DataFrame code
has the column functions of ``functions.text``, which need no Python worker.

    SELECT doc_id, w.start, w.stop, w.part FROM documents, LATERAL sequence_windows(text, 1000) w
    SELECT c.* FROM pairs, LATERAL sequence_chains(antigen_seq, ':') c
    SELECT * FROM numbered_rows(TABLE(turns) PARTITION BY conv_id ORDER BY turn)
    SELECT * FROM head_rows(TABLE(turns) PARTITION BY conv_id ORDER BY (turn), 2)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, Row, StructField, StructType


@udtf(returnType="start int, stop int, part string")
class SequenceWindows:
    """Non-overlapping windows of a text; an empty one has the window (0, 0), NULL none."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, int, str]]:
        if size is None or size < 1:
            raise ValueError("a window has at least one character")
        if text is not None:
            for start in range(0, max(len(text), 1), size):
                part = text[start : start + size]
                yield start, start + len(part), part


@udtf(returnType="chain int, sequence string")
class SequenceChains:
    """The chains of a joined sequence, numbered from 0; empty ones keep their number."""

    def eval(self, text: str, separator: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(text.split(separator))


def _table_schema(table: AnalyzeArgument) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    return table.dataType


@udtf
class NumberedRows:
    """Rows of each partition of a table with their number ``nth`` in its order, from 1; the columns are
    those of the table that comes in."""

    def __init__(self) -> None:
        self._n = 0

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        fields = _table_schema(table).fields
        if any(f.name.lower() == "nth" for f in fields):
            raise ValueError("the table already has a column nth")
        return AnalyzeResult(StructType([*fields, StructField("nth", LongType())]))

    def eval(self, row: Row) -> Iterator[tuple]:
        self._n += 1
        yield (*row, self._n)


@udtf
class HeadRows:
    """The first rows of each partition of a table, in its order."""

    def __init__(self) -> None:
        self._n = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not n.isConstantExpression or not isinstance(n.dataType, (IntegerType, LongType)):
            raise ValueError("how many rows must be a constant whole number")
        return AnalyzeResult(_table_schema(table))

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        self._n += 1
        if self._n <= n:
            yield tuple(row)


FUNCTIONS = {
    "sequence_windows": SequenceWindows,
    "sequence_chains": SequenceChains,
    "numbered_rows": NumberedRows,
    "head_rows": HeadRows,
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


def register_views(spark: SparkSession, loaders: dict[str, DataFrame]) -> None:
    """Name loaded examples so that SQL can read them."""
    for name, df in loaders.items():
        df.createOrReplaceTempView(name)
