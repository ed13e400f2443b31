"""Exact dedup by a tree merge of sorted digest runs.

Every scanned partition makes one run: its texts' SHA-256 digests in order, copies inside the
run already merged.  Runs then meet in binomial rounds: in round r the runs whose numbers agree
beyond the lowest r digits (base ``fan_in``) exchange their entries by digest, each task merges
the sorted pieces it gets, and of equal digests one entry goes on, with the best row and the sum
of the counts.  A digest held by a third of all rows therefore enters a round at most once per
run, and no task ever merges more than its share of one tree level.  After the last round each
digest has one entry, and the documents read their group's entry by an equi-join.

Defined cases: null text is an empty text; empty texts are copies of each other; among equal
texts the longest original, then the smallest id, then the earliest row stays; a null id orders
after every other id; rows repeated with one id count as copies of each other, and exactly one
stays; an empty table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate.llm.common import WHITE, raw_texts, small_text_batches, stash

ENTRY = "digest binary, n_bytes long, n_chars long, doc_id long, row long, n long, tree long"


def digest_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, digest, n_bytes, n_chars); digest and bytes without white space."""
    for batch in batches:
        digests, sizes = [], []
        for text in raw_texts(batch.column("text")):
            bare = text.translate(None, WHITE)
            digests.append(hashlib.sha256(bare).digest())
            sizes.append(len(bare))
        chars = pc.fill_null(pc.cast(pc.utf8_length(batch.column("text")), pa.int64()), 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), chars],
            names=["doc_id", "digest", "n_bytes", "n_chars"],
        )


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, n_bytes (normalised), n_chars (original)."""
    small_text_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(digest_columns, "doc_id long, digest binary, n_bytes long, n_chars long")


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours of one tree node and digest in a sorted stream; the first, best, row stays.

    Equality is verified on the whole digest and the normalised length.  The entry that may
    continue in the next batch is held back, so memory is one batch.
    """
    held: dict | None = None
    for batch in batches:
        out: list[dict] = []
        for entry in batch.to_pylist():
            same = held is not None and (
                entry["tree"] == held["tree"]
                and entry["digest"] == held["digest"]
                and entry["n_bytes"] == held["n_bytes"]
            )
            if same:
                held["n"] += entry["n"]
            else:
                if held is not None:
                    out.append(held)
                held = entry
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([held], schema=batch.schema)


def merge_order() -> list:
    """Inside a tree node: by digest, the row that stays first."""
    return [F.col("tree"), F.col("digest"), F.desc("n_chars"), F.asc_nulls_last("doc_id"), F.col("row")]


def merge_runs(rows: DataFrame, n_runs: int, fan_in: int = 16) -> DataFrame:
    """Entries of one run number each to one entry per digest, in ceil(log(n_runs)/log(fan_in))
    exchanges."""
    level = rows.sortWithinPartitions(*merge_order()).mapInArrow(merge_sorted, ENTRY)
    for _ in range(max(1, math.ceil(math.log(max(n_runs, 2), fan_in) - 1e-9))):
        level = (
            level.withColumn("tree", F.floor(F.col("tree") / fan_in))
            .repartition(n_runs, "tree", "digest")
            .sortWithinPartitions(*merge_order())
            .mapInArrow(merge_sorted, ENTRY)
        )
    return level


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16
) -> tuple[DataFrame, DataFrame]:
    """(digests of all rows, one entry per distinct text)."""
    rows = stash(
        text_digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    )
    entries = rows.select(
        "digest",
        "n_bytes",
        "n_chars",
        "doc_id",
        "row",
        F.lit(1).cast("long").alias("n"),
        F.shiftright("row", 33).alias("tree"),  # the number of the partition that wrote the row
    )
    runs = entries.agg(F.max("tree")).first()[0]
    return rows, merge_runs(entries, int(runs or 0) + 1, fan_in)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups = exact_groups(docs, id_col, text_col, fan_in)
    best = groups.select(
        "digest",
        F.col("doc_id").alias("keep_id"),
        F.col("row").alias("keep_row"),
        F.col("n").alias("group_size"),
    )
    return rows.join(best, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is named by its id; only rows whose id is null or repeated are told apart by their text.
    """
    decided = stash(exact_dedup(docs, id_col, text_col))
    bare = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), WHITE.decode(), "")
    return rows_that_stay(docs, decided, F.sha2(bare, 256), id_col, text_col)


def rows_that_stay(docs: DataFrame, decided: DataFrame, sha: Column, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` kept by ``decided`` (doc_id, text_sha256, kept), whose digest is ``sha``
    of a row.  Of kept rows with one id and digest the one with the longest text stays.

    A row travels as one struct, so that none of its columns can clash with those used here."""
    unclear = stash(
        decided.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("id"))
    )
    gone = decided.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).union(unclear).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.struct("*").alias("row"))
    plain = rows.where("doc IS NOT NULL").join(stash(gone), F.col("doc") == F.col("id"), "left_anti").select("row.*")
    if unclear.isEmpty():
        return plain
    stays = (
        decided.where("kept")
        .join(unclear, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        .select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
        .distinct()
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told = docs.select(F.col(id_col).cast("long").alias("doc"), sha.alias("sha"), text.alias("words"), F.struct("*").alias("row"))
    told = told.join(stays, F.col("doc").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("digest")), "left_semi")
    best = F.max_by("row", F.struct(F.char_length("words"), "words"))
    return plain.unionByName(told.groupBy("doc", "sha").agg(best.alias("row")).select("row.*"))
