"""Delimited tables, matrices, FASTA, alignments, embeddings and archives as DataFrames."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairgate.functions import text as X
from pairgate.functions.numeric import nan_to_null, to_double
from pairgate.operators.relational import first_wins, last_wins, unpivot_matrix


def read_delimited(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = (),
    *,
    sep: str = ",",
    ordinal: bool = True,
    one_line: bool = False,
) -> DataFrame:
    """All-string table with header; listed columns the file lacks are added as NULL.

    Quoted cells may hold line breaks, so a file is read by one task; ``one_line`` says that none
    does, and lets Spark split large files.

    ``ordinal`` numbers the rows 0, 1, ... in file order: rows are numbered inside each file
    split, and splits are offset by the row counts of the earlier ones.
    """
    reader = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=not one_line)
    raw = reader.csv(path)
    names = list(raw.columns)
    added = [F.lit(None).cast("string").alias(c) for c in columns if c not in names]
    if not ordinal:
        return raw.select(*[F.col(f"`{c}`") for c in names], *added)
    placed = raw.select(
        *[F.col(f"`{c}`") for c in names],
        *added,
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    )
    splits = placed.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__lo"))
    w = Window.partitionBy(F.lit(0)).orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__path", "__start", "__lo", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    numbered = placed.join(offsets, ["__path", "__start"])
    position = (F.col("__off") + F.col("__id") - F.col("__lo")).cast("long")
    return numbered.select(*[F.col(f"`{c}`") for c in [*names, *[c for c in columns if c not in names]]], position.alias("ordinal"))


def read_scores(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Score table with its JSON extras as a struct of doubles.

    A typed schema reads bare NaN; malformed or blank JSON gives NULL for every key.
    """
    rows = read_delimited(spark, path, ("binder_format", "split", "label", "target_name", "source", "extras_json"))
    schema = ", ".join(f"`{k}` double" for k in keys) + ", missing string, error string"
    extras = F.from_json("extras_json", schema)
    clean = F.struct(*[nan_to_null(extras[k]).alias(k) for k in keys])
    return rows.select(
        "example_id",
        to_double("value").alias("value"),
        "label",
        "target_name",
        "source",
        "binder_format",
        "split",
        clean.alias("extras"),
        extras["missing"].alias("missing"),
        extras["error"].alias("error"),
        "ordinal",
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Square score matrix to (row_key, col_key, value), filled cells only."""
    wide = read_delimited(spark, path, ordinal=False)
    first, *columns = wide.columns
    return unpivot_matrix(wide.withColumnRenamed(first, "row"), "row", columns)


def read_manifest(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    return read_delimited(spark, path, columns, sep="\t")


def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, text): every file below ``root`` whose name matches the pattern, one row each."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    plain = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/")
    named = raw.select(plain.alias("path"), F.col("value").alias("text"))
    return named.select("path", F.substring_index("path", "/", -1).alias("name"), "text")


def relative_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(id, rel, name, path, text) of files in per-example folders: root/<id>/<rel>."""
    base = root.rstrip("/")
    rel = F.substring("path", len(base) + 2, 1 << 20)
    files = read_texts(spark, base, pattern).withColumn("__rel", rel)
    return files.select(
        F.substring_index("__rel", "/", 1).alias("id"),
        F.regexp_replace("__rel", "^[^/]*/", "").alias("rel"),
        "name",
        "path",
        "text",
    )


def read_fasta_chains(spark: SparkSession, root: str) -> DataFrame:
    """(id, chains) of two-line FASTA files 'a:b:c'; a file with fewer lines raises."""
    files = read_texts(spark, root, "*.fasta")
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.raise_error(F.concat(F.lit("FASTA too short: "), F.col("path")))
    return files.select(
        F.regexp_replace("name", r"\.fasta$", "").alias("id"),
        F.when(F.size(lines) >= 2, F.split(F.get(lines, F.lit(1)), ":")).otherwise(short).alias("chains"),
    )


def read_alignment_queries(spark: SparkSession, root: str, name: str = "*.a3m") -> DataFrame:
    """(path, query, hash): the line after the first header of every alignment."""
    query = F.trim(F.regexp_extract("text", r"(?s)(?:^|\n)>[^\n]*\n([^\n]*)", 1))
    found = read_texts(spark, root, name).select("path", query.alias("query"))
    return found.where(F.col("query") != "").withColumn("hash", X.hash16("query"))


def harvest_alignments(alignments: DataFrame, cache_dir: str) -> DataFrame:
    """Cache link per query: (source, destination); the last path wins for a repeated query."""
    latest = alignments.groupBy("hash").agg(F.max("path").alias("source"))
    return latest.select("source", F.concat(F.lit(cache_dir.rstrip("/") + "/"), "hash", F.lit(".a3m")).alias("destination"))


def read_sequence_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, hash) of '<seq>\\t<hash>' lines; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", "\t")
    return lines.select(F.get(parts, F.lit(0)).alias("sequence"), F.get(parts, F.lit(1)).alias("hash"))


def read_embeddings(spark: SparkSession, npy_path: str, keys_path: str, rows_per_task: int = 4096) -> DataFrame:
    """(key, embedding) from a float matrix file and its line-aligned keys.

    Tasks memory-map their own row range, so the matrix is never loaded whole; a row count that
    differs from the number of keys raises ValueError.
    """
    keys = read_delimited_lines(spark, keys_path)
    n = int(np.load(npy_path, mmap_mode="r").shape[0])
    found = keys.count()
    if found != n:
        raise ValueError(f"cache mismatch: {n} embeddings vs {found} keys")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = np.load(npy_path, mmap_mode="r")
        for batch in batches:
            part = matrix[batch["id"].to_numpy()]
            yield pd.DataFrame({"ordinal": batch["id"], "embedding": [row.tolist() for row in part]})

    slices = max(1, -(-n // rows_per_task))
    vectors = spark.range(0, n, 1, slices).mapInPandas(load, "ordinal long, embedding array<float>")
    return keys.join(vectors, "ordinal").select("key", "embedding")


def read_delimited_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, ordinal) of the non-empty lines of a text file, numbered in file order."""
    raw = spark.read.text(path).select(
        F.col("value").alias("key"),
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    ).where(F.col("key") != "")
    w = Window.partitionBy("__path", "__start").orderBy("__id")
    numbered = raw.withColumn("__k", F.row_number().over(w) - 1)
    splits = raw.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("__n"))
    across = Window.partitionBy(F.lit(0)).orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__path", "__start", F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__off"))
    return numbered.join(offsets, ["__path", "__start"]).select(
        "key", (F.col("__off") + F.col("__k")).cast("long").alias("ordinal")
    )


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, compress_size, file_size, ordinal): the central directory of a ZIP archive."""
    with zipfile.ZipFile(path) as archive:
        rows = [(m.filename, m.compress_size, m.file_size, i) for i, m in enumerate(archive.infolist())]
    return spark.createDataFrame(rows, "name string, compress_size long, file_size long, ordinal long")


def archive_members(members: DataFrame, path: str) -> DataFrame:
    """Add the text of each named member; every task reads only the members of its rows."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with zipfile.ZipFile(path) as archive:
            for batch in batches:
                texts = [archive.read(n).decode("utf-8", "replace") for n in batch["name"]]
                yield pd.DataFrame({"name": batch["name"], "text": texts})

    return members.select("name").mapInPandas(load, "name string, text string")


def model_entries(index: DataFrame, model: int) -> DataFrame:
    """First archive member of each (vhh, antigen) pair for one model number."""
    parsed = index.withColumn("m", X.archive_member("name")).where(F.col("m").isNotNull())
    rows = parsed.where(F.col("m.model") == model).select(
        F.upper("m.vhh_pdb").alias("vhh_pdb"),
        F.upper("m.antigen_pdb").alias("antigen_pdb"),
        "name",
        "compress_size",
        "file_size",
        F.col("m.system_i").alias("system_i"),
        F.col("m.system_j").alias("system_j"),
        "ordinal",
    )
    return first_wins(rows, ["vhh_pdb", "antigen_pdb"], "ordinal")


def archive_manifest(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """Matrix pairs with their archive member; pairs without one have a NULL ``member_name``."""
    pairs = cells.select(F.upper(F.trim("row_key")).alias("vhh_pdb"), F.upper(F.trim("col_key")).alias("antigen_pdb"))
    return pairs.join(entries.drop("ordinal"), ["vhh_pdb", "antigen_pdb"], "left").select(
        X.pair_id("vhh_pdb", "antigen_pdb").alias("example_id"),
        "vhh_pdb",
        "antigen_pdb",
        (F.col("vhh_pdb") == F.col("antigen_pdb")).cast("int").alias("label"),
        F.col("name").alias("member_name"),
        "system_i",
        "system_j",
        "compress_size",
        "file_size",
    )


def join_antigens(records: DataFrame, antigens: DataFrame) -> DataFrame:
    """Binding records with their antigen sequence; unusable records are dropped, ids keep gaps.

    ``records`` has the raw column names and an ordinal; ``antigens`` may use any of three
    spellings for the label and the sequence.
    """
    have = set(antigens.columns)

    def first_of(*names: str) -> Column:
        present = [F.nullif(F.col(n), F.lit("")) for n in names if n in have]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    dim = antigens.select(
        first_of("Ag_label", "antigen_label", "label").alias("antigen_label"),
        first_of("antigen_sequence", "Ag_sequence", "sequence").alias("antigen_sequence"),
        "ordinal",
    ).where(F.col("antigen_label").isNotNull() & F.col("antigen_sequence").isNotNull())
    dim = last_wins(dim, ["antigen_label"], "ordinal").drop("ordinal")
    usable = F.coalesce(F.length("VHH_sequence") > 0, F.lit(False)) & F.col("label").isin("0", "1")
    kept = records.where(usable).withColumn("antigen_label", F.col("Ag_label")).join(dim, "antigen_label")
    return kept.select(
        F.concat(F.lit("avida-"), F.col("ordinal").cast("string")).alias("vhh_id"),
        F.col("VHH_sequence").alias("vhh_sequence"),
        "antigen_label",
        "antigen_sequence",
        "label",
    )
