"""Sinks: score files, metric tables, strict JSON reports, and the files staged for predictors."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.functions import text as X
from pairgate.operators.relational import absent_from


def extras_json(extras: Column, notes: Column) -> Column:
    """One JSON object with sorted keys from the numeric extras and the text notes."""

    def quoted(text: Column) -> Column:
        """``text`` as a JSON string: Spark's writer does the escaping, its braces are cut off."""
        field = F.to_json(F.struct(text.alias("t")))
        return F.when(text.isNotNull(), F.substring(field, 6, F.length(field) - 6))

    entries = F.array_sort(
        F.concat(
            F.transform(
                F.map_entries(extras),
                lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"].cast("string"), F.lit("null")).alias("v")),
            ),
            F.transform(
                F.map_entries(notes),
                lambda e: F.struct(e["key"].alias("k"), F.coalesce(quoted(e["value"]), F.lit("null")).alias("v")),
            ),
        )
    )
    fields = F.transform(entries, lambda e: F.concat(quoted(e["k"]), F.lit(": "), e["v"]))
    return F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}"))


def score_table(scores: DataFrame, examples: DataFrame) -> DataFrame:
    """The canonical nine-column score table."""
    info = examples.select(
        F.col("id").alias("example_id"), "label", "target_name", "source", "binder_format", F.coalesce("split", F.lit("")).alias("split")
    )
    joined = scores.join(info, "example_id").withColumn("extras_json", extras_json(F.col("extras"), F.col("notes")))
    return joined.select(*C.SCORE_COLUMNS)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Delimited output with a header and a fixed column order (a folder of part files)."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def strict_json(value):
    """Undefined numbers to null, recursively."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: strict_json(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [strict_json(v) for v in value]
    return value


def write_report(report: dict, path: str) -> None:
    with open(path, "w") as fh:
        json.dump(strict_json(report), fh, indent=2, allow_nan=False)


def sequence_manifest(pairs: DataFrame) -> DataFrame:
    """Sorted '<seq>\\t<hash>' lines of the distinct binder and antigen chain sequences."""
    return distinct_chain_sequences(pairs).select(F.concat("sequence", F.lit("\t"), X.hash16("sequence")).alias("value")).orderBy("value")


def distinct_chain_sequences(pairs: DataFrame) -> DataFrame:
    chains = F.concat(F.array("binder_seq"), F.split("antigen_seq", ":"))
    return pairs.select(F.explode(chains).alias("sequence")).distinct()


def _clean_chains() -> Column:
    return F.transform(F.concat("binder_chains", "target_chains"), X.clean_sequence)


def uncached(examples: DataFrame, done: DataFrame) -> DataFrame:
    """Examples without a finished result (id)."""
    return absent_from(examples, done, ["id"])


def multimer_inputs(examples: DataFrame, staged_root: str, output_root: str) -> DataFrame:
    """(example_id, path, out_dir, content): one FASTA record per complex, binder chains first.

    An example without chains, or with a chain that is empty after cleaning, raises.
    """
    chains = _clean_chains()
    bad = (F.size(chains) == 0) | F.exists(chains, lambda c: c == "")
    message = F.concat(F.lit("no usable chains in "), F.col("id"))
    content = F.when(bad, F.raise_error(message)).otherwise(
        F.concat(F.lit(">"), "id", F.lit("\n"), F.array_join(chains, ":"), F.lit("\n"))
    )
    return examples.select(
        F.col("id").alias("example_id"),
        F.concat(F.lit(f"{staged_root.rstrip('/')}/fasta/"), "id", F.lit(".fasta")).alias("path"),
        F.concat(F.lit(f"{output_root.rstrip('/')}/"), "id").alias("out_dir"),
        content.alias("content"),
    )


def protenix_inputs(examples: DataFrame, staged_root: str, output_root: str, msa_cache: str) -> DataFrame:
    """(example_id, path, out_dir, content): a JSON list holding one job per complex."""
    cache = F.lit(msa_cache.rstrip("/") + "/")
    chain = lambda c: F.struct(
        F.struct(
            c.alias("sequence"), F.lit(1).alias("count"), F.concat(cache, X.hash16(c), F.lit(".a3m")).alias("unpairedMsaPath")
        ).alias("proteinChain")
    )
    job = F.struct(F.col("id").alias("name"), F.transform(_clean_chains(), chain).alias("sequences"))
    return examples.select(
        F.col("id").alias("example_id"),
        F.concat(F.lit(f"{staged_root.rstrip('/')}/inputs/"), "id", F.lit(".json")).alias("path"),
        F.concat(F.lit(f"{output_root.rstrip('/')}/"), "id").alias("out_dir"),
        F.to_json(F.array(job)).alias("content"),
    )


def write_files(inputs: DataFrame) -> int:
    """Write (path, content) rows from the tasks to a folder every executor shares; returns the count."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w") as fh:
                    fh.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    written = inputs.select("path", "content").mapInPandas(save, "n long").agg(F.sum("n")).first()[0]
    return int(written or 0)


def manifest(inputs: DataFrame, path_column: str) -> DataFrame:
    """Manifest rows (example_id, <path_column>, out_dir)."""
    return inputs.select("example_id", F.col("path").alias(path_column), "out_dir")


def rank_summary(files: DataFrame) -> DataFrame:
    """(id, content): flat rank summary of each prediction folder, from its raw score files.

    ``files`` has (id, name, text) of every file of the folders.
    """
    pattern = r"_scores_rank_(\d+)_.*\.json$"
    payload = F.from_json("text", "iptm double, ptm double, plddt array<double>, max_pae double")
    mean = F.try_divide(F.aggregate("p.plddt", F.lit(0.0), lambda a, v: a + v), F.size("p.plddt").cast("double"))
    model = F.replace(F.replace("name", F.lit("_scores_"), F.lit("_unrelaxed_")), F.lit(".json"), F.lit(".pdb"))
    names = files.select("id", F.col("name").alias("pdb"), F.lit(True).alias("has_pdb"))
    ranked = (
        files.where(F.col("name").rlike(pattern))
        .withColumn("p", payload)
        .withColumn("pdb", model)
        .join(names, ["id", "pdb"], "left")
        .select(
            "id",
            F.struct(
                F.regexp_extract("name", pattern, 1).cast("int").alias("rank"),
                F.when(F.col("has_pdb"), F.col("pdb")).otherwise(F.col("name")).alias("pdb"),
                F.col("p.iptm").alias("iptm"),
                F.col("p.ptm").alias("ptm"),
                mean.alias("mean_plddt"),
                F.col("p.max_pae").alias("max_pae"),
            ).alias("r"),
        )
    )
    packed = ranked.groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("per_rank"))
    top = F.get("per_rank", F.lit(0))
    rank1 = F.struct(*[top[c].alias(c) for c in ("iptm", "ptm", "mean_plddt", "max_pae", "pdb")])
    return packed.select("id", F.to_json(F.struct(F.col("id").alias("example_id"), rank1.alias("rank1"), "per_rank")).alias("content"))
