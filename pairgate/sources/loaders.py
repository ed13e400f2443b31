"""Loaders: public benchmark files to the example table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.functions import text as X
from pairgate.functions.numeric import is_finite, to_double
from pairgate.operators.relational import first_wins, strict_lookup
from pairgate.operators.similarity import greedy_dedup
from pairgate.schemas import EXAMPLE
from pairgate.sources.registry import LOADERS
from pairgate.sources.structure_files import ca_sequences
from pairgate.sources.tables import read_delimited, read_texts


def _data_dir(given: str | None, variable: str) -> str:
    found = given or os.environ.get(variable)
    if found is None:
        raise ValueError(f"pass data_dir or set {variable}")
    return found.rstrip("/")


def _metadata(**values: Column) -> Column:
    pairs = [F.create_map(F.lit(k), F.coalesce(v.cast("string"), F.lit(""))) for k, v in values.items()]
    return F.map_concat(*pairs)


def _examples(df: DataFrame, **columns: Column) -> DataFrame:
    """Project onto the example schema; unlisted columns are NULL."""
    out = []
    for field in EXAMPLE.fields:
        value = columns.get(field.name, F.lit(None))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


@LOADERS.register("epcam")
def epcam(spark: SparkSession, data_dir: str | None = None) -> DataFrame:
    """Positives, scrambled and off-target binders against one antigen."""
    root = _data_dir(data_dir, "PAIRGATE_EPCAM_DATA")
    fixed = {
        "binder_format": F.lit("vhh"),
        "target_chains": F.array(F.lit(C.EPCAM_ECD)),
        "target_name": F.lit("EpCAM"),
        "source": F.lit("epcam-snap"),
        "target_pdb_id": F.lit("4MZV"),
    }
    pos = read_delimited(spark, f"{root}/epcam_positives_filtered.csv", ("cdr3_sequence", "cluster_id"), ordinal=False)
    scr = read_delimited(
        spark,
        f"{root}/epcam_scrambled_negatives.csv",
        ("source_vhh_no", "scramble_variant_idx", "negative_type"),
        ordinal=False,
    )
    off = read_delimited(spark, f"{root}/epcam_literature_negatives.csv", ("target", "source"), ordinal=False)
    positives = _examples(
        pos,
        id=F.concat(F.lit("epcam-pos-"), "vhh_no"),
        label=F.lit("POS"),
        binder_chains=F.array("vhh_sequence"),
        metadata=_metadata(**{c: F.col(c) for c in ("vhh_no", "cdr3_sequence", "cluster_id")}),
        **fixed,
    )
    scrambled = _examples(
        scr,
        id=F.col("vhh_id"),
        label=F.lit("SCR"),
        binder_chains=F.array("vhh_sequence"),
        metadata=_metadata(**{c: F.col(c) for c in ("source_vhh_no", "scramble_variant_idx", "negative_type")}),
        **fixed,
    )
    off_target = _examples(
        off,
        id=F.concat(F.lit("epcam-off-"), "vhh_id"),
        label=F.lit("OFF"),
        binder_chains=F.array("sequence"),
        metadata=_metadata(real_target=F.col("target"), literature_source=F.col("source")),
        **fixed,
    )
    return positives.unionByName(scrambled).unionByName(off_target)


@LOADERS.register("epcam_killing")
def epcam_killing(spark: SparkSession, labels_csv: str) -> DataFrame:
    """Killing assay labels: Good binds, Bad does not, anything else raises."""
    rows = read_delimited(spark, labels_csv, ordinal=False)
    raw = F.trim("label")
    label = (
        F.when(raw == "Good", "BIND")
        .when(raw == "Bad", "NONBIND")
        .otherwise(F.raise_error(F.concat(F.lit("unexpected killing label "), F.coalesce(raw, F.lit("NULL")))))
    )
    return _examples(
        rows,
        id=F.concat(F.lit("epcam-kill-"), "vhh_id"),
        label=label,
        binder_chains=F.array("vhh_sequence"),
        binder_format=F.lit("vhh"),
        target_chains=F.array(F.lit(C.EPCAM_ECD)),
        target_name=F.lit("EpCAM"),
        source=F.lit("epcam-killing"),
        target_pdb_id=F.lit("4MZV"),
        metadata=_metadata(assay=F.lit("cart_killing_aspc1"), vhh_id=F.col("vhh_id")),
    )


@LOADERS.register("avida")
def avida(spark: SparkSession, staged_csv: str) -> DataFrame:
    rows = read_delimited(spark, staged_csv, ("antigen_label",), ordinal=False)
    return _examples(
        rows,
        id=F.col("vhh_id"),
        label=F.when(F.col("label") == "1", "BIND").otherwise("NONBIND"),
        binder_chains=F.array("vhh_sequence"),
        binder_format=F.lit("vhh"),
        target_chains=F.array("antigen_sequence"),
        target_name=F.coalesce("antigen_label", F.lit("IL6-family")),
        source=F.lit("avida-hil6"),
        metadata=_metadata(raw_label=F.col("label")),
    )


def structure_candidates(
    summary: DataFrame, sequences: DataFrame, *, max_resolution: float, min_antigen_length: int
) -> DataFrame:
    """Summary rows that pass the structural filters, with their chain sequences.

    ``sequences`` has (pdb, chain_id, sequence, path) with non-empty sequences.
    """
    resolution = to_double("resolution")
    rows = summary.select(
        "*", resolution.alias("res"), F.lower("pdb").alias("code"), X.chain_list("antigen_chain").alias("ag_chains")
    ).where(
        is_finite("res") & (F.col("res") > 0) & (F.col("res") <= max_resolution)
        & F.coalesce(F.contains("antigen_type", F.lit("protein")), F.lit(False))
        & (F.size("ag_chains") > 0)
        & ~F.coalesce(F.trim("Hchain"), F.lit("")).isin("", "NA")
    )
    chain = lambda key, out: sequences.select(F.col("pdb").alias("code"), F.col("chain_id").alias(key), F.col("sequence").alias(out))
    paths = sequences.groupBy(F.col("pdb").alias("code")).agg(F.min("path").alias("path"))
    with_chains = (
        rows.withColumn("hc", F.trim("Hchain"))
        .withColumn("lc", F.nullif(F.trim("Lchain"), F.lit("NA")))
        .join(chain("hc", "h_seq"), ["code", "hc"])
        .join(chain("lc", "l_seq"), ["code", "lc"], "left")
        .join(paths, "code")
    )
    antigens = (
        rows.select("ordinal", "code", F.posexplode("ag_chains").alias("k", "ac"))
        .join(chain("ac", "a_seq"), ["code", "ac"])
        .groupBy("ordinal")
        .agg(
            F.array_sort(F.collect_list(F.struct("k", "ac", "a_seq"))).alias("ag"),
            F.sum(F.length("a_seq")).alias("ag_length"),
        )
        .where(F.col("ag_length") >= min_antigen_length)
    )
    return with_chains.join(antigens, "ordinal").select(
        "*", F.col("ag.a_seq").alias("target_seqs"), F.col("ag.ac").alias("target_ids")
    )


def binder_format() -> Column:
    light = F.trim(F.coalesce("Lchain", F.lit("NA")))
    single = F.lower(F.trim(F.coalesce("scfv", F.lit("False")))) == "true"
    return F.when(light == "NA", "vhh").when(single, "scfv").otherwise("fab")


def assemble_examples(candidates: DataFrame) -> DataFrame:
    """Examples of accepted candidates; a light chain joins the binder only in a Fab."""
    fmt = binder_format()
    is_fab = fmt == "fab"
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = _metadata(
        crystal_pdb_path=F.col("path"),
        Hchain=F.col("Hchain"),
        Lchain=F.coalesce("Lchain", F.lit("NA")),
        antigen_chain=F.array_join("target_ids", "|"),
        antigen_chain_raw=F.col("antigen_chain"),
        target_chain_ids=F.to_json("target_ids"),
        resolution=F.col("res"),
        **{c: F.col(c) for c in ("method", "antigen_species", "heavy_species", "scfv", "date")},
    )
    light = F.when(
        F.col("l_seq").isNotNull() & ~is_fab, F.create_map(F.lit("light_chain_sequence"), F.col("l_seq"))
    ).otherwise(F.create_map().cast("map<string,string>"))
    return _examples(
        candidates,
        id=F.concat_ws("-", F.lit("sabdab"), "code", "Hchain", F.get("target_ids", F.lit(0))),
        label=F.lit("POS"),
        binder_chains=F.when(is_fab & F.col("l_seq").isNotNull(), F.array("h_seq", "l_seq")).otherwise(F.array("h_seq")),
        binder_format=fmt,
        target_chains=F.col("target_seqs"),
        target_name=F.coalesce(F.nullif(blank("antigen_name"), F.lit("")), blank("compound")),
        source=F.lit("sabdab"),
        target_pdb_id=F.upper("code"),
        complex_pdb_path=F.col("path"),
        metadata=F.map_concat(base, light),
    )


_SUMMARY_OPTIONAL = (
    "Lchain", "antigen_chain", "antigen_type", "antigen_name", "resolution", "method", "scfv", "compound",
    "antigen_species", "heavy_species", "date",
)


@LOADERS.register("sabdab")
def sabdab(
    spark: SparkSession,
    data_dir: str | None = None,
    max_resolution: float = 3.0,
    min_antigen_length: int = 30,
    max_identity: float = 0.9,
    accept: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Crystal complexes: summary rows joined with chain sequences read from their structures.

    ``accept`` may filter the candidates by an external antibody numbering; without it all pass.
    Heavy chains similar to an earlier accepted one are dropped.
    """
    root = _data_dir(data_dir, "PAIRGATE_SABDAB_DATA")
    summary = read_delimited(spark, f"{root}/summary.tsv", _SUMMARY_OPTIONAL, sep="\t")
    files = read_texts(spark, f"{root}/sabdab_dataset", "*.pdb").where(F.contains("path", F.lit("/structure/chothia/")))
    named = files.withColumn("structure_id", F.regexp_replace("name", r"\.pdb$", ""))
    wanted = summary.select(F.lower("pdb").alias("structure_id")).distinct()
    named = named.join(wanted, "structure_id", "left_semi")
    sequences = ca_sequences(named).join(named.select("structure_id", "path"), "structure_id")
    candidates = structure_candidates(
        summary,
        sequences.withColumnRenamed("structure_id", "pdb"),
        max_resolution=max_resolution,
        min_antigen_length=min_antigen_length,
    )
    if accept is not None:
        candidates = accept(candidates)
    return assemble_examples(greedy_dedup(candidates, "h_seq", "ordinal", max_identity=max_identity))


def examples_from_pairs(pairs: DataFrame) -> DataFrame:
    """Pair table to examples; a multi-chain antigen is joined by colons."""
    return _examples(
        pairs,
        id=F.col("pair_id"),
        label=F.col("label"),
        binder_chains=F.array("binder_seq"),
        binder_format=F.lit("vhh"),
        target_chains=F.split("antigen_seq", ":"),
        target_name=F.lit(""),
        source=F.lit("pairs_csv"),
        metadata=_metadata(antigen_cluster=F.col("antigen_cluster"), fold=F.col("fold")),
    )


def examples_from_manifest(manifest: DataFrame, parents: DataFrame, chains: DataFrame) -> DataFrame:
    """Staged ids to examples through their parent row and FASTA chains; a missing parent raises.

    ``parents`` has example_id, binder_format, target_name, label, split; ``chains`` has id, chains.
    """
    rows = manifest.select("example_id", X.parent_id("example_id").alias("parent_id"))
    dim = parents.select(F.col("example_id").alias("parent_id"), "binder_format", "target_name", "label", "split")
    joined = strict_lookup(rows, dim, ["parent_id"], "parent row")
    joined = strict_lookup(joined, chains.withColumnRenamed("id", "example_id"), ["example_id"], "FASTA")
    label = (
        F.when(F.contains("example_id", F.lit("-scramble")), "SCRAMBLE")
        .when(F.contains("example_id", F.lit("-wrongtarget")), "WRONG_TARGET")
        .when(F.col("parent_id") != F.col("example_id"), "SYNTHETIC_NEGATIVE")
        .otherwise(F.coalesce("label", F.lit("")))
    )
    roles = X.split_roles("chains", F.coalesce("binder_format", F.lit("")), "example_id")
    return _examples(
        joined,
        id=F.col("example_id"),
        label=label,
        binder_chains=roles["binder"],
        binder_format=F.coalesce("binder_format", F.lit("")),
        target_chains=roles["target"],
        target_name=F.coalesce("target_name", F.lit("")),
        source=F.lit("manifest"),
        split=F.nullif("split", F.lit("")),
        metadata=_metadata(manifest_parent_id=F.col("parent_id")),
    )


def examples_from_archive(manifest: DataFrame, source: str) -> DataFrame:
    """Archive manifest rows: label 1 is the cognate pair, anything else a shuffled one.

    The archive names the binder chain A and the target chain B in every structure.
    """
    return _examples(
        manifest,
        id=F.col("example_id"),
        label=F.when(F.trim(F.col("label").cast("string")) == "1", "COGNATE").otherwise("SHUFFLED"),
        binder_chains=F.array(F.lit("A")),
        binder_format=F.lit("vhh"),
        target_chains=F.array(F.lit("B")),
        target_name=F.col("antigen_pdb"),
        source=F.lit(source),
        target_pdb_id=F.col("antigen_pdb"),
        metadata=_metadata(**{c: F.col(c) for c in ("vhh_pdb", "antigen_pdb", "member_name")}),
    )


def examples_by_id(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """The examples of listed ids (id), each from the first summary row that passes the structural
    filters and makes that id, whether or not a similar chain came earlier; an id without one raises.

    ``candidates`` are those of ``structure_candidates``, before any are dropped as similar.
    """
    code = F.concat_ws("-", F.lit("sabdab"), "code", "Hchain", F.get("target_ids", F.lit(0)))
    wanted = ids.select(F.col("id").alias("__wanted")).distinct()
    listed = candidates.join(wanted, code == F.col("__wanted"), "left_semi")
    first = first_wins(listed.withColumn("__id", code), ["__id"], "ordinal").drop("__id")
    return select_by_id(assemble_examples(first), ids)


def select_by_id(examples: DataFrame, ids: DataFrame) -> DataFrame:
    """The examples of a list of ids; an id without an example raises."""
    return strict_lookup(ids.select("id").distinct(), examples, ["id"], "example")
