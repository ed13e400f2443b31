"""Confidence aggregates of predicted complexes: pLDDT and PAE over binder, target and interface.

The matrices travel as one array per token row.  Row-wise reductions are array expressions; only
the outer dimension is exploded, so a matrix of N x N costs N rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.functions.numeric import as_column, nan_to_null, ratio
from pairgate.functions.vectors import total


def mean_of(v: Column) -> Column:
    """Mean of an array; NULL when it is empty."""
    return ratio(total(v), F.size(v))


def rank1_score_file(pdb_name: Column | str) -> Column:
    """Name of the raw score file that belongs to a rank-1 model file."""
    return F.replace(
        F.replace(as_column(pdb_name), F.lit("_unrelaxed_"), F.lit("_scores_")), F.lit(".pdb"), F.lit(".json")
    )


def multimer_confidence(scores: DataFrame) -> DataFrame:
    """Confidence features of one raw score record per example.

    Input: id, iptm, ptm, plddt array, pae array of rows, max_pae, n_binder, n_target (residue
    counts of the structure) and ``interface`` (0-based binder residues, NULL for none).  A record
    whose array lengths disagree with the structure has ``error`` set and no features.
    """
    n = F.size("plddt")
    n_b, n_t = F.col("n_binder"), F.col("n_target")
    square = F.forall("pae", lambda r: F.size(r) == n) & (F.size("pae") == n)
    error = F.when(
        n != n_b + n_t,
        F.concat(F.lit("plddt_length_mismatch:plddt="), n, F.lit(",pdb="), n_b + n_t),
    ).when(~square, F.concat(F.lit("pae_shape_mismatch:pae="), F.size("pae"), F.lit(",expected="), n))
    checked = scores.withColumn("error", error).withColumn(
        "interface", F.coalesce("interface", F.array().cast("array<int>"))
    )
    fine = F.col("error").isNull()
    # One row per token of the matrix: reduce its binder and target columns at once.
    rows = (
        checked.where(fine)
        .select("id", n_b.alias("nb"), "interface", F.posexplode("pae").alias("i", "row"))
        .select(
            "id",
            (F.col("i") < F.col("nb")).alias("binder_row"),
            F.array_contains("interface", F.col("i")).alias("interface_row"),
            F.slice("row", F.lit(1), F.col("nb")).alias("to_binder"),
            F.slice("row", F.col("nb") + 1, F.size("row")).alias("to_target"),
        )
    )
    cross = F.when(F.col("binder_row"), F.col("to_target")).otherwise(F.col("to_binder"))
    reduced = rows.select(
        "id",
        "binder_row",
        "interface_row",
        total(cross).alias("s"),
        F.array_max(cross).alias("m"),
        F.size(cross).alias("c"),
    )
    side = lambda is_b, v: F.sum(F.when(F.col("binder_row") == is_b, F.col(v)))
    pae = reduced.groupBy("id").agg(
        ((ratio(side(True, "s"), side(True, "c")) + ratio(side(False, "s"), side(False, "c"))) / F.lit(2.0)).alias("pae_interchain_mean"),
        F.max("m").alias("pae_interchain_max"),
        ratio(F.sum(F.when(F.col("interface_row"), F.col("s"))), F.sum(F.when(F.col("interface_row"), F.col("c")))).alias("pae_interface_mean"),
    )
    at_interface = F.transform("interface", lambda i: F.get("plddt", i))
    counts = [n.alias("n_residues_total"), n_b.alias("n_residues_binder"), n_t.alias("n_residues_target")]
    per_record = checked.select(
        "id",
        "error",
        "iptm",
        "ptm",
        (F.lit(0.8) * F.col("iptm") + F.lit(0.2) * F.col("ptm")).alias("ranking_confidence"),
        F.when(F.col("ptm") > 0, F.col("iptm") / F.col("ptm")).alias("iptm_over_ptm"),
        mean_of(F.col("plddt")).alias("plddt_full_mean"),
        mean_of(F.slice("plddt", F.lit(1), n_b)).alias("plddt_binder_mean"),
        mean_of(F.slice("plddt", n_b + 1, n)).alias("plddt_target_mean"),
        mean_of(at_interface).alias("plddt_interface_mean"),
        "max_pae",
        *counts,
        F.size("interface").alias("n_interface_residues_predicted"),
    )
    joined = per_record.join(pae, "id", "left")
    names = [c for c in joined.columns if c not in ("id", "error")]
    return joined.select("id", "error", *[F.when(fine, nan_to_null(c)).alias(c) for c in names])


def binder_token_mask(tokens: DataFrame) -> DataFrame:
    """(id, mask): per token, whether any of its atoms belongs to a binder chain.

    Input: id, n_tokens, atom_to_token_idx, atom_is_binder (atoms in file order).  ``mask`` is NULL
    when the atom counts differ or a token index is out of range.
    """
    pairs = F.arrays_zip(F.col("atom_to_token_idx").alias("t"), F.col("atom_is_binder").alias("b"))
    binder_tokens = F.array_distinct(
        F.transform(F.filter(pairs, lambda p: F.coalesce(p["b"], F.lit(False))), lambda p: p["t"])
    )
    consistent = (F.size("atom_to_token_idx") == F.size("atom_is_binder")) & (
        F.coalesce(F.array_max("atom_to_token_idx"), F.lit(-1)) < F.col("n_tokens")
    )
    mask = F.when(
        F.col("n_tokens") > 0,
        F.transform(F.sequence(F.lit(0), F.col("n_tokens") - 1), lambda t: F.array_contains(binder_tokens, t)),
    ).otherwise(F.array().cast("array<boolean>"))
    return tokens.select("id", F.when(F.coalesce(consistent, F.lit(False)), mask).alias("mask"))


def _cross_row(row: Column, own: Column) -> Column:
    """Entries of a token's row that point at tokens of the other role."""
    paired = F.filter(F.arrays_zip(row.alias("v"), F.col("mask").alias("m")), lambda p: p["m"] != own)
    return F.transform(paired, lambda p: p["v"])


def interface_pae(matrices: DataFrame) -> DataFrame:
    """(id, interface_pae, min_interface_pae) over token pairs with exactly one binder token.

    Input: id, token_pair_pae, mask.
    """
    rows = matrices.select("id", "mask", F.posexplode("token_pair_pae").alias("i", "row"))
    cross = rows.select("id", _cross_row(F.col("row"), F.get("mask", F.col("i"))).alias("v"))
    return cross.groupBy("id").agg(
        ratio(F.sum(total(F.col("v"))), F.sum(F.size("v"))).alias("interface_pae"),
        F.min(F.array_min("v")).alias("min_interface_pae"),
    )


def interface_plddt(matrices: DataFrame) -> DataFrame:
    """(id, interface_plddt): mean token pLDDT (0-100) over tokens likely in contact across roles.

    Input: id, contact_probs, atom_plddt (0-1), atom_to_token_idx, mask.  A token without atoms
    makes the value undefined.
    """
    rows = matrices.select("id", "mask", F.posexplode("contact_probs").alias("token", "row"))
    likely = rows.select(
        "id", "token", F.array_max(_cross_row(F.col("row"), F.get("mask", F.col("token")))).alias("p")
    ).where(F.col("p") >= C.INTERFACE_CONTACT_PROBABILITY)
    atoms = matrices.select(
        "id",
        F.explode(F.arrays_zip(F.col("atom_to_token_idx").alias("t"), F.col("atom_plddt").alias("q"))).alias("a"),
    ).select("id", F.col("a.t").alias("token"), F.col("a.q").alias("q"))
    per_token = atoms.groupBy("id", "token").agg(F.avg("q").alias("q"))
    joined = likely.join(per_token, ["id", "token"], "left")
    return joined.groupBy("id").agg(
        F.when(F.count("q") == F.count(F.lit(1)), F.avg("q") * F.lit(100.0)).alias("interface_plddt")
    )


def loop_engagement(interface: DataFrame, numbering: DataFrame) -> DataFrame:
    """Share of binder interface residues in each CDR, by a table of IMGT positions.

    ``interface`` has (id, residue_idx), ``numbering`` (id, residue_idx, imgt_pos).  An example
    with a numbering and an interface gets ``cdr_mapping_ok`` 1; the caller fills zeros for others.
    """
    mapped = interface.join(numbering.select("id").distinct(), "id", "left_semi")
    placed = mapped.join(numbering, ["id", "residue_idx"], "left")
    inside = {
        name: F.coalesce(F.col("imgt_pos").between(lo, hi), F.lit(False))
        for name, (lo, hi) in C.IMGT_CDR_RANGES.items()
    }
    any_loop = F.lit(False)
    for flag in inside.values():
        any_loop = any_loop | flag
    return placed.groupBy("id").agg(
        F.avg(any_loop.cast("double")).alias("cdr_contact_fraction"),
        *[F.avg(flag.cast("double")).alias(f"{name}_contact_fraction") for name, flag in inside.items()],
        F.lit(1.0).alias("cdr_mapping_ok"),
    )


def loop_positions(numbering: DataFrame) -> DataFrame:
    """(id, loops): 0-based residue positions of each Chothia loop, per chain type.

    ``numbering`` has (id, residue_idx, position, chain_type) with chain type H, K or L.
    """
    heavy = F.lit(None).cast("string")
    for name, (lo, hi) in C.CHOTHIA_HEAVY_CDR_RANGES.items():
        heavy = F.when(F.col("position").between(lo, hi), F.lit(name)).otherwise(heavy)
    light = F.lit(None).cast("string")
    for name, (lo, hi) in C.CHOTHIA_LIGHT_CDR_RANGES.items():
        light = F.when(F.col("position").between(lo, hi), F.lit(name)).otherwise(light)
    loop = F.when(F.col("chain_type") == "H", heavy).when(F.col("chain_type").isin("K", "L"), light)
    return (
        numbering.withColumn("loop", loop)
        .where(F.col("loop").isNotNull())
        .groupBy("id", "chain_type", "loop")
        .agg(F.array_sort(F.collect_list("residue_idx")).alias("positions"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("positions")).alias("loops"))
    )
