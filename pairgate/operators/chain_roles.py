"""Which chains of a structure are the binder and which the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate.functions.text import chain_letters, chain_list, sequence_identity


def positional_roles(examples: DataFrame) -> DataFrame:
    """(id, binder_ids, target_ids): letters A, B, ... in the order chains were submitted."""
    n_b, n_t = F.size("binder_chains"), F.size("target_chains")
    return examples.select(
        "id",
        chain_letters(0, n_b).alias("binder_ids"),
        chain_letters(n_b, n_t).alias("target_ids"),
    )


def crystal_roles(examples: DataFrame) -> DataFrame:
    """Chain ids of the experimental structure: heavy (and for a Fab light) against antigen."""
    meta = F.col("metadata")
    get = lambda k: F.trim(F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")))
    is_fab = F.col("binder_format") == "fab"
    candidates = F.array(get("Hchain"), F.when(is_fab, get("Lchain")).otherwise(F.lit("")))
    typed = F.try_element_at(meta, F.lit("target_chain_ids"))
    return examples.select(
        "id",
        F.filter(candidates, lambda c: ~c.isin("", "NA")).alias("binder_ids"),
        F.when(typed.isNotNull(), F.from_json(typed, "array<string>"))
        .otherwise(chain_list(get("antigen_chain")))
        .alias("target_ids"),
    )


def _claim(queries: Column, chains: Column, used: Column) -> Column:
    """Fold over the queries; each takes the unused chain most like it, the earlier on a tie."""

    def step(taken: Column, query: Column) -> Column:
        free = F.filter(chains, lambda c: ~F.array_contains(taken, c["chain_id"]))
        rated = F.transform(
            free,
            lambda c: F.struct(
                sequence_identity(query, c["sequence"]).alias("likeness"),
                (-c["chain_ord"]).alias("rank"),
                c["chain_id"].alias("chain_id"),
            ),
        )
        best = F.array_max(rated)
        return F.when(F.size(free) > 0, F.concat(taken, F.array(best["chain_id"]))).otherwise(taken)

    return F.aggregate(queries, used, step)


def roles_by_sequence(examples: DataFrame, sequences: DataFrame) -> DataFrame:
    """Roles found by sequence: binder chains claim first, then target chains.

    ``sequences`` has (structure_id, chain_id, chain_ord, sequence) with structure_id = example id.
    """
    packed = sequences.groupBy(F.col("structure_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("chain_ord", "chain_id", "sequence"))).alias("chains")
    )
    none = F.array().cast("array<string>")
    claimed = (
        examples.join(packed, "id")
        .withColumn("binder_ids", _claim(F.col("binder_chains"), F.col("chains"), none))
        .withColumn("all_ids", _claim(F.col("target_chains"), F.col("chains"), F.col("binder_ids")))
    )
    n_b = F.size("binder_ids")
    return claimed.select(
        "id", "binder_ids", F.slice("all_ids", n_b + 1, F.size("all_ids")).alias("target_ids")
    )


def with_sidecar(roles: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Prefer a recorded assignment (id, binder, target) over a computed one."""
    return roles.join(sidecar, "id", "left").select(
        "id",
        F.coalesce("binder", "binder_ids").alias("binder_ids"),
        F.coalesce("target", "target_ids").alias("target_ids"),
    )


def assign(atoms: DataFrame, roles: DataFrame) -> DataFrame:
    """Atoms of the role chains with (role, chain_pos, role_res): residues numbered across chains.

    ``role_res`` counts the residues of the role's chains in order, so it indexes a prediction's
    per-residue arrays.
    """
    listed = roles.select(
        F.col("id").alias("structure_id"),
        F.explode(
            F.concat(
                F.transform("binder_ids", lambda c, i: F.struct(F.lit("binder").alias("role"), i.alias("chain_pos"), c.alias("chain_id"))),
                F.transform("target_ids", lambda c, i: F.struct(F.lit("target").alias("role"), i.alias("chain_pos"), c.alias("chain_id"))),
            )
        ).alias("r"),
    ).select("structure_id", "r.*")
    placed = atoms.join(listed, ["structure_id", "chain_id"])
    # Chains are few per structure: their residue offsets come from one small window.
    sizes = placed.groupBy("structure_id", "role", "chain_pos").agg((F.max("res_ord") + 1).alias("n_res"))
    packed = sizes.groupBy("structure_id", "role").agg(
        F.array_sort(F.collect_list(F.struct("chain_pos", "n_res"))).alias("chain_sizes")
    )
    before = F.aggregate(
        F.filter("chain_sizes", lambda c: c["chain_pos"] < F.col("chain_pos")),
        F.lit(0),
        lambda acc, c: acc + c["n_res"],
    )
    return (
        placed.join(packed, ["structure_id", "role"])
        .withColumn("role_res", F.col("res_ord") + before)
        .drop("chain_sizes")
    )


def missing_chains(roles: DataFrame, atoms: DataFrame) -> DataFrame:
    """(id, chain_id) of role chains a structure does not have."""
    wanted = roles.select("id", F.explode(F.concat("binder_ids", "target_ids")).alias("chain_id"))
    have = atoms.select(F.col("structure_id").alias("id"), "chain_id").distinct()
    return wanted.join(have, ["id", "chain_id"], "left_anti")
