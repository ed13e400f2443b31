"""Pair construction: positives, clusters, folds and negatives for each benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.functions import text as X
from pairgate.functions.numeric import below, nan_to_null
from pairgate.operators import relational as R
from pairgate.operators import sampling, similarity
from pairgate.operators.ordered import dense_index, lexical_index


def _clustered(raw: DataFrame, *, n_splits: int, seed: int, max_identity: float) -> DataFrame:
    """Add antigen_cluster and fold to (pair_id, binder_seq, antigen_seq) rows.

    Antigens are clustered in sorted order on their concatenated chains; whole clusters share a fold.
    """
    unique = lexical_index(raw.select("antigen_seq").distinct(), "antigen_seq", name="ordinal")
    numbered = unique.withColumn("flat", F.regexp_replace("antigen_seq", ":", ""))
    clusters = similarity.greedy_cluster(numbered, "flat", "ordinal", max_identity=max_identity)
    table = clusters.select("antigen_seq", F.col("cluster").cast("int").alias("antigen_cluster"))
    return sampling.assign_folds(raw.join(table, "antigen_seq"), "antigen_cluster", n_splits=n_splits, seed=seed)


def positives_from_examples(examples: DataFrame, *, n_splits: int = 5, seed: int, max_identity: float = 0.9) -> DataFrame:
    """Single-domain examples, normalised; rows with an empty side are dropped."""
    raw = (
        examples.where(F.col("binder_format") == "vhh")
        .select(
            F.col("id").alias("pair_id"),
            X.normalize_binder(F.get("binder_chains", F.lit(0))).alias("binder_seq"),
            X.normalize_chains("target_chains").alias("antigen_seq"),
        )
        .where((F.col("binder_seq") != "") & (F.regexp_replace("antigen_seq", ":", "") != ""))
    )
    return _clustered(raw, n_splits=n_splits, seed=seed, max_identity=max_identity)


def positives_from_table(table: DataFrame, *, n_splits: int = 5, seed: int, max_identity: float = 0.9) -> DataFrame:
    """Metadata table (pdb_id, is_excluded, sequences, ordinal): not excluded, first row per pdb."""
    first = R.first_wins(table.where(R.keep_not_excluded()), ["pdb_id"], "ordinal")
    raw = first.select(
        F.concat("pdb_id", F.lit("__"), "pdb_id").alias("pair_id"),
        X.normalize_binder("vhh_sequence").alias("binder_seq"),
        X.normalize_antigen("antigen_sequence").alias("antigen_seq"),
    ).where((F.col("binder_seq") != "") & (F.col("antigen_seq") != ""))
    return _clustered(raw, n_splits=n_splits, seed=seed, max_identity=max_identity)


def build_pairs(positives: DataFrame, *, k: int, seed: int) -> DataFrame:
    """Positives and their k shuffled negatives in the pair schema; broken invariants raise."""
    negatives = sampling.shuffled_negatives(positives, k=k, seed=seed)
    broken = sampling.pair_violations(negatives, positives).limit(1).count()
    if broken:
        raise AssertionError("a negative shares its positive's cluster or leaves its fold")
    binders = positives.select("pair_id", "binder_seq")
    rows = negatives.join(binders, "pair_id").select(
        F.concat("pair_id", F.lit("__neg"), F.col("j").cast("string")).alias("pair_id"),
        "binder_seq",
        "antigen_seq",
        F.lit("0").alias("label"),
        F.col("antigen_cluster").cast("string").alias("antigen_cluster"),
        F.col("fold").cast("string").alias("fold"),
    )
    own = positives.select(
        "pair_id", "binder_seq", "antigen_seq", F.lit("1").alias("label"),
        F.col("antigen_cluster").cast("string").alias("antigen_cluster"), F.col("fold").cast("string").alias("fold"),
    )
    return own.unionByName(rows)


def epcam_pairs(examples: DataFrame, training_pairs: DataFrame, *, k: int, seed: int, max_identity: float = 0.9) -> DataFrame:
    """Test pairs of one antigen against its binders, negatives from unrelated training antigens.

    ``training_pairs`` has an ordinal.  A test binder present in training raises.
    """
    positives = examples.select(
        F.try_element_at("metadata", F.lit("vhh_id")).alias("vhh_id"),
        X.normalize_binder(F.get("binder_chains", F.lit(0))).alias("binder_seq"),
        X.normalize_antigen(F.get("target_chains", F.lit(0))).alias("antigen_seq"),
    )
    R.leakage_guard(positives, training_pairs, ["binder_seq"])
    reference = positives.agg(F.min("antigen_seq")).first()[0]  # one antigen; the first by text if not
    pool = R.first_seen(training_pairs.where(F.col("label") == "1"), "antigen_seq", "ordinal")
    numbered = dense_index(pool, [], "ordinal", name="n").select("antigen_seq", F.col("n").alias("ordinal"))
    allowed = similarity.outside_cluster_of(numbered, reference, "antigen_seq", "ordinal", max_identity=max_identity)
    drawn = sampling.pool_negatives(positives, allowed, k=k, seed=seed, row="vhh_id", item="antigen_seq")
    own = positives.withColumn("suffix", F.lit("epcam")).withColumn("label", F.lit("1"))
    negatives = drawn.join(positives.select("vhh_id", "binder_seq"), "vhh_id").select(
        "vhh_id", "binder_seq", "antigen_seq", F.concat(F.lit("neg"), F.col("j").cast("string")).alias("suffix"), F.lit("0").alias("label")
    )
    return own.unionByName(negatives).select(
        F.concat(F.lit("epcam-"), "vhh_id", F.lit("__"), "suffix").alias("pair_id"),
        "binder_seq", "antigen_seq", "label", F.lit("0").alias("antigen_cluster"), F.lit("0").alias("fold"),
    )


def staged_parents(ids: DataFrame, rmsd: DataFrame, chains: DataFrame) -> DataFrame:
    """Manifest ids with an RMSD row (last wins) and a FASTA; others are dropped."""
    latest = R.last_wins(rmsd.select("example_id", "value", "binder_format", "target_name", "ordinal"), ["example_id"], "ordinal")
    joined = ids.join(latest, "example_id").join(chains.withColumnRenamed("id", "example_id"), "example_id")
    roles = X.split_roles("chains", "binder_format", "example_id")
    return joined.select(
        "example_id", "binder_format", "target_name", nan_to_null("value").alias("rmsd"),
        roles["binder"].alias("binder_chains"), roles["target"].alias("target_chains"),
    )


def wrong_target_examples(parents: DataFrame, *, n_binders: int, targets_per_binder: int, seed: int) -> DataFrame:
    """Near-native binders first, each re-paired with donors of another target."""
    keyed = parents.withColumn(
        "target_key", F.concat_ws("|", F.lower("target_name"), F.array_join("target_chains", ":"))
    )
    binders = R.near_then_far(keyed, n_binders)
    picks = sampling.wrong_targets(binders, keyed, m=targets_per_binder, seed=seed)
    donor = keyed.select(F.col("example_id").alias("donor_id"), "target_chains", F.col("target_name").alias("donor_name"))
    return (
        picks.join(binders.select("example_id", "binder_chains", "binder_format", "rmsd"), "example_id")
        .join(donor, "donor_id")
        .select(
            F.concat("example_id", F.lit("-wrongtarget"), F.lpad(F.col("pick").cast("string"), 2, "0")).alias("id"),
            F.lit("WRONG_TARGET").alias("label"),
            "binder_chains",
            "binder_format",
            "target_chains",
            F.col("donor_name").alias("target_name"),
            F.col("example_id").alias("binder_parent_id"),
            F.col("donor_id").alias("target_donor_id"),
            F.col("rmsd").alias("binder_parent_rmsd_to_crystal"),
        )
    )


def scramble_parents(parents: DataFrame, n: int) -> DataFrame:
    """Near-native parents by id, the rest filled in proportion to the formats of the others."""
    near = parents.where(below("rmsd", C.NEAR_NATIVE_RMSD)).orderBy("example_id").limit(n)
    left = n - near.count()
    if left <= 0:
        return near
    far = parents.where(~below("rmsd", C.NEAR_NATIVE_RMSD))
    far = lexical_index(far, "example_id", name="__o")
    return near.unionByName(R.quota_head(far, "binder_format", "__o", left).drop("__o")).limit(n)


def scrambles(parents: DataFrame, loops: DataFrame, *, n_scrambles: int, seed: int) -> DataFrame:
    """Loop-scrambled copies of parents whose every binder chain has loops.

    ``loops`` has (example_id, chain_no, loops) from an external numbering.
    """
    chains = parents.select("example_id", F.posexplode("binder_chains").alias("chain_no", "sequence"))
    variants = chains.join(loops, ["example_id", "chain_no"]).withColumn(
        "variant", F.explode(F.sequence(F.lit(1), F.lit(n_scrambles)))
    )
    row = F.concat_ws("/", "example_id", F.col("chain_no").cast("string"))
    moved = variants.withColumn("scrambled", sampling.scramble_loops("sequence", "loops", row, seed, F.col("variant")))
    packed = moved.groupBy("example_id", "variant").agg(
        F.array_sort(F.collect_list(F.struct("chain_no", "scrambled"))).alias("c")
    )
    whole = packed.join(parents, "example_id").where(F.size("c") == F.size("binder_chains"))
    return whole.select(
        F.concat("example_id", F.lit("-scramble"), F.lpad(F.col("variant").cast("string"), 2, "0")).alias("id"),
        F.lit("SCRAMBLE").alias("label"),
        F.col("c.scrambled").alias("binder_chains"),
        "binder_format",
        "target_chains",
        "target_name",
        F.col("example_id").alias("scramble_parent_id"),
    )


def champloo_pair_table(metadata: DataFrame, cells: DataFrame, predictor: str) -> DataFrame:
    """Score-matrix pairs of the included systems; positives on the diagonal."""
    included = R.first_wins(metadata.where(R.keep_included()), ["pdb_id"], "ordinal", count="n_systems")
    vhh = {c: c if c.startswith("vhh_") else f"vhh_{c}" for c in C.CHAMPLOO_VHH_META}
    antigen = {c: c for c in C.CHAMPLOO_ANTIGEN_META}
    pairs = R.matrix_pairs(cells, included, "pdb_id", vhh, antigen)
    return pairs.withColumnRenamed("value", "iptm").withColumn("predictor", F.lit(predictor))


def champloo_features(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sequence features of each pair, both sides looked up in the same table (first row wins)."""
    from pairgate.functions.sequence import pair_features

    first = R.first_wins(sequences.select("pdb_id", "vhh_sequence", "antigen_sequence", "ordinal"), ["pdb_id"], "ordinal")
    known = first.select("pdb_id", X.normalize_binder("vhh_sequence").alias("b"), X.normalize_antigen("antigen_sequence").alias("t"))
    both = R.two_sided_lookup(pairs, known, "pdb_id", {"vhh_pdb": {"b": "b"}, "antigen_pdb": {"t": "t"}})
    joined = both.where((F.col("b") != "") & (F.col("t") != ""))
    return joined.select("pair_id", "vhh_pdb", "antigen_pdb", "label", "iptm", *pair_features("b", "t"))
