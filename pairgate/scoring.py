"""Scorers: examples (and a folder of predictions) to the score table.

An example that cannot be scored keeps its row, with NULL value and the reason in ``notes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate import schemas
from pairgate.operators import chain_roles, confidence, geometry, interface_quality, superpose
from pairgate.session import cut_lineage
from pairgate.sources.registry import SCORERS
from pairgate.sources.structure_files import atoms_from_files, chain_sequences
from pairgate.sources.tables import read_texts, relative_files

_NO_NOTES = "map<string,string>"
#: Characters of an error note that a score row keeps; the whole text would swell every score file.
NOTE_LENGTH = 200


def _note(key: str, value: Column) -> Column:
    return F.create_map(F.lit(key), F.substring(value, 1, NOTE_LENGTH))


def _score_rows(df: DataFrame, name: str, value: Column, extras: Sequence[str], notes: Column | None = None) -> DataFrame:
    """Score rows of (id, feature columns); ``notes`` rows carry no extras."""
    none = F.create_map().cast(_NO_NOTES)
    notes = none if notes is None else F.coalesce(notes, none)
    pairs = [v for e in extras for v in (F.lit(e), F.col(e).cast("double"))]
    filled = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    failed = F.map_contains_key(notes, "missing") | F.map_contains_key(notes, "error")
    return df.select(
        F.col("id").alias("example_id"),
        F.lit(name).alias("scorer_name"),
        F.when(~failed, value.cast("double")).alias("value"),
        F.when(failed, F.create_map().cast("map<string,double>")).otherwise(filled).alias("extras"),
        notes.alias("notes"),
    )


@SCORERS.register("length")
def length(examples: DataFrame) -> DataFrame:
    """Length of the first binder chain; an example without one raises."""
    none = F.raise_error(F.concat(F.lit("no binder chains in "), F.col("id")))
    value = F.when(F.size("binder_chains") > 0, F.length(F.get("binder_chains", F.lit(0)))).otherwise(none)
    count = F.create_map(F.lit("binder_chain_count"), F.size("binder_chains").cast("string"))
    return _score_rows(examples, "length", value, [], count)


def find_structures(spark: SparkSession, root: str) -> DataFrame:
    """(id, path, folder, text): the preferred structure file of every prediction folder.

    rank1.cif comes first, then rank1.pdb, then the first ``*sample_0*.cif`` by path.
    """
    files = relative_files(spark, root, "*.{cif,pdb}")
    order = (
        F.when(F.col("rel") == "rank1.cif", 0)
        .when(F.col("rel") == "rank1.pdb", 1)
        .when(F.col("name").contains("sample_0") & F.col("name").endswith(".cif"), 2)
    )
    ranked = files.withColumn("order", order).where(F.col("order").isNotNull())
    best = ranked.groupBy("id").agg(F.min(F.struct("order", "path")).alias("b")).select("id", "b.path")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return ranked.join(best, ["id", "path"]).select("id", "path", folder.alias("folder"), "text")


def _as_files(structures: DataFrame) -> DataFrame:
    return structures.select(F.col("id").alias("structure_id"), "path", "text")


def sidecar_roles(spark: SparkSession, root: str, structures: DataFrame) -> DataFrame:
    """(id, binder, target) recorded next to the chosen structure file."""
    found = read_texts(spark, root, "chain_roles.json").select(
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
        F.from_json("text", schemas.CHAIN_ROLES).alias("r"),
    )
    return structures.select("id", "folder").join(found, "folder").select("id", "r.binder", "r.target")


def sequence_roles(spark: SparkSession, root: str, examples: DataFrame, structures: DataFrame, atoms: DataFrame) -> DataFrame:
    computed = chain_roles.roles_by_sequence(examples, chain_sequences(atoms))
    return chain_roles.with_sidecar(computed, sidecar_roles(spark, root, structures))


def _roles_and_atoms(spark: SparkSession, examples: DataFrame, root: str, chain_resolution: str):
    """(found ids, atoms, roles, failures) of the predictions of the examples."""
    if chain_resolution == "sequence":
        structures = find_structures(spark, root)
    else:
        structures = relative_files(spark, root, "rank1.pdb").where(F.col("rel") == "rank1.pdb").select(
            "id", "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "text"
        )
    structures = structures.join(examples.select("id"), "id", "left_semi")
    # Parsed once, read by every branch that follows.
    atoms = cut_lineage(atoms_from_files(_as_files(structures)))
    found = structures.select("id")
    if chain_resolution == "sequence":
        roles = sequence_roles(spark, root, examples, structures, atoms)
    else:
        roles = chain_roles.positional_roles(examples.join(found, "id", "left_semi"))
    lost = chain_roles.missing_chains(roles, atoms).groupBy("id").agg(F.min("chain_id").alias("chain_id"))
    failures = lost.select("id", F.concat(F.lit("KeyError: '"), "chain_id", F.lit("'")).alias("error"))
    return found, atoms, roles.join(failures, "id", "left_anti"), failures


@SCORERS.register("structural_interface")
def structural_interface(examples: DataFrame, predictions_root: str, chain_resolution: str = "positional") -> DataFrame:
    """Interface geometry of the predicted complex; the value is contacts per binder residue at 6 A."""
    spark = examples.sparkSession
    found, atoms, roles, failures = _roles_and_atoms(spark, examples, predictions_root, chain_resolution)
    placed = cut_lineage(chain_roles.assign(atoms, roles))
    features = geometry.interface_features(placed).withColumnRenamed("structure_id", "id")
    joined = (
        examples.select("id")
        .join(found.withColumn("found", F.lit(True)), "id", "left")
        .join(failures, "id", "left")
        .join(features, "id", "left")
    )
    notes = F.when(F.col("found").isNull(), _note("missing", F.lit("prediction"))).when(
        F.col("error").isNotNull(), _note("error", F.col("error"))
    )
    names = [c for c in features.columns if c != "id"]
    return _score_rows(joined, "structural_interface", F.col("contacts_per_binder_residue_6a"), names, notes)


@SCORERS.register("af2m_confidence")
def af2m_confidence(examples: DataFrame, predictions_root: str) -> DataFrame:
    """The predictor's own confidence: interface score, pLDDT and inter-chain PAE aggregates."""
    spark = examples.sparkSession
    files = relative_files(spark, predictions_root, "*.json")
    summary = files.where(F.col("rel") == "scores.json").select(
        "id", F.from_json("text", "rank1 struct<pdb: string>")["rank1"]["pdb"].alias("pdb")
    )
    wanted = summary.withColumn("rel", confidence.rank1_score_file("pdb"))
    raw = wanted.join(files.select("id", "rel", "text"), ["id", "rel"], "left").select(
        "id", "pdb", "rel", F.from_json("text", schemas.AF2M_SCORES).alias("s"), F.col("text").isNotNull().alias("has_raw")
    )
    found, atoms, roles, failures = _roles_and_atoms(spark, examples, predictions_root, "positional")
    placed = cut_lineage(chain_roles.assign(atoms, roles))
    count = lambda r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("role_res"))) + 1, F.lit(0))
    sizes = placed.groupBy(F.col("structure_id").alias("id")).agg(count("binder").alias("n_binder"), count("target").alias("n_target"))
    near = geometry.interface_residues(placed).groupBy(F.col("structure_id").alias("id")).agg(
        F.array_sort(F.collect_list("binder_res")).alias("interface")
    )
    records = raw.where("has_raw").join(sizes, "id").join(near, "id", "left").select("id", "s.*", "n_binder", "n_target", "interface")
    features = confidence.multimer_confidence(records).withColumnRenamed("error", "shape_error")
    joined = (
        examples.select("id")
        .join(found.withColumn("found", F.lit(True)), "id", "left")
        .join(raw.select("id", "pdb", "rel", "has_raw", F.lit(True).alias("has_summary")), "id", "left")
        .join(failures, "id", "left")
        .join(features, "id", "left")
    )
    notes = (
        F.when(F.col("found").isNull(), _note("missing", F.lit("prediction")))
        .when(F.col("has_summary").isNull(), _note("missing", F.lit("scores_json")))
        .when(F.col("pdb").isNull(), _note("missing", F.lit("summary scores.json missing rank1.pdb name")))
        .when(~F.col("has_raw"), _note("missing", F.concat(F.lit("raw_scores:"), "rel")))
        .when(F.col("error").isNotNull(), _note("error", F.col("error")))
        .when(F.col("shape_error").isNotNull(), _note("error", F.col("shape_error")))
    )
    names = [c for c in features.columns if c not in ("id", "shape_error")]
    return _score_rows(joined, "af2m_confidence", F.col("iptm"), names, notes)


@SCORERS.register("protenix_confidence")
def protenix_confidence(examples: DataFrame, predictions_root: str) -> DataFrame:
    """Summary confidence plus interface PAE and pLDDT over binder-antigen token pairs."""
    spark = examples.sparkSession
    files = relative_files(spark, predictions_root, "*sample_0*.json")
    first = lambda part: files.where(F.contains("name", F.lit(part))).groupBy("id").agg(F.min_by("text", "path").alias("text"))
    summary = first("summary_confidence").select("id", F.from_json("text", schemas.PROTENIX_SUMMARY).alias("s"))
    full = first("full_data").select("id", F.from_json("text", schemas.PROTENIX_FULL).alias("f")).select("id", "f.*")
    found, atoms, roles, _ = _roles_and_atoms(spark, examples, predictions_root, "sequence")
    listed = roles.select(F.col("id").alias("structure_id"), F.explode("binder_ids").alias("chain_id"), F.lit(True).alias("is_binder"))
    flags = (
        atoms.join(listed, ["structure_id", "chain_id"], "left")
        .groupBy(F.col("structure_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("atom_ord", F.coalesce("is_binder", F.lit(False)).alias("b")))).alias("a"))
        .select("id", F.col("a.b").alias("atom_is_binder"))
    )
    tokens = full.withColumn("n_tokens", F.size("token_pair_pae")).join(flags, "id")
    masked = tokens.join(confidence.binder_token_mask(tokens), "id").where(F.col("mask").isNotNull())
    joined = (
        examples.select("id")
        .join(summary, "id", "left")
        .join(confidence.interface_pae(masked), "id", "left")
        .join(confidence.interface_plddt(masked), "id", "left")
        .select("id", "s", "interface_pae", "min_interface_pae", "interface_plddt",
                F.col("s.iptm").alias("iptm"), F.col("s.ptm").alias("ptm"), F.col("s.plddt").alias("mean_plddt"))
    )
    notes = F.when(F.col("s").isNull(), _note("missing", F.lit("prediction"))).when(
        F.col("iptm").isNull(), _note("error", F.lit("KeyError: 'iptm'"))
    )
    return _score_rows(joined, "protenix_confidence", F.col("iptm"), C.CONFIDENCE_KEYS, notes)


@SCORERS.register("rmsd_to_crystal")
def rmsd_to_crystal(examples: DataFrame, predictions_root: str, interface_score: bool = False) -> DataFrame:
    """Binder RMSD after superposing the target; with ``interface_score`` also the quality of the best
    interface, as ``dockq_best``.  The external tool of that name is reported as absent otherwise."""
    spark = examples.sparkSession
    found, atoms, roles, failures = _roles_and_atoms(spark, examples, predictions_root, "positional")
    crystals = examples.where(F.col("complex_pdb_path").isNotNull()).select("id", F.col("complex_pdb_path").alias("path"))
    folders = [r[0] for r in crystals.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]
    if not folders:
        crystal_texts = crystals.withColumn("text", F.lit(None).cast("string")).limit(0)
    else:
        raw = spark.read.text(folders, wholetext=True)
        plain = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/")
        crystal_texts = crystals.join(raw.select(plain.alias("path"), F.col("value").alias("text")), "path")
    crystal_atoms = cut_lineage(atoms_from_files(crystal_texts.select(F.col("id").alias("structure_id"), "path", "text")))
    crystal_ids = chain_roles.crystal_roles(examples)
    sizes = examples.select("id", F.size("binder_chains").alias("nb"), F.size("target_chains").alias("nt")).join(crystal_ids, "id")
    mismatch = sizes.select(
        "id",
        F.when((F.size("binder_ids") == 0) | (F.size("target_ids") == 0), "missing_metadata_chain_ids")
        .when(F.size("binder_ids") != F.col("nb"), "binder_chain_count_mismatch")
        .when(F.size("target_ids") != F.col("nt"), "target_chain_count_mismatch")
        .alias("mismatch"),
    )
    usable = mismatch.where(F.col("mismatch").isNull()).select("id")
    lost = chain_roles.missing_chains(crystal_ids.join(usable, "id", "left_semi"), crystal_atoms)
    lost = lost.groupBy("id").agg(F.min("chain_id").alias("chain_id"))
    lost = lost.select("id", F.concat(F.lit("KeyError: '"), "chain_id", F.lit("'")).alias("crystal_error"))
    ready = usable.join(lost, "id", "left_anti").join(crystal_texts.select("id"), "id", "left_semi")
    pred = cut_lineage(chain_roles.assign(atoms, roles.join(ready, "id", "left_semi")))
    present = pred.select(F.col("structure_id").alias("id")).distinct()
    crys = cut_lineage(chain_roles.assign(crystal_atoms, crystal_ids.join(present, "id", "left_semi")))
    features = superpose.rmsd_features(pred, crys).withColumnsRenamed({"structure_id": "id", "error": "pair_error"})
    absent = F.create_map(F.lit("dockq_error"), F.lit("ModuleNotFoundError: DockQ is not installed"))
    if interface_score:
        best = F.col("quality_best").alias("dockq_best")
        quality = interface_quality.best_quality(pred, crys).select(F.col("structure_id").alias("id"), best)
        features = features.join(quality, "id", "left")
        absent = F.when(F.col("dockq_best").isNull(), F.create_map(F.lit("dockq_error"), F.lit("no native interface")))
    joined = (
        examples.select("id")
        .join(found.withColumn("found", F.lit(True)), "id", "left")
        .join(crystal_texts.select("id", F.lit(True).alias("has_crystal")), "id", "left")
        .join(mismatch, "id", "left")
        .join(failures, "id", "left")
        .join(lost, "id", "left")
        .join(features, "id", "left")
    )
    error = F.coalesce("mismatch", "error", "crystal_error", "pair_error")
    notes = (
        F.when(F.col("found").isNull(), _note("missing", F.lit("prediction")))
        .when(F.col("has_crystal").isNull(), _note("missing", F.lit("crystal")))
        .when(error.isNotNull(), _note("error", error))
        .otherwise(absent)
    )
    names = [c for c in features.columns if c not in ("id", "pair_error")]
    return _score_rows(joined, "rmsd_to_crystal", F.col("binder_ca_rmsd_target_aligned"), names, notes)


def score(name: str, examples: DataFrame, **options) -> DataFrame:
    """Run a registered scorer over all examples."""
    return SCORERS.get(name)(examples, **options)


def feature_rows(
    pairs: DataFrame, predictions_root: str, numbering: DataFrame | None = None
) -> DataFrame:
    """Pair feature table: confidence, geometry and loop engagement; blanks without a prediction.

    ``numbering`` has (id, residue_idx, imgt_pos) from an external antibody numbering; without it,
    or where it has no entry, the loop columns are zero and ``cdr_mapping_ok`` is 0.  Pairs whose
    structure cannot be used have ``error`` set instead of features.
    """
    from pairgate.sources.loaders import examples_from_pairs

    examples = examples_from_pairs(pairs)
    spark = pairs.sparkSession
    conf = protenix_confidence(examples, predictions_root)
    found, atoms, roles, failures = _roles_and_atoms(spark, examples, predictions_root, "sequence")
    placed = cut_lineage(chain_roles.assign(atoms, roles))
    geom = geometry.interface_features(placed).select(F.col("structure_id").alias("pair_id"), *C.GEOMETRY_KEYS)
    near = geometry.interface_residues(placed).select(F.col("structure_id").alias("id"), F.col("binder_res").alias("residue_idx"))
    lengths = pairs.select(F.col("pair_id").alias("id"), F.length("binder_seq").alias("n"))
    near = near.join(lengths, "id").where(F.col("residue_idx") < F.col("n")).drop("n")
    base = pairs.select("pair_id", "label", "antigen_cluster", "fold")
    wide = conf.select(F.col("example_id").alias("pair_id"), *[F.try_element_at("extras", F.lit(k)).alias(k) for k in C.CONFIDENCE_KEYS])
    out = (
        base.join(found.select(F.col("id").alias("pair_id"), F.lit(1).alias("present")), "pair_id", "left")
        .join(failures.withColumnRenamed("id", "pair_id"), "pair_id", "left")
        .join(wide, "pair_id", "left")
        .join(geom, "pair_id", "left")
    )
    if numbering is None:
        out = out.select("*", *[F.lit(None).cast("double").alias(k) for k in C.CDR_KEYS])
    else:
        loops = confidence.loop_engagement(near, numbering).withColumnRenamed("id", "pair_id")
        out = out.join(loops, "pair_id", "left")
    present = F.col("present").isNotNull()
    return out.select(
        "pair_id",
        "label",
        "antigen_cluster",
        "fold",
        F.coalesce("present", F.lit(0)).alias("prediction_present"),
        *[F.when(present, F.col(k)).alias(k) for k in (*C.CONFIDENCE_KEYS, *C.GEOMETRY_KEYS)],
        *[F.when(present, F.coalesce(k, F.lit(0.0))).alias(k) for k in C.CDR_KEYS],
        "error",
    )
