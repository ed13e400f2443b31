"""Names, residue sets, cutoffs and sequences that results depend on."""

from __future__ import annotations

# --- Fixed values: amino acids -------------------------------------------------------------
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}

# --- Fixed values: one-letter residue classes of the sequence features ----------------------
AROMATIC_LETTERS = "FWY"
HYDROPHOBIC_LETTERS = "AVLIMFWC"
POLAR_LETTERS = "STNQ"
POSITIVE_LETTERS = "KR"
NEGATIVE_LETTERS = "DE"

# --- Fixed values: three-letter residue classes of the interface chemistry ------------------
HYDROPHOBIC_RESIDUES = ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO")
AROMATIC_RESIDUES = ("PHE", "TYR", "TRP", "HIS")
POLAR_RESIDUES = ("SER", "THR", "ASN", "GLN", "CYS", "TYR", "HIS")
POSITIVE_RESIDUES = ("LYS", "ARG", "HIS")
NEGATIVE_RESIDUES = ("ASP", "GLU")

# --- Fixed values: geometry ------------------------------------------------------------------
VDW_RADII = {"C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80}
VDW_RADIUS_DEFAULT = 1.70
BACKBONE_ATOMS = ("N", "CA", "C", "O")
INTERFACE_CUTOFF = 8.0
# Published definition of the interface quality score: cutoffs in Angstrom and scales.
QUALITY_CONTACT_CUTOFF, QUALITY_INTERFACE_CUTOFF = 5.0, 10.0
QUALITY_IRMSD_SCALE, QUALITY_LRMSD_SCALE = 1.5, 8.5
CONTACT_CUTOFFS = (4, 6, 8)
ATOM_CONTACT_CUTOFF = 5.0
ATOM_CLOSE_CUTOFF = 3.0
ATOM_CLASH_CUTOFF = 2.0
PROBE_RADIUS = 1.4
OCCLUSION_SCALE = 0.35
PACKED_GAP_MAX = 1.0
SHELL_GAP_MAX = 2.0
INTERFACE_CONTACT_PROBABILITY = 0.5
NEAR_NATIVE_RMSD = 8.0

# --- Fixed values: antibody loop ranges (inclusive) ------------------------------------------
IMGT_CDR_RANGES = {"cdr1": (27, 38), "cdr2": (56, 65), "cdr3": (105, 117)}
CHOTHIA_HEAVY_CDR_RANGES = {"H1": (26, 32), "H2": (52, 56), "H3": (95, 102)}
CHOTHIA_LIGHT_CDR_RANGES = {"L1": (24, 34), "L2": (50, 56), "L3": (89, 97)}

# --- Fixed values: sequences -----------------------------------------------------------------
# Human EpCAM extracellular domain (UniProt P16422, residues 24-265).
EPCAM_ECD = (
    "QEECVCENYKLAVNCFVNNNRQCQCTSVGAQNTVICSKLAAKCLVMKAEMNGSKLG"
    "RRAKPEGALQNNDGLYDPDCDESGLFKAKQCNGTSTCWCVNTAGVRRTDKDTEITC"
    "SERVRTYWIIIELKHKAREKPYDSKSLRTALQKEITTRYQLDPKFITSILYENNVI"
    "TIDLVQNSSQKTQNDVDIADVAYYFEKDVKGESLFHSKKMDLTVNGEQLDLDPGQT"
    "LIYYVDEKAPEFSM"
)
# Human IL-6 signal peptide (UniProt P05231, residues 1-29).
SIGNAL_PEPTIDES = ("MNSFSTSAFGPVAFSLGLLLVLPAAFPAP",)

# --- Fixed values: thresholds and grids ------------------------------------------------------
PREVALENCE_GRID = (0.5, 0.1, 0.01, 0.001, 0.0001)
KMER_LENGTH = 5
WINDOW_LENGTH = 1022
DOCKQ_ACCEPTABLE = 0.23

# --- Fixed values: column and metric names ---------------------------------------------------
SEQUENCE_FEATURES = (
    "binder_length",
    "binder_net_charge",
    "binder_aromatic_frac",
    "binder_hydrophobic_frac",
    "binder_polar_frac",
    "binder_cysteine_frac",
    "target_length",
    "target_net_charge",
    "target_aromatic_frac",
    "target_hydrophobic_frac",
    "target_polar_frac",
    "target_cysteine_frac",
    "length_ratio",
)
SCORE_COLUMNS = (
    "example_id",
    "scorer_name",
    "value",
    "label",
    "target_name",
    "source",
    "binder_format",
    "split",
    "extras_json",
)
PAIR_COLUMNS = ("pair_id", "binder_seq", "antigen_seq", "label", "antigen_cluster", "fold")
CONFIDENCE_KEYS = (
    "iptm",
    "ptm",
    "interface_pae",
    "min_interface_pae",
    "interface_plddt",
    "mean_plddt",
)
GEOMETRY_KEYS = (
    "n_interface_residues_binder",
    "n_interface_residues_target",
    "buried_sasa_proxy_a2",
    "atom_contacts_5a",
    "shape_complementarity_proxy",
    "atom_clash_fraction_2a",
)
CDR_KEYS = (
    "cdr_contact_fraction",
    "cdr1_contact_fraction",
    "cdr2_contact_fraction",
    "cdr3_contact_fraction",
    "cdr_mapping_ok",
)
CONFIDENCE_METRICS = (
    "iptm",
    "ptm",
    "ranking_confidence",
    "iptm_over_ptm",
    "plddt_full_mean",
    "plddt_binder_mean",
    "plddt_target_mean",
    "plddt_interface_mean",
    "pae_interchain_mean",
    "pae_interchain_max",
    "pae_interface_mean",
)
CONFIDENCE_LOWER_IS_BETTER = ("pae_interchain_mean", "pae_interchain_max", "pae_interface_mean")
PLDDT_METRICS = (
    "plddt_full_mean",
    "plddt_binder_mean",
    "plddt_target_mean",
    "plddt_interface_mean",
)
DEFAULT_LOGISTIC_FEATURES = (
    "iptm",
    "ptm",
    "ranking_confidence",
    "iptm_over_ptm",
    "plddt_binder_mean",
    "plddt_interface_mean",
    "pae_interchain_mean",
    "pae_interface_mean",
    "pae_interchain_max",
)
STRUCTURE_LOWER_IS_BETTER = (
    "atom_clashes_2a",
    "atom_clash_fraction_2a",
    "mean_interface_residue_distance_8a",
    "median_interface_residue_distance_8a",
    "std_interface_residue_distance_8a",
    "min_interchain_heavy_atom_distance",
    "mean_interchain_heavy_atom_distance",
    "mean_abs_nearest_surface_gap",
)
CLASH_METRICS = ("atom_clashes_2a", "atom_clash_fraction_2a")
EXPOSURE_METRICS = (
    "buried_sasa_proxy_a2",
    "buried_sasa_proxy_binder_a2",
    "buried_sasa_proxy_target_a2",
    "buried_sasa_proxy_per_binder_atom",
    "buried_sasa_proxy_per_target_atom",
    "buried_sasa_proxy_per_interface_residue",
    "buried_sasa_balance",
    "mean_binder_atom_exposure_loss",
    "mean_target_atom_exposure_loss",
)
PACKING_METRICS = (
    "atom_packing_pairs_0_1a_gap",
    "atom_packing_fraction_0_1a_gap",
    "atom_packing_shell_pairs_2a_gap",
    "binder_atom_packing_coverage_0_1a_gap",
    "target_atom_packing_coverage_0_1a_gap",
    "atom_packing_complementarity_score",
    "mean_abs_nearest_surface_gap",
    "shape_complementarity_proxy",
)
CHAMPLOO_VHH_META = ("vhh_length", "resolution")
CHAMPLOO_ANTIGEN_META = (
    "antigen_length",
    "antigen_helix_content",
    "antigen_sheet_content",
    "antigen_loop_content",
)
SPLIT_ORDER = {"all": 0, "random_pair": 1, "held_out_vhh": 2, "held_out_antigen": 3}
MODEL_ORDER = {"raw_iptm": 0, "logistic_iptm": 1, "logistic_iptm_meta": 2}

# --- Fixed values: the columns that each feature rung adds to the one before it ---------------
_RUNG_BLOCKS = (
    ("iptm",),
    ("ptm", "interface_pae", "min_interface_pae", "mean_plddt", "interface_plddt_missing"),
    (
        "n_interface_residues_binder",
        "n_interface_residues_target",
        "buried_sasa_proxy_a2",
        "atom_contacts_5a",
        "shape_complementarity_proxy",
        "atom_clash_fraction_2a",
    ),
    ("cdr_contact_fraction", "cdr1_contact_fraction", "cdr2_contact_fraction", "cdr3_contact_fraction"),
)


def rung_columns(rung: int) -> tuple[str, ...]:
    """Feature names of one rung (0-3)."""
    if not 0 <= rung < len(_RUNG_BLOCKS):
        raise KeyError(f"no rung {rung}")
    return sum(_RUNG_BLOCKS[: rung + 1], ())


# --- Fixed values: structural model features and the reported structural metrics -------------
STRUCTURE_FEATURES = (
    "contacts_per_binder_residue_4a",
    "contacts_per_binder_residue_6a",
    "contacts_per_binder_residue_8a",
    "contacts_per_target_residue_4a",
    "contacts_per_target_residue_6a",
    "contacts_per_target_residue_8a",
    "binder_interface_fraction",
    "target_interface_fraction",
    "atom_contact_fraction_5a",
    "atom_close_contact_fraction_3a",
    "atom_clash_fraction_2a",
    "atom_clashes_2a",
    "hydrophobic_contact_fraction_6a",
    "aromatic_contact_fraction_6a",
    "polar_contact_fraction_6a",
    "charged_contact_fraction_6a",
    "opposite_charge_contact_fraction_6a",
    "same_charge_contact_fraction_6a",
    "mean_interface_residue_distance_8a",
    "median_interface_residue_distance_8a",
    "std_interface_residue_distance_8a",
    "close_residue_contact_fraction_4a_within_8a",
    "min_interchain_heavy_atom_distance",
    "mean_interchain_heavy_atom_distance",
    "buried_sasa_proxy_per_binder_atom",
    "buried_sasa_proxy_per_target_atom",
    "buried_sasa_proxy_per_interface_residue",
    "buried_sasa_balance",
    "mean_binder_atom_exposure_loss",
    "mean_target_atom_exposure_loss",
    "atom_packing_fraction_0_1a_gap",
    "binder_atom_packing_coverage_0_1a_gap",
    "target_atom_packing_coverage_0_1a_gap",
    "atom_packing_complementarity_score",
    "mean_abs_nearest_surface_gap",
    "shape_complementarity_proxy",
)
STRUCTURE_MODEL_LOWER_IS_BETTER = ("atom_close_contact_fraction_3a", *STRUCTURE_LOWER_IS_BETTER)
STRUCTURE_CLASH_FEATURES = (
    "atom_close_contact_fraction_3a",
    "atom_clash_fraction_2a",
    "atom_clashes_2a",
)
STRUCTURE_METRICS = (
    "value",
    "residue_pair_contacts_4a",
    "residue_pair_contacts_6a",
    "residue_pair_contacts_8a",
    "residue_pair_contact_fraction_4a",
    "residue_pair_contact_fraction_6a",
    "residue_pair_contact_fraction_8a",
    "contacts_per_binder_residue_4a",
    "contacts_per_binder_residue_6a",
    "contacts_per_binder_residue_8a",
    "contacts_per_target_residue_4a",
    "contacts_per_target_residue_6a",
    "contacts_per_target_residue_8a",
    "n_interface_residues_binder",
    "n_interface_residues_target",
    "binder_interface_fraction",
    "target_interface_fraction",
    "atom_contacts_5a",
    "atom_contact_fraction_5a",
    "atom_close_contacts_3a",
    "atom_close_contact_fraction_3a",
    "atom_clashes_2a",
    "atom_clash_fraction_2a",
    "buried_area_proxy_5a",
    *EXPOSURE_METRICS,
    *PACKING_METRICS,
    "hydrophobic_contact_pairs_6a",
    "hydrophobic_contact_fraction_6a",
    "aromatic_contact_pairs_6a",
    "aromatic_contact_fraction_6a",
    "polar_contact_pairs_6a",
    "polar_contact_fraction_6a",
    "charged_contact_pairs_6a",
    "charged_contact_fraction_6a",
    "opposite_charge_contact_pairs_6a",
    "opposite_charge_contact_fraction_6a",
    "same_charge_contact_pairs_6a",
    "same_charge_contact_fraction_6a",
    "mean_interface_residue_distance_8a",
    "median_interface_residue_distance_8a",
    "std_interface_residue_distance_8a",
    "close_residue_contact_fraction_4a_within_8a",
    "min_interchain_heavy_atom_distance",
    "mean_interchain_heavy_atom_distance",
)
