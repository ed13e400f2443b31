"""Explicit schemas of the tables that flow between sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

from pairgate import constants as C


def all_strings(*names: str) -> T.StructType:
    """Schema of a delimited file: every cell a nullable string, cast later."""
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.DoubleType()) for name in names])


EXAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("binder_chains", T.ArrayType(T.StringType()), False),
        T.StructField("binder_format", T.StringType(), False),
        T.StructField("target_chains", T.ArrayType(T.StringType()), False),
        T.StructField("target_name", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("target_pdb_id", T.StringType()),
        T.StructField("complex_pdb_path", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), False),
    ]
)

# One row per scored example.  ``value`` is NULL when the example could not be scored; the
# reason is then in ``notes`` under "missing" or "error".
SCORE = T.StructType(
    [
        T.StructField("example_id", T.StringType(), False),
        T.StructField("scorer_name", T.StringType(), False),
        T.StructField("value", T.DoubleType()),
        T.StructField("extras", T.MapType(T.StringType(), T.DoubleType()), False),
        T.StructField("notes", T.MapType(T.StringType(), T.StringType()), False),
    ]
)

SCORE_FILE = all_strings(*C.SCORE_COLUMNS)
PAIR_FILE = all_strings(*C.PAIR_COLUMNS)
FEATURE_FILE = all_strings(
    "pair_id",
    "label",
    "antigen_cluster",
    "fold",
    "prediction_present",
    "iptm",
    "ptm",
    "interface_pae",
    "min_interface_pae",
    "interface_plddt",
    "mean_plddt",
    *C.GEOMETRY_KEYS,
    *C.CDR_KEYS,
)

ATOM = T.StructType(
    [
        T.StructField("structure_id", T.StringType(), False),
        T.StructField("chain_id", T.StringType(), False),
        T.StructField("chain_ord", T.IntegerType(), False),
        T.StructField("res_ord", T.IntegerType(), False),
        T.StructField("resseq", T.IntegerType()),
        T.StructField("icode", T.StringType()),
        T.StructField("resname", T.StringType(), False),
        T.StructField("atom_ord", T.IntegerType(), False),
        T.StructField("atom_name", T.StringType(), False),
        T.StructField("element", T.StringType(), False),
        T.StructField("x", T.DoubleType(), False),
        T.StructField("y", T.DoubleType(), False),
        T.StructField("z", T.DoubleType(), False),
    ]
)

AF2M_SCORES = T.StructType(
    [
        T.StructField("iptm", T.DoubleType()),
        T.StructField("ptm", T.DoubleType()),
        T.StructField("plddt", T.ArrayType(T.DoubleType())),
        T.StructField("pae", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("max_pae", T.DoubleType()),
    ]
)
PROTENIX_SUMMARY = T.StructType(
    [
        T.StructField("iptm", T.DoubleType()),
        T.StructField("ptm", T.DoubleType()),
        T.StructField("plddt", T.DoubleType()),
    ]
)
PROTENIX_FULL = T.StructType(
    [
        T.StructField("token_pair_pae", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("contact_probs", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("atom_plddt", T.ArrayType(T.DoubleType())),
        T.StructField("atom_to_token_idx", T.ArrayType(T.IntegerType())),
    ]
)
CHAIN_ROLES = T.StructType(
    [
        T.StructField("binder", T.ArrayType(T.StringType())),
        T.StructField("target", T.ArrayType(T.StringType())),
    ]
)
