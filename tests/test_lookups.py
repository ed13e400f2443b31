import pytest

from pairgate.operators import relational as R
from pairgate.operators.pooling import pool_windows
from pairgate.plans.analysis import confidence_columns
from pairgate.sources import loaders

OPTIONAL = ["Lchain", "antigen_chain", "antigen_type", "antigen_name", "resolution", "method", "scfv", "compound", "antigen_species", "heavy_species", "date"]


def test_ids_are_matched_against_summary_rows(spark):
    columns = ["pdb", "Hchain", *OPTIONAL, "ordinal"]
    row = lambda o, pdb, h, ag, res="2.0": (pdb, h, "NA", ag, "protein", f"name{o}", res, "X", "False", "", "", "", "", o)
    rows = [row(0, "1ABC", "H", "A"), row(1, "1ABC", "H", "B"), row(2, "1abc", "H", "A"), row(3, "2XYZ", "K", "A | B"), row(4, "3BAD", "H", "A", "9.0")]
    summary = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'ordinal' else 'string'}" for c in columns))
    chains = [(p, c, s * 20, f"/{p}.pdb") for p in ("1abc", "2xyz", "3bad") for c, s in (("H", "QV"), ("K", "QV"), ("A", "MK"), ("B", "LL"))]
    sequences = spark.createDataFrame(chains, "pdb string, chain_id string, sequence string, path string")
    candidates = loaders.structure_candidates(summary, sequences, max_resolution=3.0, min_antigen_length=30)
    # The two heavy chains are alike: both ids are found all the same, and the earliest row makes each.
    ids = spark.createDataFrame([("sabdab-1abc-H-A",), ("sabdab-1abc-H-B",), ("sabdab-2xyz-K-A",)], "id string")
    got = {r["id"]: r for r in loaders.examples_by_id(candidates, ids).collect()}
    assert set(got) == {"sabdab-1abc-H-A", "sabdab-1abc-H-B", "sabdab-2xyz-K-A"}
    assert got["sabdab-1abc-H-A"]["target_name"] == "name0" and len(got["sabdab-2xyz-K-A"]["target_chains"]) == 2
    with pytest.raises(Exception, match="no example for sabdab-3bad-H-A"):
        loaders.examples_by_id(candidates, spark.createDataFrame([("sabdab-3bad-H-A",)], "id string")).collect()


def test_pooling_weights_windows_by_length(spark):
    rows = [("a", [1.0, 2.0], 3), ("a", [5.0, 6.0], 1), ("b", [1.0, 1.0], 2), ("b", None, 5), ("b", [9.0, 9.0], 0), ("c", None, 1)]
    df = spark.createDataFrame(rows, "key string, embedding array<float>, length int")
    got = {r["key"]: (r["embedding"], r["length"]) for r in pool_windows(df, ["key"]).collect()}
    assert got == {"a": ([2.0, 3.0], 4), "b": ([1.0, 1.0], 2)}
    uneven = spark.createDataFrame([("a", [1.0], 1), ("a", [1.0, 2.0], 1)], "key string, embedding array<float>, length int")
    with pytest.raises(Exception, match="different widths"):
        pool_windows(uneven, ["key"]).collect()
    assert pool_windows(df.limit(0), ["key"]).count() == 0


def test_lookup_of_both_sides(spark):
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "none")], "left string, right string")
    dim = spark.createDataFrame([("x", 1, 10), ("y", 2, 20)], "k string, u int, v int")
    got = R.two_sided_lookup(pairs, dim, "k", {"left": {"u": "lu", "v": "lv"}, "right": {"v": "rv"}})
    assert {(r.left, r.right, r.lu, r.lv, r.rv) for r in got.collect()} == {("x", "y", 1, 10, 20), ("y", "x", 2, 20, 10)}


def test_value_read_as_the_interface_score(spark):
    rows = [("e", "POS", 0, 0.7, (0.2, float("nan"))), ("f", "SCR", 1, float("nan"), None)]
    df = spark.createDataFrame(rows, "example_id string, label string, ordinal long, value double, extras struct<iptm: double, ptm: double>")
    got = {r["example_id"]: (r["iptm"], r["ptm"]) for r in confidence_columns(df, ("iptm", "ptm")).collect()}
    assert got == {"e": (0.7, None), "f": (None, None)}
