import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.operators import metrics as M
from pairgate.plans import analysis, gates, pairs


def planted(spark, n=60, seed=0, shift=0):
    """Feature table in which the interface score separates the classes."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = i % 3 == 0
        cells = {c: f"{rng.normal():.4f}" for c in C.rung_columns(3) if c != "interface_plddt_missing"}
        cells["iptm"] = f"{0.5 + 0.3 * y + 0.15 * rng.normal():.4f}"
        cells["interface_plddt"] = "" if i % 4 else "70.0"
        cells["cdr_mapping_ok"] = "1.0" if i % 10 else "0.0"
        rows.append({"pair_id": f"p{i + shift}", "label": str(int(y)), "antigen_cluster": "0", "fold": str(i % 5), **cells, "ordinal": i})
    return spark.createDataFrame(rows)


def test_in_distribution(spark):
    r = gates.in_distribution(planted(spark), l2=1.0, target_precision=0.9, seed=1, n_boot=30)
    assert r["n"] == 60 and r["n_positive"] == 20 and r["cdr_mapping_failure_rate"] == pytest.approx(0.1)
    assert set(r["rungs"]) == set(r["random_split"]) == {"rung0", "rung1", "rung2", "rung3"}
    assert r["rungs"]["rung0"]["auroc"] > 0.7 and r["frozen_model"]["feature_names"] == list(C.rung_columns(3))
    lo, hi = r["paired_deltas"]["r3_minus_r0"]["delta_auroc_ci"]
    assert lo <= hi and len(r["rungs"]["rung1"]["gate"]["ppv_sweep"]) == 5


def test_pair_building_and_overlap_transfer(spark):
    from pairgate.sources.loaders import examples_from_pairs

    rng = np.random.default_rng(0)
    seq = lambda k: "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), k))
    rows = [(f"x{i}", seq(20), seq(30), "1", "0", "0") for i in range(12)]
    table = spark.createDataFrame(rows, "pair_id string, binder_seq string, antigen_seq string, label string, antigen_cluster string, fold string")
    pos = pairs.positives_from_examples(examples_from_pairs(table), n_splits=2, seed=3).cache()
    built = pairs.build_pairs(pos, k=2, seed=3).cache()
    assert built.count() == 36 and built.where("label = '0'").count() == 24
    assert built.columns == list(C.PAIR_COLUMNS)


def test_sequence_ladder_pieces(spark):
    with pytest.raises(ValueError, match="unknown layout"):
        gates.layout_columns("other", 2)
    cache = spark.createDataFrame([("A", [1.0, 2.0]), ("B", [3.0, 4.0])], "key string, embedding array<float>")
    p = spark.createDataFrame([("A", "B")], "b string, g string")
    row = gates.embedded_pairs(p, cache, "b", "g").select(*gates.layout_columns("hadamard", 2)).first()
    assert tuple(row) == (3.0, 8.0)
    with pytest.raises(Exception, match="no embedding"):
        gates.embedded_pairs(spark.createDataFrame([("A", "Z")], "b string, g string"), cache, "b", "g").collect()


def test_confidence_against_quality(spark):
    rng = np.random.default_rng(2)
    extras = ", ".join(f"{m}: double" for m in C.CONFIDENCE_METRICS)
    conf, ref = [], []
    for i in range(30):
        good = i % 2
        conf.append((f"e{i}", i, 0.5, "vhh" if i % 3 else "fab", tuple(float(good + rng.normal()) for _ in C.CONFIDENCE_METRICS)))
        ref.append((f"e{i}", i, 3.0 if good else 9.0, "vhh", (0.5 if good else None,)))
    c = spark.createDataFrame(conf, f"example_id string, ordinal long, value double, binder_format string, extras struct<{extras}>")
    q = spark.createDataFrame(ref, "example_id string, ordinal long, value double, binder_format string, extras struct<dockq_best: double>")
    table, buckets = analysis.confidence_against_quality(c, q, q, stratify=True)
    rows = {(r["stratum"], r["label"], r["metric"]): r for r in table.collect()}
    assert rows[("all", "rmsd<4A", "iptm")]["auroc"] > 0.5 and rows[("all", "rmsd<4A", "pae_interface_mean")]["auroc"] < 0.5
    assert ("fab", "rmsd<8A", "ptm") in rows and rows[("all", "dockq_best>=0.23", "iptm")]["auroc"] is None
    assert {r["bucket"]: r["n"] for r in buckets.collect()} == {"<=4 Å": 15, "4-8 Å": 0, ">8 Å": 15}
    joined = c.select("ordinal", F.lit(1).alias("y"), "extras.*").withColumn("y", (F.col("ordinal") % 2).cast("int"))
    loo = analysis.loo_logistic(joined, "y", [("iptm", ("iptm",))], C.CONFIDENCE_LOWER_IS_BETTER).first()
    assert loo["n"] == 30 and loo["auroc"] > 0.4 and "iptm" in loo["coefficients_json"]
    assert len(analysis.ablation_sets()) == 24


def test_frozen_gate_report(spark):
    df = spark.createDataFrame([(i, float(i), int(i > 5)) for i in range(10)], "ordinal long, score double, label int")
    r = gates.frozen_gate_report(df, 5.5, n_boot=20)
    assert r["n"] == 10 and r["metrics"]["recall"] == 1.0 and r["recall_ci"] == [1.0, 1.0]
    only = gates.frozen_gate_report(df.where("label = 0"), 5.5, n_boot=20)
    assert only["recall_ci"] == [None, None] and only["specificity_ci"] == [1.0, 1.0]
    assert M.auroc(df).first()["auroc"] == 1.0


def test_blank_numbers_raise(spark):
    table = planted(spark)
    blank = table.withColumn("ptm", F.when(F.col("ordinal") == 3, F.lit(" ")).otherwise(F.col("ptm")))
    with pytest.raises(Exception, match="a number is missing"):
        gates.rung_table(blank).collect()
    assert gates.rung_table(table).count() == 60


def test_orthogonal_report(spark):
    from pairgate.operators import linear

    rows = [(f"e{i}", "BIND" if i % 2 else "NONBIND", ["ACDEFGHIKL" * (1 + i % 3)], ["MNPQRSTVWY" * (1 + i % 2)]) for i in range(24)]
    examples = spark.createDataFrame(rows, "id string, label string, binder_chains array<string>, target_chains array<string>")
    features = gates.example_features(examples, "BIND")
    names = [c for c in features.columns if c.endswith("_length")]
    gate = linear.freeze(features, names, "label", l2=1.0, target_precision=0.5)
    report = gates.orthogonal_report(examples, gate, "BIND", n_boot=20)
    assert report["n"] == 24 and report["n_positive"] == 12 and len(report["recall_ci"]) == 2
    with pytest.raises(ValueError, match="no examples"):
        gates.orthogonal_report(examples.limit(0), gate, "BIND")
