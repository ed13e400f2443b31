import json

import numpy as np
import pytest
from helpers import pdb_line, pdb_text
from pyspark.sql import functions as F

from pairgate import cli, scoring
from pairgate.sources import loaders, sinks, tables
from pairgate.sources.registry import LOADERS, SCORERS, Registry


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_registry():
    assert SCORERS.names() == ["af2m_confidence", "length", "protenix_confidence", "rmsd_to_crystal", "structural_interface"]
    assert LOADERS.names() == ["avida", "epcam", "epcam_killing", "sabdab"]
    with pytest.raises(KeyError, match="available"):
        LOADERS.get("nope")
    r = Registry("thing")
    r.register("a")(lambda: None)
    with pytest.raises(ValueError):
        r.register("a")(lambda: None)


def test_epcam_loader_and_cli(spark, tmp_path, capsys):
    write(tmp_path / "epcam_positives_filtered.csv", "vhh_no,vhh_sequence\n1,QVQL\n2,QVQLV\n")
    write(tmp_path / "epcam_scrambled_negatives.csv", "vhh_id,vhh_sequence,source_vhh_no\ns1,QQ,1\n")
    write(tmp_path / "epcam_literature_negatives.csv", "vhh_id,sequence,target\nx,QVA,HER2\n")
    rows = {r["id"]: r for r in loaders.epcam(spark, str(tmp_path)).collect()}
    assert {i: r["label"] for i, r in rows.items()} == {"epcam-pos-1": "POS", "epcam-pos-2": "POS", "s1": "SCR", "epcam-off-x": "OFF"}
    assert rows["epcam-off-x"]["metadata"]["real_target"] == "HER2" and rows["s1"]["metadata"]["negative_type"] == ""
    out = tmp_path / "scores"
    assert cli.main(["bench", "score", "--scorer", "length", "--loader", "epcam", "--data-dir", str(tmp_path), "--output", str(out)]) == 0
    back = tables.read_delimited(spark, str(out))
    assert {r["example_id"]: float(r["value"]) for r in back.collect()} == {"epcam-pos-1": 4.0, "epcam-pos-2": 5.0, "s1": 2.0, "epcam-off-x": 3.0}
    assert json.loads(back.first()["extras_json"]) == {"binder_chain_count": "1"}
    cli.main(["bench", "list-loaders"])
    assert "avida" in capsys.readouterr().out


def test_killing_and_avida(spark, tmp_path):
    write(tmp_path / "k.csv", "vhh_id,vhh_sequence,label\n1,QV,Good\n2,QV, Bad \n")
    assert [r["label"] for r in loaders.epcam_killing(spark, str(tmp_path / "k.csv")).orderBy("id").collect()] == ["BIND", "NONBIND"]
    write(tmp_path / "bad.csv", "vhh_id,vhh_sequence,label\n1,QV,Meh\n")
    with pytest.raises(Exception, match="unexpected killing label"):
        loaders.epcam_killing(spark, str(tmp_path / "bad.csv")).collect()
    write(tmp_path / "records.csv", "VHH_sequence,Ag_label,label\nAA,wt,1\n,wt,1\nCC,none,0\nDD,wt,2\nEE,wt,0\n")
    write(tmp_path / "antigens.csv", "antigen_label,Ag_sequence\nwt,old\nwt,MKT\n")
    staged = tables.join_antigens(tables.read_delimited(spark, str(tmp_path / "records.csv")), tables.read_delimited(spark, str(tmp_path / "antigens.csv")))
    got = sorted((r["vhh_id"], r["antigen_sequence"], r["label"]) for r in staged.collect())
    assert got == [("avida-0", "MKT", "1"), ("avida-4", "MKT", "0")]
    sinks.write_csv(staged, str(tmp_path / "staged"))
    assert sorted(r["label"] for r in loaders.avida(spark, str(tmp_path / "staged")).collect()) == ["BIND", "NONBIND"]


def ca_pdb(chains):
    serial, lines = 1, []
    for chain, names in chains.items():
        for i, n in enumerate(names):
            lines.append(pdb_line(serial, "CA", n, chain, i + 1, i * 3.8, 0, 0, "C"))
            serial += 1
    return "\n".join(lines)


def test_sabdab_loader(spark, tmp_path):
    h = ["GLN", "VAL", "GLN", "LEU", "GLU", "SER", "GLY", "GLY", "GLY", "LEU"]
    l = ["ASP", "ILE"]
    ag = ["ALA"] * 32
    other = ["TRP", "TYR", "PHE", "HIS", "LYS", "ARG", "ASP", "GLU", "ASN", "GLN"]
    for pdb, chains in {"1abc": {"H": h, "L": l, "A": ag}, "2def": {"H": h, "A": ag}, "3ghi": {"H": other, "L": l, "A": ag, "B": ag[:3]}, "4sht": {"H": other, "A": ag[:5]}}.items():
        write(tmp_path / f"sabdab_dataset/{pdb}/structure/chothia/{pdb}.pdb", ca_pdb(chains))
    cols = "pdb Hchain Lchain model antigen_chain antigen_type antigen_name resolution method scfv".split()
    rows = [
        ["1ABC", "H", "L", "0", "A", "protein", "ag1", "2.0", "X", "False"],
        ["2def", "H", "NA", "0", "A", "protein", "dup heavy chain", "2.0", "X", "False"],
        ["3ghi", "H", "L", "0", "B | A | Z", "protein | RNA", "ag3", "3.0", "X", "True"],
        ["3ghi", "H", "L", "0", "A", "Hapten", "no protein", "2.0", "X", "True"],
        ["4sht", "H", "NA", "0", "A", "protein", "short antigen", "2.0", "X", "False"],
        ["5mis", "H", "NA", "0", "A", "protein", "no file", "2.0", "X", "False"],
        ["1abc", "H", "L", "0", "A", "protein", "bad resolution", "3.5", "X", "False"],
        ["1abc", "H", "L", "0", "A", "protein", "no resolution", "NOT", "X", "False"],
    ]
    write(tmp_path / "summary.tsv", "\n".join("\t".join(r) for r in [cols, *rows]) + "\n")
    got = {r["id"]: r for r in loaders.sabdab(spark, str(tmp_path)).collect()}
    assert set(got) == {"sabdab-1abc-H-A", "sabdab-3ghi-H-B"}
    fab, scfv = got["sabdab-1abc-H-A"], got["sabdab-3ghi-H-B"]
    assert fab["binder_format"] == "fab" and fab["binder_chains"] == ["QVQLESGGGL", "DI"] and fab["target_pdb_id"] == "1ABC"
    assert scfv["binder_format"] == "scfv" and scfv["binder_chains"] == ["WYFHKRDENQ"]
    assert scfv["metadata"]["antigen_chain"] == "B|A" and scfv["metadata"]["light_chain_sequence"] == "DI"
    assert json.loads(scfv["metadata"]["target_chain_ids"]) == ["B", "A"]


def test_score_reader(spark, tmp_path):
    header = "example_id,scorer_name,value,label,target_name,source,binder_format,split,extras_json\n"
    bodies = ['a,s,0.5,POS,t,x,vhh,,"{""iptm"": 0.7, ""ptm"": NaN}"', 'b,s,,POS,t,x,vhh,,"{""missing"": ""prediction""}"', "c,s,nan,POS,t,x,vhh,,", "d,s,1,POS,t,x,vhh,,{bad", "a,s,0.6,POS,t,x,vhh,,"]
    write(tmp_path / "s.csv", header + "\n".join(bodies) + "\n")
    got = tables.read_scores(spark, str(tmp_path / "s.csv"), ["iptm", "ptm"]).orderBy("ordinal").collect()
    assert [r["example_id"] for r in got] == list("abcda") and [r["ordinal"] for r in got] == list(range(5))
    assert got[0]["extras"]["iptm"] == 0.7 and got[0]["extras"]["ptm"] is None
    assert got[1]["missing"] == "prediction" and [r["value"] for r in got] == [0.5, None, None, 1.0, 0.6]


def test_small_readers(spark, tmp_path):
    write(tmp_path / "m.csv", ",AAAA,BBBB\nAAAA,0.9,x\nBBBB,,0.8\n")
    got = {(r[0], r[1]): r[2] for r in tables.read_matrix(spark, str(tmp_path / "m.csv")).select("row_key", "col_key", "value").collect()}
    assert got == {("AAAA", "AAAA"): 0.9, ("BBBB", "BBBB"): 0.8}
    write(tmp_path / "fa" / "e 1.fasta", ">e\n\nAA:CC:DD\n")
    r = tables.read_fasta_chains(spark, str(tmp_path / "fa")).first()
    assert (r["id"], r["chains"]) == ("e 1", ["AA", "CC", "DD"])
    write(tmp_path / "fb" / "x.fasta", ">e\n")
    with pytest.raises(Exception, match="FASTA too short"):
        tables.read_fasta_chains(spark, str(tmp_path / "fb")).collect()
    write(tmp_path / "msa" / "0" / "non_pairing.a3m", "#c\n>q\nMKT\n>h\nMK-\n")
    links = tables.harvest_alignments(tables.read_alignment_queries(spark, str(tmp_path / "msa")), "/cache").collect()
    assert links[0]["destination"].startswith("/cache/") and links[0]["source"].endswith("0/non_pairing.a3m")
    np.save(tmp_path / "e.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    write(tmp_path / "keys.txt", "a\nb\n\nc\n")
    e = {r["key"]: r["embedding"] for r in tables.read_embeddings(spark, str(tmp_path / "e.npy"), str(tmp_path / "keys.txt")).collect()}
    assert e == {"a": [0.0, 1.0], "b": [2.0, 3.0], "c": [4.0, 5.0]}
    write(tmp_path / "keys2.txt", "a\nb\n")
    with pytest.raises(ValueError, match="mismatch"):
        tables.read_embeddings(spark, str(tmp_path / "e.npy"), str(tmp_path / "keys2.txt"))


def test_archive(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("system_1_2_7abc_8def_model_0.pdb", "system_9_9_7ABC_8DEF_model_0.pdb", "system_1_2_7abc_8def_model_1.pdb", "readme.txt"):
            z.writestr(n, n)
    entries = tables.model_entries(tables.archive_index(spark, str(tmp_path / "a.zip")), 0)
    cells = spark.createDataFrame([("7abc ", "8DEF", 0.5), ("7abc", "7ABC", 0.9)], "row_key string, col_key string, value double")
    got = {r["example_id"]: r for r in tables.archive_manifest(cells, entries).collect()}
    assert got["7ABC__8DEF"]["member_name"] == "system_1_2_7abc_8def_model_0.pdb" and got["7ABC__8DEF"]["label"] == 0
    assert got["7ABC__7ABC"]["member_name"] is None and got["7ABC__7ABC"]["label"] == 1
    assert tables.archive_members(entries, str(tmp_path / "a.zip")).first()["text"] == "system_1_2_7abc_8def_model_0.pdb"


def test_staging(spark, tmp_path):
    pairs = spark.createDataFrame([("p1", "acdx", "MK:TT", "1", "3", "0")], "pair_id string, binder_seq string, antigen_seq string, label string, antigen_cluster string, fold string")
    ex = loaders.examples_from_pairs(pairs)
    inputs = sinks.multimer_inputs(ex, str(tmp_path / "st"), "/out")
    assert inputs.first()["content"] == ">p1\nACD:MK:TT\n"
    assert sinks.write_files(inputs) == 1 and (tmp_path / "st/fasta/p1.fasta").read_text() == ">p1\nACD:MK:TT\n"
    assert sinks.manifest(inputs, "fasta_path").columns == ["example_id", "fasta_path", "out_dir"]
    job = json.loads(sinks.protenix_inputs(ex, "/st", "/out", "/msa").first()["content"])
    assert len(job) == 1 and [s["proteinChain"]["sequence"] for s in job[0]["sequences"]] == ["ACD", "MK", "TT"]
    lines = [r[0] for r in sinks.sequence_manifest(pairs).collect()]
    assert [x.split("\t")[0] for x in lines] == ["MK", "TT", "acdx"]
    assert sinks.uncached(ex, spark.createDataFrame([("p1",)], "id string")).count() == 0
    bad = loaders.examples_from_pairs(pairs.withColumn("binder_seq", F.lit("123")))
    with pytest.raises(Exception, match="no usable chains"):
        sinks.multimer_inputs(bad, "/st", "/out").collect()
    assert sinks.strict_json({"a": [float("nan"), 1.0]}) == {"a": [None, 1.0]}
    payload = lambda v: json.dumps({"iptm": v, "ptm": 0.1, "plddt": [1.0, 3.0], "max_pae": 2.0})
    files = spark.createDataFrame(
        [("e", "e_scores_rank_002_m.json", payload(0.2)), ("e", "e_scores_rank_001_m.json", payload(0.9)), ("e", "e_unrelaxed_rank_001_m.pdb", "")],
        "id string, name string, text string",
    )
    top = json.loads(sinks.rank_summary(files).first()["content"])
    assert top["rank1"]["iptm"] == 0.9 and top["rank1"]["pdb"].endswith(".pdb") and top["per_rank"][1]["pdb"].endswith(".json")


def test_manifest_examples(spark):
    manifest = spark.createDataFrame([("p",), ("p-scramble01",), ("p-wrongtarget02",)], "example_id string")
    parents = spark.createDataFrame([("p", "fab", "T", "POS", "")], "example_id string, binder_format string, target_name string, label string, split string")
    chains = spark.createDataFrame([("p", ["a", "b", "c"]), ("p-scramble01", ["a", "b", "c"]), ("p-wrongtarget02", ["a", "b", "c"])], "id string, chains array<string>")
    got = {r["id"]: r for r in loaders.examples_from_manifest(manifest, parents, chains).collect()}
    assert {i: r["label"] for i, r in got.items()} == {"p": "POS", "p-scramble01": "SCRAMBLE", "p-wrongtarget02": "WRONG_TARGET"}
    assert got["p"]["binder_chains"] == ["a", "b"] and got["p"]["target_chains"] == ["c"] and got["p"]["split"] is None
    with pytest.raises(Exception, match="no parent row"):
        loaders.examples_from_manifest(spark.createDataFrame([("q",)], "example_id string"), parents, chains).collect()


def test_scorers_on_files(spark, tmp_path):
    root = tmp_path / "pred"
    names = ["LYS", "PHE", "ALA"]
    chains = [("A", [(0, 0, 0), (3.8, 0, 0), (7.6, 0, 0)], names), ("B", [(0, 5, 0), (3.8, 5, 0), (7.6, 5, 1)], names)]
    write(root / "e1" / "rank1.pdb", pdb_text(chains))
    write(root / "e2" / "rank1.pdb", pdb_text(chains[:1]))
    write(tmp_path / "crys" / "c1.pdb", pdb_text([("H", chains[0][1], names), ("X", chains[1][1], names)]))
    raw = {"iptm": 0.5, "ptm": 0.25, "plddt": [1, 2, 3, 4, 5, 6], "pae": np.full((6, 6), 2.0).tolist(), "max_pae": 2.0}
    write(root / "e1" / "scores.json", json.dumps({"rank1": {"pdb": "x_unrelaxed_rank_001.pdb"}}))
    write(root / "e1" / "x_scores_rank_001.json", json.dumps(raw))
    write(root / "e1" / "e1_summary_confidence_sample_0.json", json.dumps({"iptm": 0.6, "ptm": 0.5, "plddt": 80.0}))
    full = {"token_pair_pae": raw["pae"], "contact_probs": np.full((6, 6), 0.9).tolist(), "atom_plddt": [0.5] * 24, "atom_to_token_idx": [i // 4 for i in range(24)]}
    write(root / "e1" / "e1_full_data_sample_0.json", json.dumps(full))
    meta = {"Hchain": "H", "Lchain": "NA", "target_chain_ids": '["X"]'}
    rows = [(e, "POS", ["KFA"], "vhh", ["KFA"], "t", "s", None, str(tmp_path / "crys" / "c1.pdb"), None, meta) for e in ("e1", "e2", "e3")]
    from pairgate.schemas import EXAMPLE

    ex = spark.createDataFrame(rows, EXAMPLE).cache()
    by = lambda df: {r["example_id"]: r for r in df.collect()}
    got = by(scoring.score("structural_interface", ex, predictions_root=str(root)))
    assert got["e3"]["notes"] == {"missing": "prediction"} and "KeyError" in got["e2"]["notes"]["error"] and got["e2"]["value"] is None
    assert got["e1"]["value"] == got["e1"]["extras"]["contacts_per_binder_residue_6a"] > 0
    got = by(scoring.score("af2m_confidence", ex, predictions_root=str(root)))
    assert got["e1"]["value"] == 0.5 and got["e1"]["extras"]["pae_interchain_mean"] == 2.0 and got["e1"]["extras"]["plddt_binder_mean"] == 2.0
    assert got["e2"]["notes"] == {"missing": "scores_json"} and got["e3"]["notes"] == {"missing": "prediction"}
    got = by(scoring.score("protenix_confidence", ex, predictions_root=str(root)))
    assert got["e1"]["value"] == 0.6 and got["e1"]["extras"]["mean_plddt"] == 80.0 and got["e2"]["notes"] == {"missing": "prediction"}
    # No chain sequence file is preferred over rank1.pdb here; every atom maps to a token.
    assert got["e1"]["extras"]["interface_pae"] == 2.0 and got["e1"]["extras"]["interface_plddt"] == pytest.approx(50.0)
    got = by(scoring.score("rmsd_to_crystal", ex, predictions_root=str(root)))
    assert got["e1"]["value"] == pytest.approx(0.0, abs=1e-6) and "dockq_error" in got["e1"]["notes"]
    assert got["e3"]["notes"] == {"missing": "prediction"} and got["e2"]["value"] is None
    pairs = spark.createDataFrame([(e, "KFA", "KFA", "1", "0", "0") for e in ("e1", "e3")], "pair_id string, binder_seq string, antigen_seq string, label string, antigen_cluster string, fold string")
    feats = {r["pair_id"]: r for r in scoring.feature_rows(pairs, str(root)).collect()}
    assert feats["e1"]["prediction_present"] == 1 and feats["e1"]["iptm"] == 0.6 and feats["e1"]["cdr_mapping_ok"] == 0.0
    assert feats["e3"]["prediction_present"] == 0 and feats["e3"]["iptm"] is None and feats["e3"]["cdr_mapping_ok"] is None


def test_quoted_line_breaks_stay_in_one_row(spark, tmp_path):
    from pairgate.sources.tables import read_delimited

    path = tmp_path / "t.csv"
    path.write_text('id,note\n1,"two\nlines"\n2,plain\n3,"a ""quoted"" word"\n')
    rows = read_delimited(spark, str(path)).orderBy("ordinal").collect()
    assert [(r["id"], r["note"], r["ordinal"]) for r in rows] == [("1", "two\nlines", 0), ("2", "plain", 1), ("3", 'a "quoted" word', 2)]


def test_extras_json_is_json(spark):
    import json

    from pairgate.sources.sinks import extras_json

    note = 'tab\t quote" back\\ line\n'
    df = spark.createDataFrame([({"b": 1.5, "a": None}, {"why": note, "none": None})], "e map<string,double>, n map<string,string>")
    text = df.select(extras_json(F.col("e"), F.col("n"))).first()[0]
    assert json.loads(text) == {"a": None, "b": 1.5, "none": None, "why": note}
