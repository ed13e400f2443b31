import math

import numpy as np
import pytest
from helpers import cif_text, pdb_line, pdb_text
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.operators import chain_roles, confidence, geometry, superpose
from pairgate.sources import structure_files as S


def files(spark, *items):
    return spark.createDataFrame(list(items), "structure_id string, path string, text string")


def roles(spark, rows):
    return spark.createDataFrame(rows, "id string, binder_ids array<string>, target_ids array<string>")


def test_mini_pdb(spark):
    names = ["GLN", "VAL", "GLN", "LEU", "GLU", "SER", "GLY", "GLY", "GLY", "LEU"]
    lines = [pdb_line(1, "N", "GLN", "H", 1, 0, 0, 0, "N")]
    lines += [pdb_line(2 + i, "CA", n, "H", i + 1, i, 0, 0, "C") for i, n in enumerate(names)]
    lines += [pdb_line(50, "CA", "LEU", "H", 10, 9, 1, 0, "C", altloc="B", occ=0.4)]  # same position
    lines += [pdb_line(51, "CA", "MSE", "H", 11, 9, 1, 0, "C")]  # not standard: skipped
    lines += [pdb_line(60 + i, "CA", "ALA", "A", i + 1, i, 5, 0, "C") for i in range(32)]
    lines += [pdb_line(99, "O", "HOH", "A", 99, 1, 1, 1, "O", record="HETATM")]
    lines += ["ENDMDL", pdb_line(1, "CA", "TRP", "H", 12, 0, 0, 0, "C"), "ENDMDL"]
    f = files(spark, ("s", "s.pdb", "\n".join(lines)))
    got = {r["chain_id"]: r["sequence"] for r in S.ca_sequences(f).collect()}
    assert got == {"H": "QVQLESGGGL", "A": "A" * 32}
    atoms = S.atoms_from_files(f)
    assert atoms.where("chain_id = 'H'").count() == 12 and atoms.where("resname = 'HOH'").count() == 0
    alt = atoms.where("chain_id = 'H' and resseq = 10").first()
    assert alt["y"] == 0.0 and alt["res_ord"] == 9
    seqs = {r["chain_id"]: (r["chain_ord"], r["sequence"]) for r in S.chain_sequences(atoms).collect()}
    assert seqs["H"] == (0, "QVQLESGGGLX") and seqs["A"][0] == 1


def test_cif_equals_pdb(spark):
    chains = [("B", [(0, 0, 0), (4, 0, 0)], ["LYS", "PHE"]), ("A", [(0, 3, 0)], ["ASP"])]
    both = S.atoms_from_files(files(spark, ("p", "p.pdb", pdb_text(chains)), ("c", "c.cif", cif_text(chains))))
    cols = [c for c in both.columns if c != "structure_id"]
    p = both.where("structure_id = 'p'").select(*cols)
    c = both.where("structure_id = 'c'").select(*cols)
    assert p.count() == 12 and p.exceptAll(c).count() == 0 and c.exceptAll(p).count() == 0


def test_two_by_two_complex(spark):
    text = pdb_text(
        [("A", [(0, 0, 0), (10, 0, 0)], ["LYS", "PHE"]), ("B", [(0, 3, 0), (30, 0, 0)], ["ASP", "TYR"])],
        (("N", -1.0, 0.0, 0.0), ("CA", 0.0, 0.0, 0.0), ("C", 1.0, 0.0, 0.0)),
    )
    atoms = S.atoms_from_files(files(spark, ("x", "x.pdb", text)))
    placed = chain_roles.assign(atoms, roles(spark, [("x", ["A"], ["B"])]))
    r = geometry.interface_features(placed.cache()).first()
    for c in (4, 6, 8):
        assert r[f"residue_pair_contacts_{c}a"] == 1.0
    assert r["contacts_per_binder_residue_6a"] == 0.5 and r["residue_pair_contact_fraction_6a"] == 0.25
    assert r["opposite_charge_contact_pairs_6a"] == 1.0 and r["same_charge_contact_pairs_6a"] == 0.0
    assert r["mean_interface_residue_distance_8a"] == pytest.approx(3.0)
    assert r["atom_clashes_2a"] == 0.0 and r["shape_complementarity_proxy"] == 0.5
    assert r["median_interface_residue_distance_8a"] == pytest.approx(3.0)
    assert r["atom_packing_pairs_0_1a_gap"] > 0


def brute(b, t):
    """Interface features from the definitions, on (res, resname, element, xyz) rows."""
    rad = lambda rows: np.array([C.VDW_RADII.get(r[2], 1.7) for r in rows])
    xyz = lambda rows: np.array([r[3] for r in rows])
    B, T, rb, rt = xyz(b), xyz(t), rad(b), rad(t)
    dist = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    d = dist(B, T)
    nb, nt = max(r[0] for r in b) + 1, max(r[0] for r in t) + 1
    res = np.full((nb, nt), np.inf)
    for i, x in enumerate(b):
        for j, y in enumerate(t):
            res[x[0], y[0]] = min(res[x[0], y[0]], d[i, j])

    def occ(p, rp, q, rq, same):
        dd = dist(p, q)
        if same:
            np.fill_diagonal(dd, np.inf)
        sp, sq = rp + 1.4, rq + 1.4
        return np.clip((sp[:, None] + sq[None] - dd) / sp[:, None], 0, None).sum(1)

    def buried(p, rp, q, rq):
        s, o = occ(p, rp, p, rp, True), occ(p, rp, q, rq, False)
        loss = np.clip(np.exp(-0.35 * s) - np.exp(-0.35 * (s + o)), 0, 1)
        return (loss * 4 * math.pi * (rp + 1.4) ** 2).sum(), loss.mean()

    gap = d - rb[:, None] - rt[None]
    packed = (gap >= 0) & (gap <= 1)
    near = res[res <= 8]
    out = {
        "mean_interchain_heavy_atom_distance": d.mean(),
        "min_interchain_heavy_atom_distance": d.min(),
        "atom_contacts_5a": (d <= 5).sum(),
        "atom_close_contacts_3a": (d <= 3).sum(),
        "atom_clashes_2a": (d <= 2).sum(),
        "residue_pair_contacts_6a": (res <= 6).sum(),
        "n_interface_residues_binder": (res <= 8).any(1).sum(),
        "n_interface_residues_target": (res <= 8).any(0).sum(),
        "mean_interface_residue_distance_8a": near.mean(),
        "median_interface_residue_distance_8a": np.median(near),
        "std_interface_residue_distance_8a": near.std(),
        "buried_sasa_proxy_binder_a2": buried(B, rb, T, rt)[0],
        "mean_target_atom_exposure_loss": buried(T, rt, B, rb)[1],
        "atom_packing_pairs_0_1a_gap": packed.sum(),
        "binder_atom_packing_coverage_0_1a_gap": packed.any(1).mean(),
        "target_atom_packing_coverage_0_1a_gap": packed.any(0).mean(),
        "mean_abs_nearest_surface_gap": np.concatenate([np.abs(gap).min(1), np.abs(gap).min(0)]).mean(),
    }
    names_b, names_t = {r[0]: r[1] for r in b}, {r[0]: r[1] for r in t}
    out["hydrophobic_contact_pairs_6a"] = sum(
        res[i, j] <= 6 and names_b[i] in C.HYDROPHOBIC_RESIDUES and names_t[j] in C.HYDROPHOBIC_RESIDUES
        for i in range(nb) for j in range(nt)
    )
    return out


def test_geometry_against_brute_force(spark):
    rng = np.random.default_rng(1)
    names = list(C.THREE_TO_ONE)
    rows, truth = [], {}
    for sid, (nb, nt) in {"small": (40, 50), "large": (400, 330)}.items():
        sides = []
        for role, n, at in (("binder", nb, 0.0), ("target", nt, 6.0)):
            part = []
            for k in range(n):
                res = k // 5
                xyz = rng.normal(size=3) * 7 + [at, 0, 0]
                element = str(rng.choice(["C", "N", "O", "S", "F"]))
                part.append((res, names[(res * 7 + n) % 20], element, xyz))
                rows.append((sid, role, res, part[-1][1], element, k, *map(float, xyz)))
            rows.append((sid, role, 0, part[0][1], "H", n, 0.0, 0.0, 0.0))  # hydrogens are ignored
            sides.append(part)
        truth[sid] = brute(*sides)
    atoms = spark.createDataFrame(
        rows, "structure_id string, role string, role_res int, resname string, element string, atom_ord int, x double, y double, z double"
    )
    got = {r["structure_id"]: r for r in geometry.interface_features(atoms).collect()}
    for sid, want in truth.items():
        for name, value in want.items():
            assert got[sid][name] == pytest.approx(float(value), rel=1e-9), (sid, name)
    near = geometry.interface_residues(atoms).groupBy("structure_id").count().collect()
    assert {r[0]: r[1] for r in near} == {s: t["n_interface_residues_binder"] for s, t in truth.items()}


def test_one_sided_structure(spark):
    rows = [("s", "binder", 0, "ALA", "C", 0, 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(
        rows, "structure_id string, role string, role_res int, resname string, element string, atom_ord int, x double, y double, z double"
    )
    r = geometry.interface_features(atoms).first()
    assert r["residue_pair_contacts_6a"] == 0.0 and r["contacts_per_target_residue_6a"] is None
    assert r["buried_sasa_proxy_a2"] is None and r["atom_contact_fraction_5a"] is None


def test_roles_by_sequence(spark):
    seqs = spark.createDataFrame(
        [("e", "A", 0, "AAAACCCC"), ("e", "B", 1, "GGGGTTTT"), ("e", "C", 2, "GGGGTTTA")],
        "structure_id string, chain_id string, chain_ord int, sequence string",
    )
    ex = spark.createDataFrame([("e", ["GGGGTTTA"], ["AAAACCCC", "GGGG", "XXXX"])], "id string, binder_chains array<string>, target_chains array<string>")
    r = chain_roles.roles_by_sequence(ex, seqs).first()
    assert r["binder_ids"] == ["C"] and r["target_ids"] == ["A", "B"]
    p = chain_roles.positional_roles(ex).first()
    assert p["binder_ids"] == ["A"] and p["target_ids"] == ["B", "C", "D"]
    side = spark.createDataFrame([("e", ["Z"], ["Y"])], "id string, binder array<string>, target array<string>")
    r = chain_roles.with_sidecar(chain_roles.positional_roles(ex), side).first()
    assert r["binder_ids"] == ["Z"] and r["target_ids"] == ["Y"]


def test_crystal_roles(spark):
    ex = spark.createDataFrame(
        [
            ("f", "fab", {"Hchain": "H ", "Lchain": "L", "antigen_chain": "A | B"}),
            ("v", "vhh", {"Hchain": "H", "Lchain": "L", "antigen_chain": "A|B", "target_chain_ids": '["B"]'}),
            ("n", "vhh", {"Hchain": "NA"}),
        ],
        "id string, binder_format string, metadata map<string,string>",
    )
    got = {r["id"]: (r["binder_ids"], r["target_ids"]) for r in chain_roles.crystal_roles(ex).collect()}
    assert got == {"f": (["H", "L"], ["A", "B"]), "v": (["H"], ["B"]), "n": ([], [])}


def test_rmsd(spark):
    rng = np.random.default_rng(5)
    target = rng.normal(size=(12, 3)) * 8
    binder = rng.normal(size=(8, 3)) * 8 + [3, 0, 0]
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    place = lambda x: x @ q + [5.0, -3.0, 2.0]
    name = ["ALA"] * 12
    crystal = [("H", binder, name), ("A", target, name)]
    moved = [("A", place(binder + [0, 0, 2.0]), name), ("B", place(target), name)]
    one = (("CA", 0.0, 0.0, 0.0),)
    short = [("A", binder[:7], name), ("B", target, name)]
    f = files(
        spark,
        ("c1", "c1.pdb", pdb_text(crystal, one)),
        ("p1", "p1.pdb", pdb_text(moved, one)),
        ("p2", "p2.pdb", pdb_text(short, one)),
    )
    atoms = S.atoms_from_files(f).cache()

    def side(sid, example, b, t):
        a = atoms.where(F.col("structure_id") == sid).withColumn("structure_id", F.lit(example))
        return chain_roles.assign(a, roles(spark, [(example, [b], [t])]))

    pred = side("p1", "e1", "A", "B").unionByName(side("p2", "e2", "A", "B"))
    crys = side("c1", "e1", "H", "A").unionByName(side("c1", "e2", "H", "A"))
    got = {r["structure_id"]: r for r in superpose.rmsd_features(pred, crys).collect()}
    e1 = got["e1"]
    assert e1["error"] is None and e1["target_ca_rmsd"] == pytest.approx(0, abs=2e-3)
    for c in ("binder_ca", "binder_backbone", "binder_all_atom", "interface_ca"):
        assert e1[f"{c}_rmsd_target_aligned"] == pytest.approx(2.0, abs=3e-3), c
    assert (e1["n_target_ca"], e1["n_binder_ca"]) == (12.0, 8.0) and e1["n_interface_residues"] >= 1
    assert got["e2"]["error"] == "binder_residue_count_mismatch" and got["e2"]["target_ca_rmsd"] is None


def test_multimer_confidence(spark):
    n = 18
    plddt = [50.0 + i for i in range(n)]
    pae = np.full((n, n), 5.0)
    pae[8:, 8:], pae[:8, 8:], pae[8:, :8] = 7.0, 12.0, 12.0
    rows = [
        ("ok", 0.55, 0.7, plddt, pae.tolist(), 12.0, 8, 10, [0, 7]),
        ("none", 0.55, 0.0, plddt, pae.tolist(), 12.0, 8, 10, None),
        ("len", 0.5, 0.5, plddt, pae.tolist(), 1.0, 8, 9, None),
        ("shape", 0.5, 0.5, plddt, pae[:5].tolist(), 1.0, 8, 10, None),
    ]
    df = spark.createDataFrame(rows, "id string, iptm double, ptm double, plddt array<double>, pae array<array<double>>, max_pae double, n_binder int, n_target int, interface array<int>")
    got = {r["id"]: r for r in confidence.multimer_confidence(df).collect()}
    ok = got["ok"]
    assert ok["ranking_confidence"] == pytest.approx(0.58) and ok["iptm_over_ptm"] == pytest.approx(0.55 / 0.7)
    assert (ok["plddt_full_mean"], ok["plddt_binder_mean"], ok["plddt_target_mean"]) == (58.5, 53.5, 62.5)
    assert ok["plddt_interface_mean"] == 53.5 and ok["pae_interface_mean"] == 12.0
    assert (ok["pae_interchain_mean"], ok["pae_interchain_max"]) == (12.0, 12.0)
    assert got["none"]["pae_interface_mean"] is None and got["none"]["iptm_over_ptm"] is None
    assert got["len"]["error"].startswith("plddt_length_mismatch") and got["len"]["iptm"] is None
    assert got["shape"]["error"].startswith("pae_shape_mismatch")
    name = spark.range(1).select(confidence.rank1_score_file(F.lit("x_unrelaxed_rank_001_a.pdb"))).first()[0]
    assert name == "x_scores_rank_001_a.json"


def test_token_interface(spark):
    pae = [[0.0, 2.0, 4.0, 6.0], [10.0, 999.0, 999.0, 999.0], [20.0, 999.0, 999.0, 999.0], [30.0, 999.0, 999.0, 999.0]]
    df = spark.createDataFrame(
        [("a", pae, [True, False, False, False]), ("b", pae, [True] * 4)],
        "id string, token_pair_pae array<array<double>>, mask array<boolean>",
    )
    got = {r["id"]: r for r in confidence.interface_pae(df).collect()}
    assert got["a"]["interface_pae"] == 12.0 and got["a"]["min_interface_pae"] == 2.0
    assert got["b"]["interface_pae"] is None and got["b"]["min_interface_pae"] is None
    cp = [[1.0, 0.9, 0.8, 0.1], [0.9, 1.0, 0.3, 0.2], [0.8, 0.3, 1.0, 0.9], [0.1, 0.2, 0.9, 1.0]]
    df = spark.createDataFrame(
        [("a", cp, [0.8, 0.8, 0.6, 0.6, 0.9, 0.7], [0, 0, 1, 1, 2, 3], [True, True, False, False]),
         ("b", cp, [0.8, 0.8, 0.6, 0.6, 0.9, 0.7], [0, 0, 1, 1, 2, 3], [True] * 4)],
        "id string, contact_probs array<array<double>>, atom_plddt array<double>, atom_to_token_idx array<int>, mask array<boolean>",
    )
    got = {r["id"]: r["interface_plddt"] for r in confidence.interface_plddt(df).collect()}
    assert got == {"a": pytest.approx(85.0)}


def test_binder_token_mask(spark):
    df = spark.createDataFrame(
        [("ok", 3, [0, 0, 1, 2], [True, False, False, True]), ("len", 3, [0, 1], [True]), ("range", 2, [0, 2], [True, False])],
        "id string, n_tokens int, atom_to_token_idx array<int>, atom_is_binder array<boolean>",
    )
    got = {r["id"]: r["mask"] for r in confidence.binder_token_mask(df).collect()}
    assert got == {"ok": [True, False, True], "len": None, "range": None}


def test_loop_engagement(spark):
    iface = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("z", 0)], "id string, residue_idx int")
    numbering = spark.createDataFrame([("a", 0, 27), ("a", 1, 60), ("a", 2, 45), ("a", 9, 110)], "id string, residue_idx int, imgt_pos int")
    got = {r["id"]: r for r in confidence.loop_engagement(iface, numbering).collect()}
    assert set(got) == {"a"} and got["a"]["cdr_contact_fraction"] == 0.5
    assert (got["a"]["cdr1_contact_fraction"], got["a"]["cdr3_contact_fraction"]) == (0.25, 0.0)


def test_residue_pairs_are_settled_in_one_pair_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for role in ("binder", "target"):
        for k in range(60):
            rows.append(("s", role, int(rng.integers(12)), "LYS", "C", k, *map(float, rng.normal(0, 5, 3))))
    atoms = spark.createDataFrame(rows, "structure_id string, role string, role_res int, resname string, element string, atom_ord int, x double, y double, z double").cache()
    whole = sorted(map(tuple, geometry.residue_contacts(atoms).collect()))
    middle = np.median([r[3] for r in whole])
    features = geometry.interface_features(atoms).first().asDict()
    for block in (16, 2):  # whole residues, and residues cut over blocks
        monkeypatch.setattr(geometry, "BLOCK", block)
        if block == 16:
            near = geometry.near_residues(atoms).select("i", "j")
            assert near.count() > 1
            pairs = [p for r in near.collect() for p in zip(r["i"], r["j"])]
            assert len(pairs) == len(set(pairs)) == len(whole) > 60
        assert sorted(map(tuple, geometry.residue_contacts(atoms).collect())) == whole
        assert geometry.interface_features(atoms).first().asDict() == pytest.approx(features, nan_ok=True)
    assert features["median_interface_residue_distance_8a"] == middle
