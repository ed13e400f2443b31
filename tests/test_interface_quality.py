import numpy as np
import pytest
from helpers import pdb_text

from pairgate import scoring
from pairgate.operators import interface_quality as Q

SCHEMA = "structure_id string, role string, chain_pos int, res_ord int, atom_name string, element string, x double, y double, z double"


def rmsd(p, c, frame_p, frame_c):
    """Deviation of p from c in the best frame of the frame points."""
    a, b = frame_p.mean(0), frame_c.mean(0)
    u, _, vt = np.linalg.svd((frame_p - a).T @ (frame_c - b))
    rot = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    return np.sqrt((((p - a) @ rot + b - c) ** 2).sum(1).mean())


def brute(pred, crys):
    """{(binder chain, target chain): scores} of one structure, by loops."""
    by = lambda rows: {(r[1], r[2], r[3], r[4]): np.array(r[6:]) for r in rows if r[5] != "H"}
    p, c = by(pred), by(crys)

    def contacts(atoms, b, t, cutoff):
        return {
            (k[2], m[2])
            for k, x in atoms.items()
            for m, y in atoms.items()
            if k[:2] == ("binder", b) and m[:2] == ("target", t) and np.linalg.norm(x - y) <= cutoff
        }

    out = {}
    for b in {k[1] for k in c if k[0] == "binder"}:
        for t in {k[1] for k in c if k[0] == "target"}:
            native = contacts(c, b, t, 5.0)
            if not native:
                continue
            model, wide = contacts(p, b, t, 5.0), contacts(c, b, t, 10.0)
            n = {r: len({k[2] for k in c if k[:2] == (r, x)}) for r, x in (("binder", b), ("target", t))}
            receptor = "binder" if n["binder"] > n["target"] else "target"
            back = [k for k in c if k in p and k[3] in ("N", "CA", "C", "O") and k[:2] in (("binder", b), ("target", t))]
            rim = [k for k in back if k[2] in {w[k[0] == "target"] for w in wide}]
            at = lambda d, keys: np.array([d[k] for k in keys])
            rec, lig = [k for k in back if k[0] == receptor], [k for k in back if k[0] != receptor]
            irmsd = rmsd(at(p, rim), at(c, rim), at(p, rim), at(c, rim))
            lrmsd = rmsd(at(p, lig), at(c, lig), at(p, rec), at(c, rec))
            fnat = len(native & model) / len(native)
            q = (fnat + 1 / (1 + (irmsd / 1.5) ** 2) + 1 / (1 + (lrmsd / 8.5) ** 2)) / 3
            out[b, t] = (len(native), fnat, len(model - native) / len(model) if model else 0.0, irmsd, lrmsd, q)
    return out


def complex_of(rng, name):
    rows = []
    for role, chains, shift in (("binder", (5, 9), 0.0), ("target", (8, 8), 7.0)):
        for chain, n in enumerate(chains):
            for res in range(n):
                at = np.array([res * 3.8, chain * 6.0, shift]) + rng.normal(0, 0.7, 3)
                for atom, element in (("N", "N"), ("CA", "C"), ("C", "C"), ("O", "O"), ("CB", "C"), ("HA", "H")):
                    rows.append((name, role, chain, res, atom, element, *map(float, at + rng.normal(0, 1.0, 3))))
    return rows


def moved(rng, rows, noise):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    return [(*r[:6], *map(float, np.array(r[6:]) @ q + [5, -3, 2] + rng.normal(0, noise, 3))) for r in rows]


def test_quality_equals_loops(spark):
    rng = np.random.default_rng(1)
    pred, crys, want = [], [], {}
    for name, noise in (("same", 0.0), ("near", 0.5), ("far", 3.0)):
        p = complex_of(rng, name)
        c = moved(rng, p, noise)
        c = [r for r in c if not (r[1] == "target" and r[2] == 1 and r[3] == 2 and r[4] == "O")]  # a lost atom
        pred, crys = pred + p, crys + c
        want |= {(name, *k): v for k, v in brute(p, c).items()}
    apart = [("apart", r, 0, 0, "CA", "C", 500.0 * (r == "target"), 0.0, 0.0) for r in ("binder", "target")]
    p, c = (spark.createDataFrame(rows + apart, SCHEMA) for rows in (pred, crys))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in Q.interface_quality(p, c).collect()}
    assert set(got) == set(want) and len(want) >= 6
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)
    best = {r.structure_id: r for r in Q.best_quality(p, c).collect()}
    assert best["same"].quality_best == pytest.approx(1, abs=1e-9)
    assert set(best) == {"same", "near", "far"}


def test_cell_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-9, 9, (60, 3)), np.vstack([rng.uniform(-9, 9, (60, 3)), [[3.0, 0, 0], [0, 0, 0], [-3.0, 0, 0]]])
    left = spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(a)], "k string, i int, x double, y double, z double")
    right = spark.createDataFrame([("s", j, *map(float, v)) for j, v in enumerate(b)], "k string, j int, x double, y double, z double")
    got = {(r.i, r.j): r.distance for r in Q.cell_pairs(left, right, 3.0, ["k"]).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert got == pytest.approx({(i, j): d[i, j] for i, j in zip(*np.nonzero(d <= 3.0))})
    assert Q.cell_pairs(left.limit(0), right, 3.0, ["k"]).count() == 0


def test_scorer_gives_the_best_interface(spark, tmp_path):
    from pairgate.schemas import EXAMPLE

    names = ["LYS", "PHE", "ALA"]
    near, far = [(0, 4, 0), (3.8, 4, 0), (7.6, 4, 1)], [(0, 400, 0), (3.8, 400, 0), (7.6, 400, 1)]
    chain = [(0, 0, 0), (3.8, 0, 0), (7.6, 0, 0)]
    for name, target in (("near", near), ("far", far)):
        (tmp_path / "pred" / name).mkdir(parents=True)
        (tmp_path / "pred" / name / "rank1.pdb").write_text(pdb_text([("A", chain, names), ("B", target, names)]))
        (tmp_path / f"{name}.pdb").write_text(pdb_text([("H", chain, names), ("X", target, names)]))
    meta = {"Hchain": "H", "Lchain": "NA", "target_chain_ids": '["X"]'}
    rows = [(n, "POS", ["KFA"], "vhh", ["KFA"], "t", "s", None, str(tmp_path / f"{n}.pdb"), None, meta) for n in ("near", "far")]
    scores = scoring.score("rmsd_to_crystal", spark.createDataFrame(rows, EXAMPLE), predictions_root=str(tmp_path / "pred"), interface_score=True)
    got = {r["example_id"]: r for r in scores.collect()}
    assert got["near"]["extras"]["dockq_best"] == pytest.approx(1, abs=1e-6) and not got["near"]["notes"]
    assert got["far"]["extras"]["dockq_best"] is None and got["far"]["notes"] == {"dockq_error": "no native interface"}


def test_contacts_of_dense_structures_give_one_row_per_block_pair(spark, monkeypatch):
    """Sums and rims equal all pairs, with residues of 1 to 70 atoms, absent ones and several blocks."""
    monkeypatch.setattr(Q, "RESIDUES", 16)
    rng = np.random.default_rng(4)
    rows = {"pred": [], "crys": []}
    for role, n in (("binder", 40), ("target", 33)):
        for res in range(n):
            centre = rng.normal(0, 9, 3) + (30 if res > 30 else 0)
            for atom in range(70 if res == 5 else int(rng.integers(1, 9))):
                for side in rows:
                    if rng.uniform() > 0.2:
                        at = centre + rng.normal(0, 2.0, 3)
                        rows[side].append(("s", role, 0, res, f"X{atom}", "H" if atom == 3 else "C", *map(float, at)))

    def near(side, cutoff):
        b, t = ([r for r in rows[side] if r[1] == role and r[5] != "H"] for role in ("binder", "target"))
        d = np.linalg.norm(np.array([r[6:] for r in b])[:, None] - np.array([r[6:] for r in t])[None], axis=2)
        return {(b[i][3], t[j][3]) for i, j in zip(*np.nonzero(d <= cutoff))}

    p, c = (spark.createDataFrame(rows[s], SCHEMA) for s in ("pred", "crys"))
    met = Q._block_pairs(Q._blocks(p, c)).mapInPandas(Q._meet, Q._MET).collect()
    native, model, wide = near("crys", 5.0), near("pred", 5.0), near("crys", 10.0)
    assert 1 < len(met) <= 3 * 3 and len(native & model) > 20 and len(native) < len(wide)
    assert [sum(r[n] for r in met) for n in ("n_native", "n_model", "n_both")] == [len(native), len(model), len(native & model)]
    for k, rim in enumerate(("binder_rim", "target_rim")):
        assert {i for r in met for i in r[rim]} == {pair[k] for pair in wide}
