"""Small builders of structure text for the tests."""

from __future__ import annotations


def pdb_line(serial, name, resname, chain, resseq, x, y, z, element, record="ATOM", altloc=" ", occ=1.0, icode=" "):
    padded = f" {name:<3}" if len(name) < 4 else name
    return (
        f"{record:<6}{serial:>5} {padded}{altloc}{resname:>3} {chain}{resseq:>4}{icode}   "
        f"{x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{0:6.2f}          {element:>2}"
    )


def pdb_text(chains, offsets=(("N", -1.0, 0.5, 0.0), ("CA", 0.0, 0.0, 0.0), ("C", 1.0, 0.5, 0.0), ("O", 1.5, 0.5, 0.0))):
    """chains: [(chain_id, [(x, y, z) of CA], [resnames])]."""
    lines, serial = [], 1
    for chain, positions, names in chains:
        for i, ((x, y, z), resname) in enumerate(zip(positions, names), start=1):
            for atom, dx, dy, dz in offsets:
                lines.append(pdb_line(serial, atom, resname, chain, i, x + dx, y + dy, z + dz, atom[0]))
                serial += 1
    return "\n".join([*lines, "TER", "END", ""])


def cif_text(chains, offsets=(("N", -1.0, 0.5, 0.0), ("CA", 0.0, 0.0, 0.0), ("C", 1.0, 0.5, 0.0), ("O", 1.5, 0.5, 0.0))):
    names = (
        "group_PDB type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id "
        "auth_seq_id auth_asym_id pdbx_PDB_ins_code occupancy Cartn_x Cartn_y Cartn_z pdbx_PDB_model_num"
    ).split()
    rows = []
    for model in (1, 2):
        for chain, positions, resnames in chains:
            for i, ((x, y, z), resname) in enumerate(zip(positions, resnames), start=1):
                for atom, dx, dy, dz in offsets:
                    rows.append(
                        f"ATOM {atom[0]} '{atom}' . {resname} {chain} {i} {i} {chain} ? 1.0 "
                        f"{x + dx:.3f} {y + dy:.3f} {z + dz:.3f} {model}"
                    )
    head = "\n".join(f"_atom_site.{n}" for n in names)
    return f"data_x\n#\nloop_\n_entity.id\n1\n#\nloop_\n{head}\n" + "\n".join(rows) + "\n#\nloop_\n_other.a\n1\n"
