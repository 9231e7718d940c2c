"""Small structures for tests: rows, and the same rows rendered in both file formats."""

from __future__ import annotations

import math

import numpy as np

# (record, name, alt, residue, chain, seq, x, y, z, occupancy, b, symbol)
FRAGMENT = [
    ("ATOM", "N", "THR", "A", 1, 17.047, 14.099, 3.625, 13.79, "N"),
    ("ATOM", "CA", "THR", "A", 1, 16.967, 12.784, 4.338, 10.80, "C"),
    ("ATOM", "C", "THR", "A", 1, 15.685, 12.755, 5.133, 9.19, "C"),
    ("ATOM", "O", "THR", "A", 1, 15.268, 13.825, 5.594, 9.85, "O"),
    ("ATOM", "CB", "THR", "A", 1, 18.170, 12.703, 5.337, 13.02, "C"),
    ("ATOM", "OG1", "THR", "A", 1, 19.334, 12.829, 4.463, 15.06, "O"),
    ("ATOM", "CG2", "THR", "A", 1, 18.150, 11.546, 6.304, 14.23, "C"),
    ("ATOM", "N", "THR", "A", 2, 15.115, 11.555, 5.265, 7.81, "N"),
    ("ATOM", "CA", "THR", "A", 2, 13.856, 11.469, 6.066, 8.31, "C"),
    ("HETATM", "ZN", "ZN", "B", 100, 30.0, 30.0, 30.0, 20.0, "ZN"),
    ("HETATM", "O", "HOH", "B", 200, 40.0, 40.0, 40.0, 30.0, "O"),
]


def pdb_line(serial: int, row: tuple) -> str:
    record, name, residue, chain, seq, x, y, z, b, symbol = row
    padded = name.ljust(4) if len(symbol) == 2 else (" " + name).ljust(4)
    return (f"{record:<6}{serial:5d} {padded} {residue:>3} {chain}{seq:4d}    "
            f"{x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{b:6.2f}          {symbol:>2}")


def pdb_text() -> str:
    lines = [f"HEADER    {'PLANT PROTEIN':<40}{'30-APR-81':<9}   1CRN", "TITLE     WATER STRUCTURE OF", "TITLE    2 CRAMBIN",
             "EXPDTA    X-RAY DIFFRACTION", "REMARK   2 RESOLUTION.    1.50 ANGSTROMS.",
             "HELIX    1   1 ILE A    7  PRO A   19  1", "SHEET    1   A 2 THR A   1  CYS A   4"]
    for i, row in enumerate(FRAGMENT):
        if i == 9:
            lines.append("TER      10      THR A   2")
        lines.append(pdb_line(i + 1, row))
    return "\r\n".join([*lines, "END"])


def cif_text() -> str:
    items = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id",
             "auth_seq_id", "auth_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "pdbx_PDB_model_num"]
    out = ["data_1CRN", "# a comment", "_entry.id 1CRN", "_struct.title 'WATER STRUCTURE OF CRAMBIN'",
           "loop_", "_other.a", "_other.b", "1 2 3 4", "loop_", *[f"_atom_site.{i}" for i in items]]
    for i, (record, name, residue, chain, seq, x, y, z, b, symbol) in enumerate(FRAGMENT):
        out.append(f"{record} {i + 1} {symbol} {name} . {residue} Z {seq} {chain} {x} {y} {z} 1.00 {b} 1")
    out += ["ATOM 99 C", "#", "loop_", "_struct_conf.conf_type_id", "_struct_conf.beg_auth_asym_id",
            "_struct_conf.beg_auth_seq_id", "_struct_conf.end_auth_seq_id", "HELX_P A 7 19", "#"]
    return "\n".join(out)


# structure for selections: (name, residue, chain, seq, hetatm, element, b)
SELECTION = [
    ("N", "ALA", "A", 1, False, 7, 10.0), ("CA", "ALA", "A", 1, False, 6, 20.0), ("C", "ALA", "A", 1, False, 6, 30.0),
    ("O", "ALA", "A", 1, False, 8, 40.0), ("CB", "ALA", "A", 1, False, 6, 50.0),
    ("N", "GLY", "A", 2, False, 7, 60.0), ("CA", "GLY", "A", 2, False, 6, 70.0),
    ("N", "VAL", "B", 10, False, 7, 80.0), ("CA", "VAL", "B", 10, False, 6, 90.0),
    ("ZN", "ZN", "C", 100, True, 30, 15.0), ("O", "HOH", "D", 200, True, 8, 25.0),
]

# backbone geometry of a peptide (Å, degrees)
LENGTHS = {"N-CA": 1.458, "CA-C": 1.525, "C-N": 1.329, "C-O": 1.231}
ANGLES = {"N-CA-C": 111.2, "CA-C-N": 116.2, "C-N-CA": 121.7, "CA-C-O": 120.8}


def place(a, b, c, length: float, angle: float, torsion: float) -> np.ndarray:
    """Fourth point from three, with bond length, bond angle and torsion."""
    angle, torsion = math.radians(angle), math.radians(torsion)
    bc = (c - b) / np.linalg.norm(c - b)
    normal = np.cross(b - a, bc)
    normal /= np.linalg.norm(normal)
    local = np.array([-length * math.cos(angle), length * math.cos(torsion) * math.sin(angle),
                      length * math.sin(torsion) * math.sin(angle)])
    return c + np.column_stack([bc, np.cross(normal, bc), normal]) @ local


def peptide(residues: int, phi: float, psi: float, names: dict[int, str] | None = None) -> list[tuple]:
    """Backbone rows (structure_id, atom_idx, residue_idx, chain_idx, name, res_name, x, y, z)."""
    n = np.zeros(3)
    ca = np.array([LENGTHS["N-CA"], 0.0, 0.0])
    turn = math.radians(180 - ANGLES["N-CA-C"])
    c = ca + LENGTHS["CA-C"] * np.array([math.cos(turn), math.sin(turn), 0.0])
    rows, atom = [], 0
    for i in range(residues):
        next_n = place(n, ca, c, LENGTHS["C-N"], ANGLES["CA-C-N"], psi)
        o = place(n, ca, c, LENGTHS["C-O"], ANGLES["CA-C-O"], psi + 180)
        for name, point in (("N", n), ("CA", ca), ("C", c), ("O", o)):
            rows.append((1, atom, i, 0, name, (names or {}).get(i, "ALA"), *map(float, point)))
            atom += 1
        next_ca = place(ca, c, next_n, LENGTHS["N-CA"], ANGLES["C-N-CA"], 180.0)
        next_c = place(c, next_n, next_ca, LENGTHS["CA-C"], ANGLES["N-CA-C"], phi)
        n, ca, c = next_n, next_ca, next_c
    return rows


PEPTIDE_SCHEMA = ("structure_id bigint, atom_idx int, residue_idx int, chain_idx int, name string, res_name string, "
                  "x double, y double, z double")
