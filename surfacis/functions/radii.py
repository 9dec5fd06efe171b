"""Built-in radii and classes of atoms by residue, as rows of a classifier table."""

from __future__ import annotations

# Radius and class of the atom types of NACCESS.
NACCESS_TYPES = {
    "C_ALI": (1.87, "apolar"), "C_CAR": (1.76, "apolar"), "C_NUC": (1.80, "apolar"), "N_AMN": (1.50, "polar"), "N_AMD": (1.65, "polar"), "N_NUC": (1.60, "polar"), "O": (1.40, "polar"),
    "S": (1.85, "apolar"), "SE": (1.80, "apolar"), "P": (1.90, "apolar"),
}
# Types of atoms of any residue.
NACCESS_ANY = {
    "C": "C_CAR", "O": "O", "CA": "C_ALI", "N": "N_AMD", "CB": "C_ALI", "OXT": "O", "P": "P", "OP1": "O", "OP2": "O", "OP3": "O", "O5'": "O", "O4'": "O", "O3'": "O", "O2'": "O",
    "C5'": "C_NUC", "C4'": "C_NUC", "C3'": "C_NUC", "C2'": "C_NUC", "C1'": "C_NUC",
}
# Types of atoms of side chains.
NACCESS_RESIDUES = {
    "ALA": {"CB": "C_ALI"},
    "ARG": {"CG": "C_ALI", "CD": "C_ALI", "NE": "N_AMD", "CZ": "C_CAR", "NH1": "N_AMD", "NH2": "N_AMD"},
    "ASN": {"CG": "C_CAR", "OD1": "O", "ND2": "N_AMD"},
    "ASP": {"CG": "C_CAR", "OD1": "O", "OD2": "O"},
    "CYS": {"SG": "S"},
    "GLN": {"CG": "C_ALI", "CD": "C_CAR", "OE1": "O", "NE2": "N_AMD"},
    "GLU": {"CG": "C_ALI", "CD": "C_CAR", "OE1": "O", "OE2": "O"},
    "GLY": {"CA": "C_ALI"},
    "HIS": {"CG": "C_CAR", "ND1": "N_AMD", "CD2": "C_CAR", "NE2": "N_AMD", "CE1": "C_CAR"},
    "ILE": {"CG1": "C_ALI", "CG2": "C_ALI", "CD1": "C_ALI"},
    "LEU": {"CG": "C_ALI", "CD1": "C_ALI", "CD2": "C_ALI"},
    "LYS": {"CG": "C_ALI", "CD": "C_ALI", "CE": "C_ALI", "NZ": "N_AMN"},
    "MET": {"CG": "C_ALI", "SD": "S", "CE": "C_ALI"},
    "PHE": {"CG": "C_CAR", "CD1": "C_CAR", "CD2": "C_CAR", "CE1": "C_CAR", "CE2": "C_CAR", "CZ": "C_CAR"},
    "PRO": {"CG": "C_ALI", "CD": "C_ALI"},
    "SEC": {"CB": "C_ALI", "SE": "SE"},
    "MSE": {"CG": "C_ALI", "SE": "SE", "CE": "C_ALI"},
    "SER": {"OG": "O"},
    "THR": {"OG1": "O", "CG2": "C_ALI"},
    "TRP": {"CG": "C_CAR", "CD1": "C_CAR", "CD2": "C_CAR", "NE1": "N_AMD", "CE2": "C_CAR", "CE3": "C_CAR", "CZ2": "C_CAR", "CZ3": "C_CAR", "CH2": "C_CAR"},
    "TYR": {"CG": "C_CAR", "CD1": "C_CAR", "CD2": "C_CAR", "CE1": "C_CAR", "CE2": "C_CAR", "CZ": "C_CAR", "OH": "O"},
    "VAL": {"CG1": "C_ALI", "CG2": "C_ALI"},
}
# Atoms of the bases of nucleotides. Those of DNA are the same under a name that begins with D.
BASES = {
    "A": "N9 C8 N7 C5 C6 N6 N1 C2 N3 C4", "C": "N1 C2 O2 N3 C4 N4 C5 C6", "G": "N9 C8 N7 C5 C6 O6 N1 C2 N2 N3 C4", "I": "N9 C8 N7 C5 C6 O6 N1 C2 N3 C4", "T": "N1 C2 O2 N3 C4 O4 C5 C7 C6", "U": "N1 C2 O2 N3 C4 O4 C5 C6",
}
# Types of atoms of bases by their first letter.
BASE_TYPES = {"N": "N_NUC", "C": "C_NUC", "O": "O"}

# Radius and class of the atom types of OONS.
OONS_TYPES = {
    "C_ALI": (2.00, "apolar"), "C_ARO": (1.75, "apolar"), "C_CAR": (1.55, "polar"), "N": (1.55, "polar"), "O": (1.40, "polar"), "S": (2.00, "polar"), "P": (1.80, "polar"), "SE": (1.90, "polar"),
    "U_POL": (1.50, "polar"), "WATER": (1.40, "polar"),
}
# Types of atoms of any residue.
OONS_ANY = {
    "C": "C_CAR", "O": "O", "CA": "C_ALI", "N": "N", "CB": "C_ALI", "OXT": "O", "P": "P", "OP1": "O", "OP2": "O", "OP3": "O", "O5'": "O", "C5'": "C_ALI", "C4'": "C_ARO", "O4'": "O", "C3'": "C_ARO", "O3'": "O",
    "C2'": "C_ARO", "O2'": "O", "C1'": "C_ARO", "N1": "N", "N2": "N", "N3": "N", "N4": "N", "N6": "N", "N7": "N", "N9": "N", "C2": "C_ARO", "C4": "C_ARO", "C5": "C_ARO", "C6": "C_ARO", "C7": "C_ARO", "C8": "C_ARO",
    "O2": "O", "O4": "O", "O6": "O", "CM2": "C_ALI",
}
# Types of atoms of side chains, caps and water.
OONS_RESIDUES = {
    "ARG": {"CG": "C_ALI", "CD": "C_ALI", "NE": "N", "CZ": "C_ALI", "NH1": "N", "NH2": "N"},
    "ASN": {"CG": "C_CAR", "OD1": "O", "ND2": "N"},
    "ASP": {"CG": "C_CAR", "OD1": "O", "OD2": "O"},
    "CYS": {"SG": "S"},
    "GLN": {"CG": "C_ALI", "CD": "C_CAR", "OE1": "O", "NE2": "N"},
    "GLU": {"CG": "C_ALI", "CD": "C_CAR", "OE1": "O", "OE2": "O"},
    "HIS": {"CG": "C_ARO", "ND1": "N", "CD2": "C_ARO", "NE2": "N", "CE1": "C_ARO"},
    "ILE": {"CG1": "C_ALI", "CG2": "C_ALI", "CD1": "C_ALI"},
    "LEU": {"CG": "C_ALI", "CD1": "C_ALI", "CD2": "C_ALI"},
    "LYS": {"CG": "C_ALI", "CD": "C_ALI", "CE": "C_ALI", "NZ": "N"},
    "MET": {"CG": "C_ALI", "SD": "S", "CE": "C_ALI"},
    "PHE": {"CG": "C_ARO", "CD1": "C_ARO", "CD2": "C_ARO", "CE1": "C_ARO", "CE2": "C_ARO", "CZ": "C_ARO"},
    "PRO": {"CB": "C_ARO", "CG": "C_ARO", "CD": "C_ARO"},
    "SER": {"OG": "O"},
    "THR": {"OG1": "O", "CG2": "C_ALI"},
    "TRP": {"CG": "C_ARO", "CD1": "C_ARO", "CD2": "C_ARO", "NE1": "N", "CE2": "C_ARO", "CE3": "C_ARO", "CZ2": "C_ARO", "CZ3": "C_ARO", "CH2": "C_ARO"},
    "TYR": {"CG": "C_ARO", "CD1": "C_ARO", "CD2": "C_ARO", "CE1": "C_ARO", "CE2": "C_ARO", "CZ": "C_ARO", "OH": "O"},
    "VAL": {"CG1": "C_ALI", "CG2": "C_ALI"},
    "ASX": {"CG": "C_CAR", "XD1": "U_POL", "XD2": "U_POL", "AD1": "U_POL", "AD2": "U_POL"},
    "GLX": {"CG": "C_ALI", "CD": "C_CAR", "XE1": "U_POL", "XE2": "U_POL", "AE1": "U_POL", "AE2": "U_POL"},
    "SEC": {"SE": "SE"},
    "CSE": {"SE": "SE"},
    "MSE": {"SE": "SE", "CG": "C_ALI", "CE": "C_ALI"},
    "PYL": {"CG": "C_ALI", "CD": "C_ALI", "CE": "C_ALI", "NZ": "N", "O2": "O", "C2": "C_CAR", "CA2": "C_ARO", "CB2": "C_ALI", "CG2": "C_ARO", "CD2": "C_ARO", "CE2": "C_ARO", "N2": "N"},
    "ACE": {"CH3": "C_ALI"},
    "NH2": {"NH2": "N"},
    "HOH": {"O": "WATER"},
}


def _rows(types: dict, residues: dict) -> list[tuple[str, str, float, str]]:
    return [(residue, atom, *types[kind]) for residue, atoms in residues.items() for atom, kind in atoms.items()]


def naccess_rows() -> list[tuple[str, str, float, str]]:
    """Rows (residue, atom_name, radius, atom_class) of NACCESS; the bases of nucleotides by the first letters of their atoms."""
    bases = {prefix + base: {a: BASE_TYPES[a[0]] for a in atoms.split()} for prefix in ("", "D") for base, atoms in BASES.items()}
    return _rows(NACCESS_TYPES, {"ANY": NACCESS_ANY} | NACCESS_RESIDUES | bases)


def oons_rows() -> list[tuple[str, str, float, str]]:
    """Rows (residue, atom_name, radius, atom_class) of OONS."""
    return _rows(OONS_TYPES, {"ANY": OONS_ANY} | OONS_RESIDUES)


#: Built-in classifiers by name.
BUILTIN = {"naccess": naccess_rows, "oons": oons_rows}
