"""Fixed chemical values, and their look-ups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest surface of a residue in a Gly-X-Gly tripeptide, in square angstrom.
MAX_SASA = {
    "ALA": 129.0, "ARG": 274.0, "ASN": 195.0, "ASP": 193.0, "CYS": 167.0, "GLN": 225.0, "GLU": 223.0, "GLY": 104.0, "HIS": 224.0, "ILE": 197.0,
    "LEU": 201.0, "LYS": 236.0, "MET": 224.0, "PHE": 240.0, "PRO": 159.0, "SER": 155.0, "THR": 172.0, "TRP": 285.0, "TYR": 263.0, "VAL": 174.0,
}
# Residues by class; all others are unknown.
POLAR = ["ARG", "ASN", "ASP", "GLN", "GLU", "HIS", "LYS", "SER", "THR", "TYR"]
NONPOLAR = ["ALA", "CYS", "PHE", "GLY", "ILE", "LEU", "MET", "PRO", "TRP", "VAL"]
# Atoms of the main chain; atomic numbers and initials of polar atoms.
MAIN_CHAIN, POLAR_NUMBERS, POLAR_INITIALS = ["N", "CA", "C", "O", "OXT"], [7, 8, 15, 16], ["N", "O", "P", "S"]
# Van der Waals radius by atomic number.
RADIUS_BY_NUMBER = {
    1: 1.10, 3: 1.81, 4: 1.53, 6: 1.70, 7: 1.55, 8: 1.52, 9: 1.47, 11: 2.27, 12: 1.73, 15: 1.80, 16: 1.80, 17: 1.75, 19: 2.75, 20: 2.31,
    25: 1.19, 26: 1.26, 27: 1.13, 28: 1.63, 29: 1.40, 30: 1.39, 33: 1.85, 34: 1.90, 35: 1.83, 48: 1.58, 53: 1.98, 80: 1.55, 82: 2.02,
}
# Van der Waals radius that file readers give, by atomic number from 1; unknown elements (0) have 1.00.
READER_RADII = [
    1.20, 1.40, 1.82, 1.53, 1.92, 1.70, 1.55, 1.52, 1.47, 1.54, 2.27, 1.73, 1.84, 2.10, 1.80, 1.80, 1.75, 1.88, 2.75, 2.31, 2.11, 1.95, 1.06, 1.13, 1.19, 1.26, 1.13, 1.63, 1.40, 1.39,
    1.87, 2.11, 1.85, 1.90, 1.85, 2.02, 3.03, 2.49, 1.61, 1.42, 1.33, 1.75, 2.00, 1.20, 1.22, 1.63, 1.72, 1.58, 1.93, 2.17, 2.06, 2.06, 1.98, 2.16, 3.43, 2.68, 1.83, 1.86, 1.62, 1.79,
    1.76, 1.74, 1.96, 1.69, 1.66, 1.63, 1.61, 1.59, 1.57, 1.54, 1.53, 1.40, 1.22, 1.26, 1.30, 1.58, 1.22, 1.75, 1.66, 1.55, 1.96, 2.02, 2.07, 1.97, 2.02, 2.20, 3.48, 2.83, 2.12, 1.84,
    1.60, 1.86, 1.71, 1.67, 1.66, 1.65, 1.64, 1.63, 1.62, 1.61, 1.60, 1.59, 1.58,
]
# Symbols of the elements in order of atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s.upper(): i + 1 for i, s in enumerate(SYMBOLS)} | {"D": 1}
RADIUS_BY_SYMBOL = {SYMBOLS[n - 1].upper(): r for n, r in RADIUS_BY_NUMBER.items()}


# First letters that stand for an element where a symbol is unknown. D is hydrogen by its whole symbol only.
FIRST_LETTERS = ["H", "B", "C", "N", "O", "F", "P", "S", "K", "V", "Y", "I", "W", "U"]


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null where it has none."""
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(literal, key)


def atomic_number(symbol: Column) -> Column:
    """Atomic number of a symbol in any case; of its first letter if the whole is unknown and the letter is an element's; else 0, as for dummy atoms (DU)."""
    s = F.upper(F.trim(symbol))
    return F.coalesce(lookup(NUMBER, s), lookup({c: NUMBER[c] for c in FIRST_LETTERS}, F.substring(s, 1, 1)), F.lit(0))


def vdw_radius(number: Column, symbol: Column | None = None) -> Column:
    """Radius that file readers give an element: 1.00 where none is known, and for D, which is hydrogen to filters but has no radius of its own."""
    known = F.coalesce(F.get(F.array(*[F.lit(r) for r in READER_RADII]), number - 1), F.lit(1.0))
    return known if symbol is None else F.when(F.upper(F.trim(symbol)) == "D", 1.0).otherwise(known)


def element_of_name(name: Column) -> Column:
    """Element symbol of an atom name: two letters if they are one with a known radius and no space leads, else the first."""
    t = F.upper(F.trim(name))
    two = F.substring(t, 1, 2)
    return F.when(~F.startswith(name, F.lit(" ")) & (F.length(t) >= 2) & two.isin([s for s in RADIUS_BY_SYMBOL if len(s) == 2]), two).otherwise(F.substring(t, 1, 1))


def guessed_radius(element: Column, name: Column) -> Column:
    """Radius by atomic number, else by the element that the atom's name suggests, else null."""
    return F.coalesce(lookup(RADIUS_BY_NUMBER, element.cast("int")), lookup(RADIUS_BY_SYMBOL, element_of_name(name)))


def residue_class(residue: Column) -> Column:
    return F.when(residue.isin(POLAR), "polar").when(residue.isin(NONPOLAR), "nonpolar").otherwise("unknown")


def is_main_chain(name: Column) -> Column:
    return F.trim(name).isin(MAIN_CHAIN)


def is_polar_atom(element: Column, name: Column) -> Column:
    """By atomic number where it is known, else by the first letter of the name."""
    return F.when(F.coalesce(element, F.lit(0)) > 0, element.isin(POLAR_NUMBERS)).otherwise(F.coalesce(F.upper(F.substring(F.trim(name), 1, 1)).isin(POLAR_INITIALS), F.lit(False)))
