"""Component dictionaries: which components are needed, which source of one counts, and radii of atoms from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import derived_table, preferred

#: Sources in order of precedence, the last one first; an explicit dictionary stands in the place of the one found beside the input.
SOURCES = ("beside", "inline", "external")
Dictionary = tuple[DataFrame, DataFrame]


def needed_components(atoms: DataFrame, known: DataFrame) -> DataFrame:
    """comp_id of the residues that occur in atoms and that the known table (residue) hasn't: what a dictionary has to tell."""
    there = atoms.select(F.trim("residue").alias("comp_id")).where("comp_id <> ''").distinct()
    return there.join(known.select(F.col("residue").alias("comp_id")), "comp_id", "left_anti")


def resolve(atoms: DataFrame, known: DataFrame, beside: Dictionary | None = None, inline: Dictionary | None = None, external: Dictionary | None = None, explicit: Dictionary | None = None) -> DataFrame:
    """residue, atom_name, radius, atom_class and source for the residues that are needed, from dictionaries (comp_atoms, comp_bonds).

    Dictionaries are cut down to needed components by semi-joins before their bonds are analysed. For an atom that several describe, the later of beside, inline and external counts,
    atom by atom; an explicit dictionary takes the place of beside, whose components then don't count at all. Without any, an empty table.
    """
    need = needed_components(atoms, known)
    given = [(n, d) for n, d in zip(SOURCES, (explicit or beside, inline, external)) if d is not None]
    if not given:
        return atoms.sparkSession.createDataFrame([], "residue string, atom_name string, radius double, atom_class string, source string")
    tables = []
    for name, (comp_atoms, comp_bonds) in given:
        cut = [t.join(need, "comp_id", "left_semi") for t in (comp_atoms, comp_bonds)]
        tables.append(derived_table(*cut).withColumn("source", F.lit("explicit" if name == "beside" and explicit is not None else name)))
    return preferred(tables)


def component_radii(atoms: DataFrame, known: DataFrame, resolved: DataFrame) -> DataFrame:
    """atoms with radius, atom_class and source: the known table's (residue, atom_name, radius, atom_class), else the resolved one's, else null, unknown and null."""
    key = [F.trim("residue"), F.trim("atom_name")]
    side = lambda t, name, source: t.select(F.col("residue").alias(f"{name}_residue"), F.col("atom_name").alias(f"{name}_atom"), F.struct(F.col("radius"), F.col("atom_class"), source.alias("source")).alias(name))
    rows = atoms.drop("atom_class", "source")
    for t in (side(known, "fixed", F.lit("known")), side(resolved, "found", F.col("source"))):
        name = t.columns[2]
        rows = rows.join(t, (key[0] == t[f"{name}_residue"]) & (key[1] == t[f"{name}_atom"]), "left").drop(f"{name}_residue", f"{name}_atom")
    best = F.coalesce("fixed", "found")
    return rows.withColumns({"radius": best["radius"], "atom_class": F.coalesce(best["atom_class"], F.lit("unknown")), "source": best["source"]}).drop("fixed", "found")
