"""Radii and classes of atoms: look-up tables, element guesses, and radii derived from bonds."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import guessed_radius
from ..functions.radii import BUILTIN
from ..schema import InputError

#: Rows of a classifier table up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def read_classifier(spark: SparkSession, text: str) -> DataFrame:
    """residue, atom_name, radius, atom_class of a custom classifier in TOML ([types] and [[atoms]])."""
    doc = tomllib.loads(text)
    types, rows = doc.get("types", {}), []
    for a in doc.get("atoms", []):
        if a.get("type") not in types:
            raise InputError(f"unknown type {a.get('type')}")
        t = types[a["type"]]
        rows.append((a["residue"], a["atom"], float(t["radius"]), t.get("class", "unknown")))
    return spark.createDataFrame(rows, "residue string, atom_name string, radius double, atom_class string")


def builtin(spark: SparkSession, name: str) -> DataFrame:
    """residue, atom_name, radius, atom_class of a built-in classifier, some two hundred rows."""
    if name not in BUILTIN:
        raise InputError(f"unknown classifier {name}: {', '.join(BUILTIN)}")
    return spark.createDataFrame(BUILTIN[name](), "residue string, atom_name string, radius double, atom_class string")


def classify_builtin(atoms: DataFrame, name: str) -> DataFrame:
    """classify() by a built-in table, with the element that the atom's name suggests, whatever the row's own element is. A null residue meets ANY only, a null name nothing."""
    return classify(atoms, builtin(atoms.sparkSession, name), by_name=True)


def classify(atoms: DataFrame, table: DataFrame, any_residue: bool = True, guess: bool = True, original: bool = True, by_name: bool = False) -> DataFrame:
    """Replace radius and add atom_class and matched (exact, any, element, original or none).

    The exact residue and atom come first, then residue ANY, then the element (by_name: of the name alone), then the radius that the row has.
    A table with repeated keys keeps its largest radius for each.
    """
    table = table.groupBy("residue", "atom_name").agg(F.max(F.struct("radius", "atom_class")).alias("t"))
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = (lambda t: F.broadcast(t)) if small else (lambda t: t)
    exact = table.select(F.col("residue").alias("__r"), F.col("atom_name").alias("__n"), F.col("t").alias("__exact"))
    anyone = table.where("residue = 'ANY'").select(F.col("atom_name").alias("__m"), F.col("t").alias("__any"))
    rows = atoms.drop("atom_class", "matched").join(side(exact), (F.trim("residue") == F.col("__r")) & (F.trim("atom_name") == F.col("__n")), "left")
    rows = rows.join(side(anyone), F.trim("atom_name") == F.col("__m"), "left") if any_residue else rows.withColumn("__any", F.lit(None).cast("struct<radius:double,atom_class:string>"))
    guessed = guessed_radius(F.lit(None) if by_name else F.col("element"), F.col("atom_name")) if guess else F.lit(None).cast("double")
    kept = F.col("radius") if original else F.lit(None).cast("double")
    matched = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__any").isNotNull(), "any").when(guessed.isNotNull(), "element").when(kept.isNotNull(), "original").otherwise("none")
    rows = rows.withColumns({"matched": matched, "atom_class": F.coalesce("__exact.atom_class", "__any.atom_class", F.lit("unknown")), "radius": F.coalesce("__exact.radius", "__any.radius", guessed, kept)})
    return rows.drop("__r", "__n", "__m", "__exact", "__any")


def match_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("structure_id", "matched").agg(F.count("*").alias("n_atoms"))


def analyze_bonds(comp_atoms: DataFrame, comp_bonds: DataFrame) -> DataFrame:
    """Per component atom: heavy bonds and valence, hydrogens, hybridisation, implicit hydrogens, radius and class.

    comp_atoms (comp_id, idx, atom_id, type_symbol), comp_bonds (comp_id, atom_idx_1, atom_idx_2, bond_order, aromatic).
    """
    ends = F.array(F.struct(F.col("atom_idx_1").alias("idx"), F.col("atom_idx_2").alias("other")), F.struct(F.col("atom_idx_2").alias("idx"), F.col("atom_idx_1").alias("other")))
    both = comp_bonds.select("comp_id", F.upper("bond_order").alias("o"), F.coalesce("aromatic", F.lit(False)).alias("ring"), F.inline(ends))
    others = comp_atoms.select("comp_id", F.col("idx").alias("other"), F.upper(F.trim("type_symbol")).isin("H", "D").alias("h"))
    b = both.join(others, ["comp_id", "other"])
    valence = F.when(F.col("o") == "TRIP", 3).when(F.col("o").isin("DOUB", "AROM", "DELO", "POLY"), 2).otherwise(1)
    per = b.groupBy("comp_id", "idx").agg(
        F.count(F.when(~F.col("h"), 1)).alias("heavy_bonds"),
        F.coalesce(F.sum(F.when(~F.col("h"), valence)), F.lit(0)).alias("heavy_valence"),
        F.count(F.when(F.col("h"), 1)).alias("h_bonds"),
        F.max(F.col("o") == "TRIP").alias("triple"),
        F.max(F.col("o").isin("DOUB", "DELO", "POLY", "AROM") | F.col("ring")).alias("flat"),
    )
    rows = comp_atoms.join(per, ["comp_id", "idx"], "left").fillna(0, ["heavy_bonds", "heavy_valence", "h_bonds"])
    e = F.upper(F.trim("type_symbol"))
    hyb = F.when(F.col("triple"), "sp").when(F.col("flat"), "sp2").when(F.col("heavy_bonds") + F.col("h_bonds") > 0, "sp3").otherwise("unknown")
    usual = F.when(e == "C", 4).when(e == "N", 3).when(e.isin("O", "S", "SE"), 2).when(e == "P", 5)
    implicit = F.coalesce(F.greatest(usual - F.col("heavy_valence") - F.col("h_bonds"), F.lit(0)), F.lit(0))
    rows = rows.withColumn("hybridization", hyb).withColumn("implicit_h", implicit)
    bare = F.col("implicit_h") == 0
    carbon = F.when(F.col("hybridization") == "sp2", F.when(bare, 1.61).otherwise(1.76)).when(F.col("hybridization") == "sp3", F.when(bare, 1.61).otherwise(1.88)).when(F.col("hybridization") == "sp", 1.61).otherwise(1.88)
    oxygen = F.when(F.col("hybridization") == "sp3", 1.46).otherwise(1.42)
    radius = F.when(e == "C", carbon).when(e == "N", 1.64).when(e == "O", oxygen).when(e == "S", 1.77).when(e == "P", 1.80).when(e == "SE", 1.90)
    cls = F.when(e.isin("N", "O", "S", "P", "SE"), "polar").when(e == "C", "apolar").otherwise("unknown")
    return rows.withColumns({"radius": radius, "atom_class": cls}).drop("triple", "flat")


def derived_table(comp_atoms: DataFrame, comp_bonds: DataFrame) -> DataFrame:
    """A classifier table (residue, atom_name, radius, atom_class) of components; atoms without a radius are left out."""
    return analyze_bonds(comp_atoms, comp_bonds).where("radius IS NOT NULL").select(F.col("comp_id").alias("residue"), F.col("atom_id").alias("atom_name"), "radius", "atom_class")


def preferred(tables: list[DataFrame]) -> DataFrame:
    """Tables in order of precedence, the last one winning for each residue and atom, with all their columns."""
    out = None
    for i, t in enumerate(tables):
        rest = [c for c in t.columns if c not in ("residue", "atom_name")]
        t = t.select("residue", "atom_name", F.struct(*rest).alias("t"), F.lit(i).alias("prio"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("residue", "atom_name").agg(F.max_by("t", "prio").alias("t")).select("residue", "atom_name", "t.*")
