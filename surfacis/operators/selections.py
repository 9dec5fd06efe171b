"""Chain selections and interfaces: areas of sets of chains, and what is buried between two sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import N_POINTS, PROBE, sphere_area
from .surface import shrake_rupley, sided_points


def _selections(atoms: DataFrame, entries: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    """entries with their set, status and error, and the area of every atom of each set of a structure, computed once."""
    entries = entries.select("structure_id", "id", "chains", F.array_join(F.array_sort(F.array_distinct("chains")), ",").alias("set"))
    there = atoms.groupBy("structure_id").agg(F.collect_set("chain").alias("present"))
    checked = entries.join(there, "structure_id", "left").withColumn("missing", F.array_sort(F.array_except("chains", "present")))
    sets = checked.where("present IS NOT NULL AND size(missing) = 0").select("structure_id", "set", F.array_sort(F.array_distinct("chains")).alias("chains")).distinct()
    chosen = atoms.join(sets.select("structure_id", "set", F.explode("chains").alias("chain")), ["structure_id", "chain"])
    error = F.when(F.col("present").isNull(), "input structure not found").when(F.size("missing") > 0, F.concat(F.lit("selected chain not found: "), F.col("missing")[0]))
    checked = checked.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("err"))
    return checked.drop("present", "missing"), shrake_rupley(chosen, key=["structure_id", "set"], **options)


def selection_areas(atoms: DataFrame, entries: DataFrame, **options) -> DataFrame:
    """Area of each entry (structure_id, id, chains): its chains hide each other, others are absent. Equal sets of one structure are computed once.

    Returns structure_id, id, total_area, n_atoms, status and error; entries without a structure or chain are error rows.
    """
    checked, areas = _selections(atoms, entries, options)
    sums = areas.groupBy("structure_id", "set").agg(F.sum("area").alias("total_area"), F.count("*").alias("n_atoms"))
    return checked.join(sums, ["structure_id", "set"], "left").select("structure_id", "id", "total_area", "n_atoms", "status", "error")


def selection_atoms(atoms: DataFrame, entries: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """entries with status and error, and the area of every atom of each entry that is ok (structure_id, id, atom_index, what options carry, area)."""
    checked, areas = _selections(atoms, entries, options)
    rows = areas.join(checked.where("status = 'ok'").select("structure_id", "set", "id"), ["structure_id", "set"])
    return checked.drop("set"), rows.select("structure_id", "id", "atom_index", *options.get("carry", ()), "area")


def buried_atoms(atoms: DataFrame, interfaces: DataFrame, n_points: int = N_POINTS, probe: float = PROBE, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Per interface (structure_id, id, partner_a, partner_b) and atom: columns to carry, partner, isolated (points free with its partner alone), complex (with both), isolated_area, complex_area, delta.

    Each atom enters once for an interface, marked with its partner; one pass over the neighbours tells both exposures. Interfaces whose partners share a chain give no rows.
    """
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("partner_a").alias("c")), F.struct(F.lit(1).alias("side"), F.col("partner_b").alias("c")))
    ok = interfaces.where(~F.arrays_overlap("partner_a", "partner_b"))
    sets = ok.select("structure_id", "id", F.inline(sides)).select("structure_id", "id", "side", F.explode(F.array_distinct("c")).alias("chain"))
    rows = atoms.join(sets, ["structure_id", "chain"]).select("structure_id", "id", "atom_index", "x", "y", "z", "radius", "side", *carry)
    got = sided_points(rows, n_points, probe, key=["structure_id", "id"], carry=("side", *carry), **options)
    area = lambda c: sphere_area(F.col("radius") + probe) * F.col(c) / n_points
    rows = got.select("structure_id", "id", "atom_index", *carry, F.when(F.col("side") == 0, "a").otherwise("b").alias("partner"), "isolated", F.col("exposed").alias("complex"), area("isolated").alias("isolated_area"), area("exposed").alias("complex_area"))
    return rows.withColumn("delta", F.col("isolated_area") - F.col("complex_area"))


def interface_areas(atoms: DataFrame, interfaces: DataFrame, **options) -> DataFrame:
    """Per interface: areas of both partners and the complex, delta_sasa_total, and bsa (half of it), or an error."""
    rows = buried_atoms(atoms, interfaces, **options).groupBy("structure_id", "id").agg(
        F.sum(F.when(F.col("partner") == "a", F.col("isolated_area")).otherwise(0.0)).alias("sasa_partner_a"),
        F.sum(F.when(F.col("partner") == "b", F.col("isolated_area")).otherwise(0.0)).alias("sasa_partner_b"),
        F.sum("complex_area").alias("sasa_complex"),
    )
    delta = F.col("sasa_partner_a") + F.col("sasa_partner_b") - F.col("sasa_complex")
    there = atoms.groupBy("structure_id").agg(F.collect_set("chain").alias("present"))
    checked = interfaces.join(there, "structure_id", "left")
    lacks = lambda c: F.size(F.array_except(c, "present")) > 0
    error = F.when(F.col("present").isNull(), "input structure not found").when(F.arrays_overlap("partner_a", "partner_b"), "partner chain groups overlap").when(lacks("partner_a"), "partner A chain not found").when(lacks("partner_b"), "partner B chain not found")
    out = checked.select("structure_id", "id", error.alias("error")).join(rows, ["structure_id", "id"], "left")
    value = lambda c: F.when(F.col("error").isNull(), c)
    return out.select("structure_id", "id", "error", *[value(F.col(c)).alias(c) for c in ("sasa_partner_a", "sasa_partner_b", "sasa_complex")], value(delta).alias("delta_sasa_total"), value(delta / 2).alias("bsa"))


def residue_deltas(buried: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """Areas of every residue of an interface, isolated and in the complex, its partner, and delta (not halved); the name is the first atom's. atoms: where chain, residue_num, ins_code and residue are found, if buried doesn't carry them."""
    rows = buried if atoms is None else buried.join(atoms.select("structure_id", "atom_index", "chain", "residue_num", "ins_code", "residue"), ["structure_id", "atom_index"])
    sums = [F.sum(c).alias(c) for c in ("isolated_area", "complex_area", "delta")]
    return rows.groupBy("structure_id", "id", "partner", "chain", "residue_num", "ins_code").agg(F.min_by("residue", "atom_index").alias("residue"), F.min("atom_index").alias("first_atom"), F.count("*").alias("n_atoms"), *sums)
