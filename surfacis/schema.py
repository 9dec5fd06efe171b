"""The canonical atoms table, and checks on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATOMS = (
    "structure_id string, atom_index int, model_num int, record string, x double, y double, z double, radius double, "
    "element int, atom_name string, residue string, chain string, auth_chain string, residue_num int, ins_code string, alt_loc string, occupancy double"
)
MAX_RADIUS = 100.0
#: Parameter ranges: probe in (0, 10], points 1 to 10000 (1024 for bitmasks), slices 1 to 1000.
LIMITS = {"probe": (0.0, 10.0), "n_points": (1, 10_000), "n_slices": (1, 1_000), "bitmask_points": (1, 1_024)}


class InputError(ValueError):
    """An input or a parameter that no surface can be computed for."""


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise InputError(f"columns needed: {', '.join(missing)}")


def check_parameter(name: str, value: float) -> None:
    low, high = LIMITS[name]
    if not (low < value <= high if name == "probe" else low <= value <= high):
        raise InputError(f"{name} must lie in {low} to {high}, not {value}")


def problem(strict: bool = True, fault: str | None = None) -> Column:
    """Why a row can't be an atom, null if it can. strict: radii above 0 and up to MAX_RADIUS, else 0 or more. fault: a column in which a reader says what is wrong with the row."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    radius = (F.col("radius") <= 0) | (F.col("radius") > MAX_RADIUS) if strict else F.col("radius") < 0
    read = F.when(F.col(fault).isNotNull(), F.col(fault)) if fault else F.when(F.lit(False), "")
    return read.when(odd("x") | odd("y") | odd("z"), "coordinate is not finite").when(odd("radius"), "radius is not finite").when(radius, "radius out of range")


def validate(atoms: DataFrame, strict: bool = True) -> DataFrame:
    """One row per structure: atoms, problems, and duplicates (atoms beyond the first at the same coordinates)."""
    require_columns(atoms, "structure_id", "x", "y", "z", "radius")
    places = atoms.withColumn("bad", problem(strict).isNotNull().cast("long")).groupBy("structure_id", "x", "y", "z").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    return places.groupBy("structure_id").agg(F.sum("n").alias("n_atoms"), F.sum("bad").alias("n_problems"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def first_problems(atoms: DataFrame, n: int = 10) -> DataFrame:
    """The first n problems of the whole table, for a report."""
    return atoms.withColumn("problem", problem()).where("problem IS NOT NULL").select("structure_id", "atom_index", "problem").orderBy("structure_id", "atom_index").limit(n)
