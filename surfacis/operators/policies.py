"""Row filters, and policies for alternate locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import InputError

SITE = ["structure_id", "model_num", "residue_num", "chain", "residue", "ins_code", "atom_name"]


def keep_atoms(df: DataFrame, hetatm: bool = False, hydrogens: bool = False, model: int | None = None, chains: list[str] | None = None, auth: bool = False, classifier: str | None = None) -> DataFrame:
    """The standard filters. The ccd classifier implies HETATM rows; a null model passes any model; a null chain passes no list of chains."""
    if not (hetatm or classifier == "ccd"):
        df = df.where(F.col("record") == "ATOM")
    if not hydrogens:
        df = df.where(~(F.coalesce("element", F.lit(0)) == 1))
    if model is not None:
        df = df.where(F.col("model_num").isNull() | (F.col("model_num") == model))
    if chains is not None:
        df = df.where(F.col("auth_chain" if auth else "chain").isin(chains))
    return df


def selection_index(df: DataFrame, key: str = "structure_id") -> DataFrame:
    """Add source_atom_index: the position from 0 among the rows left."""
    return df.withColumn("source_atom_index", F.row_number().over(Window.partitionBy(key).orderBy("atom_index")) - 1)


def _blank() -> Column:
    return F.trim(F.coalesce("alt_loc", F.lit(""))) == ""


def alternate_locations(df: DataFrame, mode: str = "auto", selected: str | None = None, site: list[str] | None = None) -> DataFrame:
    """Choose among atoms that share a site.

    auto: rows without a mark stay. For the others, the first row of the site that is unmarked or marked A decides: unmarked, they go;
    A, only A stays; without either the highest occupancy stays, the earliest of equals. highest-occupancy: marked rows
    of the highest occupancy, all of equals. selected: unmarked rows and the selected mark. all: everything. none: everything, an error if a row is marked.
    """
    site = site or [c for c in SITE if c in df.columns]
    if mode == "all":
        return df
    if mode == "none":
        if not df.where(~_blank()).isEmpty():
            raise InputError("alternate locations are present")
        return df
    if mode == "selected":
        return df.where(_blank() | (F.col("alt_loc") == selected))
    whole = Window.partitionBy(*site)
    best = F.struct(F.coalesce("occupancy", F.lit(0.0)).alias("o"), (-F.col("atom_index")).alias("i"))
    if mode == "highest-occupancy":
        top = F.max(F.when(~_blank(), F.coalesce("occupancy", F.lit(0.0)))).over(whole)
        return df.withColumn("__top", top).where(_blank() | (F.coalesce("occupancy", F.lit(0.0)) == F.col("__top"))).drop("__top")
    if mode != "auto":
        raise InputError(f"alternate locations {mode}")
    first = F.min(F.when(_blank() | (F.col("alt_loc") == "A"), F.struct("atom_index", (~_blank()).alias("a")))).over(whole)
    top = F.max(F.when(~_blank(), best)).over(whole)
    chosen = F.when(_blank(), True).when(F.col("__first").isNull(), best == F.col("__top")).otherwise(F.col("__first.a") & (F.col("alt_loc") == "A"))
    return df.withColumn("__first", first).withColumn("__top", top).where(chosen).drop("__first", "__top")
