"""Fixed-radius neighbours: a range self-join within tiles of grid cells that one shuffle brings together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import PROBE, distance2

#: Half of the 27 cells around a cell, so that each pair meets once: the cell itself and the 13 behind it in order.
HALF_STENCIL = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) >= (0, 0, 0)]

def widened(probe: float | str) -> Column:
    """Radius and probe together; a probe of each row's own is the name of a column."""
    return F.col("radius") + (F.col(probe) if isinstance(probe, str) else probe)


#: Cells along the side of a tile as a power of two, and the columns that name a tile beside the key.
_TILE_BITS = 3
TILE = ["tile_x", "tile_y", "tile_z"]
#: Cells further away than this, and places that are no numbers, count as this one.
_FAR = 1e15
#: Base of the numbers of cells within a tile: its own, one to both sides, and room for steps from these.
_BASE = (1 << _TILE_BITS) + 4


def tiled(atoms: DataFrame, probe: float | str, key: list[str], max_radius: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Atoms brought together by tiles of 8 x 8 x 8 cells of each key: key, tile, own, cell (its number within the tile), atom_index, x, y, z, r (radius with probe) and columns to carry.

    A cell is a little wider than the largest cutoff, which is found within the plan (a scalar subquery) unless max_radius tells it. An atom stands in its own tile (own is true) and, if it lies in a border cell,
    in the tiles beside it, so a tile holds all neighbours of its own atoms: what follows needs no further shuffle, and a single huge structure is spread by its tiles.
    Tiles begin a cell before the origin, since structures that begin at it would else have copies in tiles without atoms of their own.
    """
    wide = F.abs(widened(probe))
    largest = F.coalesce(atoms.agg(F.nullif(F.max(F.when(~F.isnan(wide), wide)), F.lit(0.0)).alias("largest")).scalar(), F.lit(1.0)) if max_radius is None else F.lit(float(max_radius) + probe)
    rows = atoms.select(*key, "atom_index", "x", "y", "z", widened(probe).alias("r"), *carry)
    rows = rows.withColumns({f"cell_{c}": F.floor(F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), F.col(c) / (2.000002 * largest)))) + 1 for c in "xyz"})
    last = (1 << _TILE_BITS) - 1
    steps = lambda *n: F.array(*[F.lit(i).cast("long") for i in n])
    for c in "xyz":
        place = F.col(f"cell_{c}").bitwiseAND(F.lit(last).cast("long"))
        rows = rows.withColumn(f"step_{c}", F.explode(F.when(place == 0, steps(0, -1)).when(place == last, steps(0, 1)).otherwise(steps(0))))
    rows = rows.withColumns({f"tile_{c}": F.shiftright(f"cell_{c}", _TILE_BITS) + F.col(f"step_{c}") for c in "xyz"})
    within = [F.col(f"cell_{c}") - F.shiftleft(f"tile_{c}", _TILE_BITS) + 1 for c in "xyz"]
    own = (F.col("step_x") == 0) & (F.col("step_y") == 0) & (F.col("step_z") == 0)
    rows = rows.select(*key, *TILE, own.alias("own"), ((within[0] * _BASE + within[1]) * _BASE + within[2]).cast("int").alias("cell"), "atom_index", "x", "y", "z", "r", *carry)
    return rows.repartition(*[F.col(k) for k in (*key, *TILE)])


def neighbor_pairs(atoms: DataFrame, probe: float | str = PROBE, max_radius: float | None = None, key: str = "structure_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """All ordered pairs i, j of atoms of one structure whose probe-widened spheres meet: dist^2 < (r_i + r_j + 2 probe)^2.

    Columns: key, i, j, and position and widened radius of j (j_x, j_y, j_z, j_r) and of i. Rows without a key have no neighbours.
    """
    return keyed_pairs(atoms, probe, [key], max_radius, carry).drop(*TILE)


def half_pairs(atoms: DataFrame, probe: float | str = PROBE, max_radius: float | None = None, key: str = "structure_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """neighbor_pairs() with each pair once, in either order, with columns to carry from both sides (i_ and j_ before their names)."""
    return _tile_pairs(atoms, probe, [key], max_radius, carry).where("i_own").drop("i_own", "j_own", *TILE)


def keyed_pairs(atoms: DataFrame, probe: float | str, key: list[str], max_radius: float | None = None, carry: tuple[str, ...] = (), itself: bool = False) -> DataFrame:
    """neighbor_pairs() of atoms with one or more key columns, and the tile of i.

    Rows are partitioned by key and tile, so sums by key, tile and i need no shuffle. itself: every atom with a key also has a row of its own with null for j.
    """
    ends = ["", "_x", "_y", "_z", "_r", *[f"_{c}" for c in carry]]
    other = F.col("i") != F.col("j")
    forth = F.struct(F.col("i_own").alias("own"), *[(F.when(other, F.col("j")) if itself and s + e == "j" else F.col(f"{s}{e}")).alias(f"{s}{e}") for s in "ij" for e in ends])
    back = F.struct((F.col("j_own") & other).alias("own"), *[F.col(f"{'ji'[s == 'j']}{e}").alias(f"{s}{e}") for s in "ij" for e in ends])
    return _tile_pairs(atoms, probe, key, max_radius, carry, itself).select(*key, *TILE, F.inline(F.array(forth, back))).where("own").drop("own")


def _tile_pairs(atoms: DataFrame, probe: float | str, key: list[str], max_radius: float | None, carry: tuple[str, ...], itself: bool = False) -> DataFrame:
    """Pairs within tiles, once in each tile that holds both and in the same order everywhere; i_own and j_own tell whose tile it is.

    A tile's atoms meet in one row, as cells of atoms, so its size bounds what a task holds; each cell's atoms then meet those of the cell and of the 13 behind it. No join: Spark would shuffle for
    one on key, tile and cell what lies together by key and tile.
    """
    columns = ["cell", "own", "atom_index", "x", "y", "z", "r", *carry]
    names = lambda s: [f"{s}_cell", f"{s}_own", s, *[f"{s}_{c}" for c in columns[3:]]]
    rows = tiled(atoms.dropna(subset=key), probe, key, max_radius, carry)
    cells = rows.groupBy(*key, *TILE, "cell").agg(F.collect_list(F.struct(*columns)).alias("atoms"))
    tiles = cells.groupBy(*key, *TILE).agg(F.collect_list(F.struct("cell", "atoms")).alias("cells"))
    each = tiles.select(*key, *TILE, "cells", F.inline("cells").alias("at", "here"))
    steps = [(a * _BASE + b) * _BASE + c for a, b, c in HALF_STENCIL]
    beside = F.flatten(F.transform(F.filter("cells", lambda c: (c["cell"] - F.col("at")).isin(steps)), lambda c: c["atoms"]))
    each = each.select(*key, *TILE, "here", beside.alias("there"))
    each = each.select(*key, *TILE, "there", F.inline("here").alias(*names("i")))
    pairs = each.select(*key, *TILE, *names("i"), F.inline("there").alias(*names("j")))
    other, reach = F.col("i_cell") != F.col("j_cell"), F.col("i_r") + F.col("j_r")
    near = (other | (F.col("i") < F.col("j"))) & (distance2("i", "j") < reach * reach)
    if itself:
        near = near | (~other & (F.col("i") == F.col("j")) & F.col("i_own"))
    return pairs.where(near).drop("i_cell", "j_cell")


def neighbor_degree(atoms: DataFrame, probe: float = PROBE, max_radius: float | None = None) -> DataFrame:
    """Number of neighbours of every atom, 0 included."""
    pairs = half_pairs(atoms, probe, max_radius)
    ends = pairs.select("structure_id", F.explode(F.array("i", "j")).alias("atom_index"))
    n = ends.groupBy("structure_id", "atom_index").agg(F.count("*").alias("degree"))
    return atoms.select("structure_id", "atom_index").join(n, ["structure_id", "atom_index"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
