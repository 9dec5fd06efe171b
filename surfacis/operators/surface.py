"""Solvent accessible surface area: sphere points (Shrake-Rupley) and slices (Lee-Richards)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import N_POINTS, N_SLICES, PROBE, sphere_area, sphere_points
from ..schema import InputError, check_parameter, require_columns
from .kernels import exposed_points, slice_areas
from .neighbors import TILE, tiled, widened

#: Atoms that a kernel over tiles takes at a time, if a tile has no more.
ROWS = 1 << 14
#: Atoms up to which by="auto" gives a structure to one task; larger ones are spread by tiles.
LARGE = 20_000


def free_arc(low: np.ndarray, high: np.ndarray) -> float:
    """Length of a circle that the arcs low to high leave free; an arc past 0 or 2 pi counts on both sides of it."""
    full = 2 * math.pi
    if not len(low):
        return full
    low, high = np.where(low < 0, low + full, low), np.where(high > full, high - full, high)
    split = low > high
    low, high = np.concatenate((low[~split], low[split], np.zeros(split.sum()))), np.concatenate((high[~split], np.full(split.sum(), full), high[split]))
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    return low[0] + np.maximum(0, low[1:] - high[:-1]).sum() + (full - high[-1])


def _columns(kernel_out: np.ndarray, out: dict[str, str]) -> list[pa.Array]:
    """What a kernel gives as Arrow columns; an area that is no number is null."""
    got = kernel_out if kernel_out.ndim > 1 else kernel_out[:, None]
    return [pa.array(np.ascontiguousarray(got[:, k]), pa.int64() if kind == "long" else pa.float64(), from_pandas=True) for k, kind in enumerate(out.values())]


def _schema(atoms: DataFrame, names: list[str], out: dict[str, str]) -> str:
    kinds = dict(atoms.dtypes)
    return ", ".join([*[f"`{k}` {kinds[k]}" for k in names], "r double", *[f"{c} {k}" for c, k in out.items()]])


def _grouped(atoms: DataFrame, kernel, out: dict[str, str], probe: float | str, precision: str, key: list[str], carry: tuple[str, ...]) -> DataFrame:
    """kernel over whole structures, each brought together by one shuffle on its key: key, atom_index, columns to carry, r (radius with probe) and what the kernel gives. out: names and types of that."""
    real = np.float32 if precision in ("f32", "single") else np.float64
    names = list(dict.fromkeys([*key, "atom_index", *carry]))

    def run(table: pa.Table) -> pa.Table:
        xyz = np.stack([table[c].to_numpy() for c in "xyz"], 1).astype(real)
        own = table[probe].to_numpy().astype(real) if isinstance(probe, str) else real(probe)
        got = kernel(xyz, table["radius"].to_numpy().astype(real) + own, table, None, None)
        rows = table.select([*names, "r"])
        for name, column in zip(out, _columns(got, out)):
            rows = rows.append_column(name, column)
        return rows

    return atoms.select(*dict.fromkeys([*names, "x", "y", "z", "radius"]), widened(probe).alias("r")).groupBy(*key).applyInArrow(run, _schema(atoms, names, out))


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """Which rows begin a group; a row with null in its key is a group of its own."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in key:
        a, b = table[c].slice(1), table[c].slice(0, table.num_rows - 1)
        if pa.types.is_nested(table[c].type):
            new[1:] |= [x is None or x != y for x, y in zip(a.to_pylist(), b.to_pylist())]
        else:
            new[1:] |= pc.fill_null(pc.not_equal(a, b), True).to_numpy()
    return new


def _by_tile(atoms: DataFrame, kernel, out: dict[str, str], probe: float | str, key: list[str], carry: tuple[str, ...]) -> DataFrame:
    """As _grouped(), by tiles: one shuffle brings the atoms of a tile and their neighbours together, and the kernel takes the tiles of a task some at a time. Atoms with null in their key have no neighbours."""
    names = list(dict.fromkeys([*key, "atom_index", *carry]))
    by = [*key, *TILE]
    lone = F.array_contains(F.array(*[F.col(k).isNull() for k in key]), True)
    rows = tiled(atoms.withColumn("x", F.when(lone, F.lit(float("nan"))).otherwise(F.col("x"))), probe, key, carry=tuple(c for c in names if c not in ("atom_index", *key))).sortWithinPartitions(*by)

    def done(table: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        own = table["own"].to_numpy()
        real = lambda c: table[c].to_numpy().astype(np.float64)
        got = kernel(np.stack([real(c) for c in "xyz"], 1), real("r"), table, np.cumsum(new), own)[own]
        mine = table.select([*names, "r"]).filter(table["own"]).combine_chunks()
        arrays = [c.combine_chunks() for c in mine.columns] + _columns(got, out)
        return pa.Table.from_arrays(arrays, [*names, "r", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                table = pa.Table.from_batches(held)
                new = _starts(table, by)
                last = int(np.flatnonzero(new)[-1])
                if last:
                    yield from done(table.slice(0, last), new[:last]).to_batches()
                    held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from done(table, _starts(table, by)).to_batches()

    return rows.mapInArrow(run, _schema(atoms, names, out))


def _routed(atoms: DataFrame, key: list[str], large: int, small_plan, large_plan) -> DataFrame:
    """Structures of up to so many atoms by one plan, the others by another. They are counted on the cluster, in the plan itself."""
    big = atoms.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > large).select(*key)
    return small_plan(atoms.join(big, key, "left_anti")).unionByName(large_plan(atoms.join(big, key, "left_semi")))


def shrake_rupley(atoms: DataFrame, n_points: int = N_POINTS, probe: float | str = PROBE, precision: str = "f64", by: str | None = None, key: list[str] | None = None, large: int = LARGE, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, atom_index, columns to carry, exposed (points that nothing buries) and area of every atom.

    by "cell" (the plain way in double precision): one shuffle on tiles of grid cells, then a vectorised kernel over the tiles of a task; right for a structure of any
    size. by "structure" (the plain way in single precision): one shuffle on the structure, then the kernel over each, which has to fit into a task. "auto": structures of
    more than large atoms by cell, the others by structure. All give the same counts, but "cell" has double precision only. A probe of each row's own is the name of
    a column of key. Null keys are structures of their own by "structure" and have no neighbours by "cell". An empty table gives an empty one.
    """
    key, points, single = _checked(atoms, n_points, probe, precision, key, carry)
    kernel = lambda xyz, r, table, group, own: exposed_points(xyz, r, points, None, group, own)
    out = _by(by, kernel, {"exposed": "long"}, atoms, probe, precision, key, large, carry)
    return out.select(*dict.fromkeys([*key, "atom_index", *carry]), "exposed", (sphere_area(F.col("r")) * F.col("exposed") / n_points).alias("area"))


def sided_points(atoms: DataFrame, n_points: int = N_POINTS, probe: float = PROBE, by: str | None = None, key: list[str] | None = None, large: int = LARGE, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, atom_index, radius, columns to carry, isolated and exposed: points that no atom of an atom's own side (an integer column) buries, and points that no atom buries.

    Every pair of neighbours is made once and every point tested once against it, with one bit for the pair's sides. by and large as in shrake_rupley().
    """
    require_columns(atoms, "side")
    key, points, _ = _checked(atoms, n_points, probe, "f64", key, carry)
    kernel = lambda xyz, r, table, group, own: exposed_points(xyz, r, points, table["side"].to_numpy(), group, own)
    names = tuple(dict.fromkeys(["radius", "side", *carry]))
    out = _by(by, kernel, {"isolated": "long", "exposed": "long"}, atoms, probe, "f64", key, large, names)
    return out.select(*dict.fromkeys([*key, "atom_index", "radius", *carry]), "isolated", "exposed")


def _checked(atoms: DataFrame, n_points: int, probe: float | str, precision: str, key: list[str] | None, carry: tuple[str, ...]):
    key = key or ["structure_id"]
    if isinstance(probe, str):
        if probe not in key:
            raise InputError(f"the probe's column {probe} has to belong to the key")
    else:
        check_parameter("probe", probe)
    check_parameter("n_points", n_points)
    require_columns(atoms, *key, "atom_index", "x", "y", "z", "radius", *carry)
    if used := {"x", "y", "z", "r", "own", "cell", *TILE} & set(carry):
        raise InputError(f"columns that can't be carried: {', '.join(sorted(used))}")
    return key, sphere_points(n_points), precision in ("f32", "single")


def _by(by: str | None, kernel, out: dict[str, str], atoms: DataFrame, probe: float | str, precision: str, key: list[str], large: int, carry: tuple[str, ...]) -> DataFrame:
    single = precision in ("f32", "single")
    by = by or ("structure" if single else "cell")
    if by not in ("structure", "cell", "auto"):
        raise InputError(f"by {by}: structure, cell or auto")
    if by == "cell" and single:
        raise InputError("by cell reckons in double precision")
    whole = lambda rows: _grouped(rows, kernel, out, probe, precision, key, carry)
    spread = lambda rows: _by_tile(rows, kernel, out, probe, key, carry)
    return whole(atoms) if by == "structure" or single else spread(atoms) if by == "cell" else _routed(atoms, key, large, whole, spread)


def lee_richards(atoms: DataFrame, n_slices: int = N_SLICES, probe: float | str = PROBE, precision: str = "f64", key: list[str] | None = None, by: str = "cell", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, atom_index, columns to carry and area of every atom by slices; by as in shrake_rupley(), single precision always by structure.

    Areas are equal but for rounding. A probe of each row's own is the name of a column of key. An empty table gives an empty one.
    """
    check_parameter("n_slices", n_slices)
    key, _, single = _checked(atoms, 1, probe, precision, key, carry)
    kernel = lambda xyz, r, table, group, own: slice_areas(xyz, r, n_slices, group, own).astype(np.float64)
    return _by("structure" if single else by, kernel, {"area": "double"}, atoms, probe, precision, key, LARGE, carry).drop("r")


def totals(areas: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Area of every structure (or frame)."""
    return areas.groupBy(*(key or ["structure_id"])).agg(F.sum("area").alias("total_area"), F.count("*").alias("n_atoms"))
