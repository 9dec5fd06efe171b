"""Tiles: neighbours across their borders, odd rows, kernels against plain tests of points and arcs, and plans that shuffle atoms and not pairs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacis.functions.geometry import sphere_points
from surfacis.operators import batch, kernels, masks, neighbors, selections, surface
from surfacis.plans import catalogue
from surfacis.sources import sinks

COLUMNS = "structure_id string, atom_index int, x double, y double, z double, radius double"


@pytest.fixture(scope="module")
def wide(spark):
    """A structure over many tiles to both sides of the origin, one of one place, one atom alone, and one at odd places."""
    rng = np.random.default_rng(5)
    rows = [("wide", i, *map(float, rng.uniform(-60, 60, 3) * (1, 0.2, 0.2)), float(rng.choice([1.4, 1.9]))) for i in range(900)]
    rows += [("same", i, 1.0, 1.0, 1.0, 1.5) for i in range(30)] + [("lone", 0, 0.0, 0.0, 0.0, 1.0)]
    rows += [("odd", 0, float("nan"), 0.0, 0.0, 1.5), ("odd", 1, 0.0, 0.0, 0.0, 1.5), ("odd", 2, 1.0, 0.0, 0.0, 1.5), ("odd", 3, None, 0.0, 0.0, 1.5), ("odd", 4, 1e300, 0.0, 0.0, 1.5), ("odd", 5, float("inf"), 0.0, 0.0, 1.5)]
    rows += [(None, i, float(i), 0.0, 0.0, 1.5) for i in range(3)]
    return spark.createDataFrame(rows, COLUMNS).cache()


def plain(rows, points):
    """Free points of each atom by the test of every point against every other atom."""
    out = {}
    for a in rows:
        free = np.ones(len(points), bool)
        for b in rows if a.structure_id is not None else ():
            ra, rb = a.radius + 1.4, b.radius + 1.4
            if b is not a and b.structure_id == a.structure_id and None not in (a.x, b.x) and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < (ra + rb) ** 2:
                free &= (a.x + ra * points[:, 0] - b.x) ** 2 + (a.y + ra * points[:, 1] - b.y) ** 2 + (a.z + ra * points[:, 2] - b.z) ** 2 >= rb * rb
        out[a.structure_id, a.atom_index] = int(free.sum())
    return out


def test_points_and_slices_over_tiles(wide):
    rows = [r for r in wide.collect()]
    near = [r for r in rows if r.x != 1e300]  # its square is too large for Python
    want = plain(near, sphere_points(40)) | {("odd", 4): 40}
    df = surface.shrake_rupley(wide, 40, carry=("radius",))
    got = {(r.structure_id, r.atom_index): r for r in df.collect()}
    assert {k: r.exposed for k, r in got.items()} == want and {k: r.radius for k, r in got.items()} == {(r.structure_id, r.atom_index): r.radius for r in rows}
    slices = {(r.structure_id, r.atom_index): r.area for r in surface.lee_richards(wide.where("structure_id <> 'odd'"), 8).collect()}
    whole = {(r.structure_id, r.atom_index): r.area for r in surface.lee_richards(wide.where("structure_id <> 'odd'"), 8, by="structure").collect()}
    assert slices.keys() == whole.keys() and all(slices[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)
    with pytest.raises(surface.InputError):
        surface.shrake_rupley(wide, carry=("x",))


def test_pairs_over_tiles(wide):
    rows = [r for r in wide.collect() if r.structure_id in ("wide", "same")]
    want = {(a.structure_id, a.atom_index, b.atom_index) for a in rows for b in rows if a is not b and a.structure_id == b.structure_id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < (a.radius + b.radius + 2.8) ** 2}
    got = [(r.structure_id, r.i, r.j) for r in neighbors.neighbor_pairs(wide.where("structure_id <> 'odd' OR structure_id IS NULL")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    half = [(r.structure_id, r.i, r.j) for r in neighbors.half_pairs(wide.where("structure_id <> 'odd'")).collect()]
    assert 2 * len(half) == len(want) and {p for s, i, j in half for p in ((s, i, j), (s, j, i))} == want
    atoms = masks.bitmask_areas(wide, 64).collect()
    assert len(atoms) == wide.count() and {r.exposed for r in atoms if r.structure_id in (None, "lone")} == {64}


def test_a_point_on_the_border_is_not_inside():
    """The second sphere touches the first one from within at the point (0, 0, 1): a product rounds either way, the distance does not."""
    xyz, points = np.array([[0.0, 0.0, 0.0], [0.0, 0.0, 0.5]]), np.array([[0.0, 0.0, 1.0], [0.0, 0.0, -1.0]])
    assert kernels.exposed_points(xyz, np.array([1.0, 0.5]), points).tolist() == [2, 1]
    assert kernels.exposed_points(xyz, np.array([1.0, np.nextafter(0.5, 1)]), points).tolist() == [1, 1]


def test_arcs_are_united_as_by_a_sweep():
    rng = np.random.default_rng(2)
    xyz, r, n = rng.uniform(0, 6, (40, 3)), rng.choice([2.8, 3.2], 40), 6
    want = []
    for a in range(len(r)):
        area = 0.0
        for k in range(n):
            h = xyz[a, 2] - r[a] + 2 * r[a] / n * (k + 0.5)
            own, arcs, free = math.sqrt(max(0, r[a] ** 2 - (h - xyz[a, 2]) ** 2)), [], True
            for b in range(len(r)):
                o2, d = r[b] ** 2 - (h - xyz[b, 2]) ** 2, math.dist(xyz[a, :2], xyz[b, :2])
                if b == a or o2 <= 0 or d >= own + math.sqrt(o2):
                    continue
                if d + own <= math.sqrt(o2):
                    free = False
                elif d + math.sqrt(o2) > own:
                    half, mid = math.acos(max(-1, min(1, (own**2 + d * d - o2) / (2 * own * d)))), math.atan2(xyz[b, 1] - xyz[a, 1], xyz[b, 0] - xyz[a, 0]) + math.pi
                    arcs.append((mid - half, mid + half))
            low, high = (np.array([x[i] for x in arcs]) for i in (0, 1))
            area += 2 * r[a] / n * r[a] * surface.free_arc(low, high) if free else 0.0
        want.append(area)
    assert kernels.slice_areas(xyz, r, n) == pytest.approx(np.array(want), abs=1e-9)


@pytest.mark.parametrize("rows", [5, 1 << 14])
def test_groups_that_batches_part(wide, monkeypatch, rows):
    monkeypatch.setattr(surface, "ROWS", rows)
    df = wide.where("structure_id IN ('wide', 'same')")
    wide.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.structure_id, r.atom_index): r.exposed for r in surface.shrake_rupley(df, 20).collect()}
    finally:
        wide.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(r.structure_id, r.atom_index): r.exposed for r in surface.shrake_rupley(df, 20, by="structure").collect()}


@pytest.mark.parametrize("run", [surface.shrake_rupley, surface.lee_richards, masks.bitmask_areas, masks.adaptive_areas])
def test_atoms_are_shuffled_once_and_pairs_never(wide, run):
    """One exchange by tile; the largest radius and atoms without a key have their own, of a row or of none. Before, 14 copies of every atom and its pairs were shuffled by cell."""
    wide.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = run(wide)._jdf.queryExecution().executedPlan().toString()
    finally:
        wide.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["residue_areas", "residue_runs", "residue_rsa", "polar_summary", "rsa_lines"])
def test_columns_pass_through_the_kernel(spark, name):
    """Areas were joined back to a second making of the atoms."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_carried_columns_of_interfaces_and_selections(spark):
    atoms = catalogue.pseudo_atoms(spark, "/root/testdata/sf0.001").where("structure_id < 4")
    faces, entries = catalogue._faces(atoms), catalogue._entries(atoms)
    rows = lambda df: sorted(map(str, df.collect()))
    carried = selections.residue_deltas(selections.buried_atoms(atoms, faces, 20, 1.4, catalogue.RESIDUE))
    joined = selections.residue_deltas(selections.buried_atoms(atoms, faces, 20, 1.4), atoms)
    assert rows(carried.select("structure_id", "partner", *catalogue.RESIDUE, "n_atoms", F.round("delta", 6))) == rows(joined.select("structure_id", "partner", *catalogue.RESIDUE, "n_atoms", F.round("delta", 6)))
    made, areas = selections.selection_atoms(atoms, entries, n_points=20, carry=(*catalogue.RESIDUE, "atom_name", "element"))
    plain = selections.selection_atoms(atoms, entries, n_points=20)
    assert rows(sinks.selection_rows(made, areas)) == rows(sinks.selection_rows(*plain, atoms))


def test_jobs_and_structures_meet_without_a_shuffle_of_their_product(spark):
    """200 structures x 500 jobs: before, every row of the result was sorted by its structure and what it asks for."""
    atoms = spark.range(200).select(F.col("id").alias("structure_id"), F.lit(0).alias("atom_index"), *[F.lit(0.0).alias(c) for c in "xyz"], F.lit(1.5).alias("radius"), F.lit("A").alias("chain"))
    jobs = spark.range(500).select(F.col("id").alias("job_id"), F.lit("sr").alias("algorithm"), F.lit(20).alias("resolution"), (1 + F.col("id") % 3 / 10).alias("probe"), F.lit(None).cast("array<string>").alias("chains"))
    df = batch.job_areas(atoms, jobs)
    rows = df.groupBy("n_sharing", F.round(F.sqrt(F.col("total_area") / (4 * math.pi)), 6).alias("r")).count().collect()
    assert sorted((r.n_sharing, r.r, r["count"]) for r in rows) == [(166, 2.7, 33200), (167, 2.5, 33400), (167, 2.6, 33400)]
    top = df._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert re.search("CartesianProduct|BroadcastNestedLoopJoin", top) and "SortMergeJoin" not in top
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
