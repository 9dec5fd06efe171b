import math

import numpy as np
import pytest

from surfacis.functions.geometry import sphere_points
from surfacis.operators import analysis, classify, policies, selections, surface, trajectory
from surfacis.operators.neighbors import neighbor_pairs
from surfacis.schema import InputError, validate
from surfacis.streaming import frames as streaming

COLUMNS = "structure_id string, atom_index int, x double, y double, z double, radius double"


def atoms(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def total(df):
    return sum(r.area for r in df.collect())


def test_points_are_unit_vectors():
    assert np.allclose((sphere_points(100) ** 2).sum(1), 1)


def test_isolated_spheres(spark):
    one = atoms(spark, [("s", 0, 0.0, 0.0, 0.0, 1.0), ("s", 1, 100.0, 0.0, 0.0, 1.0)])
    full = 2 * 4 * math.pi * 2.4**2
    for got in (surface.shrake_rupley(one), surface.shrake_rupley(one, by="cell"), surface.lee_richards(one)):
        assert total(got) == pytest.approx(full, rel=1e-9)


def test_two_spheres_by_both_algorithms(spark):
    two = atoms(spark, [("s", 0, 0.0, 0.0, 0.0, 1.5), ("s", 1, 3.0, 0.0, 0.0, 1.5)])
    sr, lr = total(surface.shrake_rupley(two, n_points=1000)), total(surface.lee_richards(two, n_slices=50))
    cap = 2 * math.pi * 2.9 * (2.9 + 1.5)  # the exposed part of each sphere
    assert sr == pytest.approx(2 * cap, rel=0.01) and lr == pytest.approx(2 * cap, rel=0.01)


def test_free_arc():
    full = 2 * math.pi
    assert surface.free_arc(np.array([0.0, 0.9 * full]), np.array([0.1 * full, full])) == pytest.approx(0.8 * full)
    assert surface.free_arc(np.array([-0.1 * full]), np.array([0.1 * full])) == pytest.approx(0.8 * full)


def test_cutoff_is_strict(spark):
    near = lambda d: neighbor_pairs(atoms(spark, [("s", 0, 0.0, 0.0, 0.0, 1.0), ("s", 1, d, 0.0, 0.0, 1.0)])).count()
    assert near(4.79) == 2 and near(4.81) == 0


def test_kernel_and_grid_join_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{s}", i, *map(float, rng.uniform(0, 15, 3)), float(rng.choice([1.4, 1.9]))) for s in range(3) for i in range(120)]
    df = atoms(spark, rows)
    a = {(r.structure_id, r.atom_index): r.exposed for r in surface.shrake_rupley(df).collect()}
    b = {(r.structure_id, r.atom_index): r.exposed for r in surface.shrake_rupley(df, by="cell").collect()}
    assert a == b
    brute = set()
    for s, i, x, y, z, r in rows:
        brute |= {(s, i, j) for t, j, u, v, w, q in rows if s == t and i != j and (x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2 < (r + q + 2.8) ** 2}
    assert {(p.structure_id, p.i, p.j) for p in neighbor_pairs(df).collect()} == brute


def test_empty_input_gives_empty_output(spark):
    assert surface.shrake_rupley(atoms(spark, [])).count() == 0 and surface.lee_richards(atoms(spark, [])).count() == 0


def test_parameters_are_checked(spark):
    with pytest.raises(InputError):
        surface.shrake_rupley(atoms(spark, []), probe=0.0)


def test_validation_counts_problems_and_duplicates(spark):
    df = atoms(spark, [("s", 0, 0.0, 0.0, 0.0, 1.0), ("s", 1, 0.0, 0.0, 0.0, -1.0), ("s", 2, float("nan"), 0.0, 0.0, 1.0)])
    r = validate(df).first()
    assert (r.n_atoms, r.n_problems, r.n_duplicates) == (3, 2, 1)


@pytest.mark.parametrize(
    ("marks", "mode", "kept"),
    [
        ("  A", "auto", [0, 1]), ("A B", "auto", [0, 1]), ("BCA", "auto", [2]), ("BCD", "auto", [1]), ("BCD", "highest-occupancy", [1, 2]), ("AB ", "selected", [1, 2]), ("AB ", "all", [0, 1, 2]),
    ],
)
def test_alternate_locations(spark, marks, mode, kept):
    rows = [("s", i, m, [0.2, 0.5, 0.5][i]) for i, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "structure_id string, atom_index int, alt_loc string, occupancy double")
    out = policies.alternate_locations(df, mode, "B", site=["structure_id"])
    assert sorted(r.atom_index for r in out.collect()) == kept


def test_alternate_locations_none_raises(spark):
    df = spark.createDataFrame([("s", 0, "A", 1.0)], "structure_id string, atom_index int, alt_loc string, occupancy double")
    with pytest.raises(InputError):
        policies.alternate_locations(df, "none", site=["structure_id"])


def test_ethanol_radii_with_explicit_hydrogens(spark):
    comp = spark.createDataFrame([("EOH", i, f"{s}{i}", s) for i, s in enumerate("CCOHHHHHH")], "comp_id string, idx int, atom_id string, type_symbol string")
    bonds = spark.createDataFrame([("EOH", a, b, "SING", False) for a, b in [(0, 1), (0, 3), (0, 4), (0, 5), (1, 2), (1, 6), (1, 7), (2, 8)]], "comp_id string, atom_idx_1 int, atom_idx_2 int, bond_order string, aromatic boolean")
    got = {r.atom_name: (r.radius, r.atom_class) for r in classify.derived_table(comp, bonds).collect()}
    assert got == {"C0": (1.61, "apolar"), "C1": (1.61, "apolar"), "O2": (1.46, "polar")}


def test_custom_classifier(spark):
    text = '[types]\nC = { radius = 1.9, class = "apolar" }\n[[atoms]]\nresidue = "ANY"\natom = "CA"\ntype = "C"\n'
    df = spark.createDataFrame([("s", 0, "ALA", "CA", 6, 1.0), ("s", 1, "ALA", "N", 7, 1.0)], "structure_id string, atom_index int, residue string, atom_name string, element int, radius double")
    got = {r.atom_name: (r.radius, r.matched) for r in classify.classify(df, classify.read_classifier(spark, text)).collect()}
    assert got == {"CA": (1.9, "any"), "N": (1.55, "element")}


def test_interface_errors(spark):
    df = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0, 1.5, "A"), ("s", 1, 3.0, 0.0, 0.0, 1.5, "B")], COLUMNS + ", chain string")
    faces = spark.createDataFrame([("s", "ok", ["A"], ["B"]), ("s", "lap", ["A"], ["A"]), ("s", "gone", ["A"], ["C"]), ("t", "none", ["A"], ["B"])], "structure_id string, id string, partner_a array<string>, partner_b array<string>")
    got = {r.id: r for r in selections.interface_areas(df, faces).collect()}
    assert got["ok"].error is None and got["ok"].bsa == pytest.approx(got["ok"].delta_sasa_total / 2) and got["ok"].bsa > 0
    assert [got[k].error for k in ("lap", "gone", "none")] == ["partner chain groups overlap", "partner B chain not found", "input structure not found"]


def test_batch_summary(spark):
    rows = spark.createDataFrame([("a", "ok", 5), ("b", "err", None), ("c", "ok", 7)], "structure_id string, status string, n_atoms long")
    assert tuple(analysis.batch_summary(rows).first()) == (3, 2, 1, 12)
    assert tuple(analysis.batch_summary(rows.limit(0)).first()) == (0, 0, 0, 0)


def test_frame_stream_equals_the_batch(spark, tmp_path):
    topology = spark.createDataFrame([("s", 0, 1.5), ("s", 1, 1.7)], "structure_id string, atom_index int, radius double").selectExpr("*", "0D AS x", "0D AS y", "0D AS z")
    rows = [("s", f, a, a * (1.0 + f), 0.0, 0.0) for f in range(6) for a in range(2)]
    every = spark.createDataFrame(rows, streaming.FRAMES)
    every.repartition(3, "frame").write.parquet(str(tmp_path / "in"))
    stream = streaming.frame_stream(spark, str(tmp_path / "in"), 1)
    for _ in range(2):  # a second run finds nothing new
        streaming.write_frame_totals(stream, topology, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    got = {r.frame: r.total_sasa for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({r.frame: r.total_sasa for r in trajectory.frame_totals(trajectory.frame_areas(topology, every)).collect()}) and len(got) == 6
