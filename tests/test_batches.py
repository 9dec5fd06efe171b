"""Masks, plans by size, jobs, error rows, interfaces in one pass, dictionaries and frames, against plainer ways."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacis.functions.elements import atomic_number, vdw_radius
from surfacis.functions.geometry import sphere_points
from surfacis.operators import analysis, batch, components, masks, neighbors, policies, selections, surface, trajectory
from surfacis.schema import InputError
from surfacis.sources import files, sinks

COLUMNS = "structure_id string, atom_index int, x double, y double, z double, radius double, chain string"


def cloud(n, seed=0, name="s", box=14.0):
    rng = np.random.default_rng(seed)
    xyz, r = rng.uniform(-box / 2, box / 2, (n, 3)), rng.choice([1.2, 1.6, 1.88], n)
    return [(name, i, *map(float, p), float(a), "ABC"[i % 3]) for i, (p, a) in enumerate(zip(xyz, r))]


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame(cloud(120) + cloud(40, 1, "t") + cloud(1, 2, "lone"), COLUMNS).cache()


def rows_of(df, *cols):
    return {tuple(r)[:2]: tuple(r[c] for c in cols) for r in df.collect()}


def bin_of(d):
    u, v = d[0] / np.abs(d).sum(), d[1] / np.abs(d).sum()
    if d[2] < 0:
        u, v = (1 - abs(v)) * (1 if u >= 0 else -1), (1 - abs(u)) * (1 if v >= 0 else -1)
    cell = lambda c: int(min(max((c + 1) * 0.5 * 24, 0), 23))
    return cell(v) * 24 + cell(u)


@pytest.mark.parametrize("n_points", [1, 64, 130])
def test_masks_against_points(spark, atoms, n_points):
    points, middle = sphere_points(n_points), masks.directions()
    want = {}
    for s in ("s", "t", "lone"):
        a = [r for r in atoms.collect() if r.structure_id == s]
        for i in a:
            free, p, ri = np.ones(n_points, bool), np.array([i.x, i.y, i.z]), i.radius + 1.4
            for j in a:
                d, rj = np.array([j.x, j.y, j.z]) - p, j.radius + 1.4
                dist = math.sqrt((d * d).sum())
                if j is i or dist >= ri + rj or (ri * ri + dist * dist - rj * rj) / (2 * ri * dist) >= 1:
                    continue
                cos = (ri * ri + dist * dist - rj * rj) / (2 * ri * dist)
                free &= ~(points @ middle[bin_of(d)] >= math.floor(min(max((cos + 1) / 2, 0), 1) * 255 + 0.5) / 255 * 2 - 1) if cos > -1 else False
            want[s, i.atom_index] = (int(free.sum()),)
    df = masks.bitmask_areas(atoms, n_points)
    got = rows_of(df, "exposed")
    assert got.keys() == want.keys() and sum(abs(got[k][0] - want[k][0]) for k in want) <= 2  # a dot product at a border may round either way
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_masks_are_near_the_exact_areas(atoms):
    exact = sum(a for (a,) in rows_of(surface.shrake_rupley(atoms, 200), "area").values())
    near, more = (sum(a for (a,) in rows_of(masks.bitmask_areas(atoms, 200, correction=c), "area").values()) for c in (None, masks.CORRECTION))
    assert near == pytest.approx(exact, rel=0.1) and more > near
    turned = masks.bitmask_areas(atoms, 200, variant=F.lit(3), variants=4)
    assert sum(a for (a,) in rows_of(turned, "area").values()) == pytest.approx(exact, rel=0.1)
    with pytest.raises(InputError):
        masks.bitmask_areas(atoms, 2000)
    with pytest.raises(InputError):
        masks.bitmask_areas(atoms, correction=-1.0)


def test_only_undecided_atoms_take_the_fine_pass(atoms):
    coarse, fine = rows_of(masks.bitmask_areas(atoms, 64), "exposed"), rows_of(masks.bitmask_areas(atoms, 256), "exposed", "area")
    got = rows_of(masks.adaptive_areas(atoms), "points", "exposed", "area")
    undecided = {k for k, (e,) in coarse.items() if 0.1 * 64 < e < 0.9 * 64}
    assert undecided and {k for k, v in got.items() if v[0] == 256} == undecided and got.keys() == coarse.keys()
    assert all(got[k][1:] == fine[k] for k in undecided) and all(got[k][1] == coarse[k][0] for k in got.keys() - undecided)
    with pytest.raises(InputError):
        masks.adaptive_areas(atoms, low=0.9, high=0.1)


@pytest.mark.parametrize("large", [0, 50, 10_000])
def test_any_routing_gives_the_same_rows(spark, large):
    """One structure holds a third of all rows."""
    rows = cloud(100, 3, "huge") + [r for k in range(20) for r in cloud(10, 10 + k, f"s{k}", 6.0)]
    df = spark.createDataFrame(rows, COLUMNS)
    want = rows_of(surface.shrake_rupley(df, 60, by="structure"), "exposed")
    assert rows_of(surface.shrake_rupley(df, 60, by="auto", large=large), "exposed") == want == rows_of(surface.shrake_rupley(df, 60), "exposed")


def test_slices_by_cell_and_by_structure(atoms):
    kernel, cells = (rows_of(surface.lee_richards(atoms, by=b), "area") for b in ("structure", "cell"))
    assert kernel.keys() == cells.keys() and all(kernel[k][0] == pytest.approx(cells[k][0], abs=1e-9) for k in kernel)


def test_single_precision_is_near(atoms):
    for run in (surface.shrake_rupley, surface.lee_richards):
        a, b = (sum(v for (v,) in rows_of(run(atoms, precision=p), "area").values()) for p in ("f64", "f32"))
        assert a == pytest.approx(b, rel=1e-3)
    with pytest.raises(InputError):
        surface.shrake_rupley(atoms, precision="f32", by="cell")


def test_pairs_meet_once(atoms):
    both = {(r.structure_id, r.i, r.j) for r in neighbors.neighbor_pairs(atoms).collect()}
    half = [(r.structure_id, r.i, r.j) for r in neighbors.half_pairs(atoms).collect()]
    assert len(half) == len(set(half)) and both == {(s, *p) for s, i, j in half for p in ((i, j), (j, i))} and len(both) == 2 * len(half)
    far = atoms.withColumn("x", F.col("x") - 3e6)
    assert {(r.structure_id, r.i, r.j) for r in neighbors.neighbor_pairs(far).collect()} == both


@pytest.mark.parametrize("by", ["cell", "structure"])
def test_interfaces_in_one_pass(spark, atoms, by):
    faces = atoms.select("structure_id").distinct().select("structure_id", F.lit("f").alias("id"), F.array(F.lit("A")).alias("partner_a"), F.array(F.lit("B"), F.lit("C")).alias("partner_b"))
    got = {(r.structure_id, r.atom_index): (r.partner, r.isolated, r.complex) for r in selections.buried_atoms(atoms, faces, 60, by=by).collect()}
    whole = rows_of(surface.shrake_rupley(atoms, 60), "exposed")
    alone = {}
    for chains, partner in ((["A"], "a"), (["B", "C"], "b")):
        alone |= {k: (partner, v[0]) for k, v in rows_of(surface.shrake_rupley(atoms.where(F.col("chain").isin(chains)), 60), "exposed").items()}
    assert got == {k: (*alone[k], whole[k][0]) for k in whole}
    shared = faces.withColumn("partner_b", F.array(F.lit("A")))
    assert selections.buried_atoms(atoms, shared, 60, by=by).collect() == []


def test_jobs_share_computations(spark, atoms):
    jobs = [("a", "SR", 50, 1.4, ["B", "A", "A"]), ("b", "sr", 50, None, ["A", "B"]), ("c", None, None, None, None), ("d", "lr", 12, 1.1, ["A"]), ("e", "bitmask", 64, 1.4, None), ("f", "sr", 100, 1.4, None), ("g", "xx", 1, 1.0, None), ("h", "sr", 0, 1.0, None), ("i", "sr", 9, float("nan"), None), ("j", "sr", 9, 1.0, []), ("k", "sr", 9, 1.0, ["Z"])]
    got = {(r.structure_id, r.job_id): r for r in batch.job_areas(atoms, spark.createDataFrame(jobs, "job_id string, algorithm string, resolution int, probe double, chains array<string>")).collect()}
    assert len(got) == 3 * len(jobs)
    total = lambda df: {r.structure_id: r.t for r in df.groupBy("structure_id").agg(F.sum("area").alias("t")).collect()}
    ab = total(surface.shrake_rupley(atoms.where("chain IN ('A', 'B')"), 50))
    want = {"a": ab, "b": ab, "c": total(surface.shrake_rupley(atoms)), "d": total(surface.lee_richards(atoms.where("chain = 'A'"), 12, 1.1)), "e": total(masks.bitmask_areas(atoms, 64)), "f": total(surface.shrake_rupley(atoms))}
    for job, areas in want.items():
        for s in ("s", "t", "lone"):
            assert got[s, job].total_area == pytest.approx(areas[s]) and got[s, job].status == "ok"
    assert [got["s", j].n_sharing for j in "abcdefghijk"] == [2, 2, 2, 1, 1, 2, 0, 0, 0, 0, 1]
    assert [got["t", j].error for j in "ghijk"] == ["unknown algorithm xx", "resolution out of range", "probe out of range", "chains are empty", "no atoms"]
    many = spark.range(65).select(F.col("id").alias("job_id"), F.lit("sr").alias("algorithm"), (F.col("id") + 1).cast("int").alias("resolution"), F.lit(1.4).alias("probe"), F.lit(None).cast("array<string>").alias("chains"))
    with pytest.raises(InputError):
        batch.job_areas(atoms, many)


def test_faulty_files_leave_their_siblings_alone(spark, tmp_path):
    site = "data_x\nloop_\n_atom_site.group_PDB\n_atom_site.type_symbol\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.label_asym_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n"
    for name, x in (("good", "1.5"), ("bad", "nan"), ("text", "one")):
        (tmp_path / f"{name}.cif").write_text(site + f"ATOM C CA ALA A {x} 2.0 3.0\nATOM N N ALA A 9.0 2.0 3.0\n")
    (tmp_path / "even.json").write_text(json.dumps({"x": [0.0], "y": [0.0], "z": [0.0], "r": [1.5]}))
    (tmp_path / "uneven.json").write_text(json.dumps({"x": [0.0, 1.0], "y": [0.0], "z": [0.0], "r": [1.5]}))
    line = "ATOM      1  CA  ALA A   1    %8s   2.000   3.000  1.00  0.00           C\n"
    (tmp_path / "one.pdb").write_text(line % "1.000" + line % "NaN" + line % "1.0e1")
    (tmp_path / "none.pdb").write_text("HEADER\n")
    got = {r.structure_id: (r.status, r.error, r.n_atoms) for r in batch.batch_areas(files.read_structures(spark, str(tmp_path), strict=False), files.structure_files(spark, str(tmp_path))).collect()}
    bad = "Cartn_x is not a number at atom 0"
    assert got == {"good": ("ok", None, 2), "bad": ("err", bad, None), "text": ("err", bad, None), "even": ("ok", None, 1), "uneven": ("err", "arrays of unequal length at atom 0", None), "one": ("ok", None, 1), "none": ("err", "no atoms", None)}
    assert [r.structure_id for r in files.structure_files(spark, str(tmp_path)).collect()] == ["bad", "even", "good", "none", "one", "text", "uneven"]
    with pytest.raises(Exception, match="not a number"):
        files.read_structures(spark, str(tmp_path)).collect()


def test_batches_of_nothing_and_of_other_rows(spark, atoms):
    assert batch.batch_areas(atoms.limit(0)).collect() == []
    odd = atoms.withColumns({"radius": F.when((F.col("structure_id") == "t") & (F.col("atom_index") == 3), 0.0).otherwise(F.col("radius")), "z": F.when((F.col("structure_id") == "s") & (F.col("atom_index") > 7), None).otherwise(F.col("z"))})
    rows = batch.batch_areas(odd, algorithm="lr")
    assert {r.structure_id: r.error for r in rows.collect()} == {"s": "coordinate is not finite at atom 8", "t": "radius out of range at atom 3", "lone": None}
    assert tuple(analysis.batch_summary(rows).first()) == (3, 1, 2, 1)


def test_dictionaries_by_need_and_precedence(spark):
    comp = lambda symbol, ids: (spark.createDataFrame([(c, i, f"X{i}", symbol) for c in ids for i in range(2)], "comp_id string, idx int, atom_id string, type_symbol string"), spark.createDataFrame([(c, 0, 1, "SING", False) for c in ids], "comp_id string, atom_idx_1 int, atom_idx_2 int, bond_order string, aromatic boolean"))
    have = spark.createDataFrame([("AA ",), ("BB",), ("CC",), ("KN",), (None,), ("",), ("AA",)], "residue string")
    known = spark.createDataFrame([("KN", "X0", 1.0, "polar")], "residue string, atom_name string, radius double, atom_class string")
    beside, inline, external, explicit = comp("C", ["AA", "BB", "CC", "KN", "ZZ"]), comp("N", ["BB", "CC"]), comp("O", ["CC"]), comp("S", ["AA"])
    need = {r.comp_id for r in components.needed_components(have, known).collect()}
    assert need == {"AA", "BB", "CC"}
    of = lambda **k: {(r.residue, r.atom_name): (r.radius, r.source) for r in components.resolve(have, known, **k).collect()}
    got = of(beside=beside, inline=inline, external=external)
    assert {k[0]: v for k, v in got.items()} == {"AA": (1.88, "beside"), "BB": (1.64, "inline"), "CC": (1.46, "external")} and len(got) == 6
    assert {k[0]: v for k, v in of(beside=beside, inline=inline, explicit=explicit).items()} == {"AA": (1.77, "explicit"), "BB": (1.64, "inline"), "CC": (1.64, "inline")}
    assert of() == {}
    rows = spark.createDataFrame([("KN", " X0 "), ("AA", "X1"), ("QQ", "X1")], "residue string, atom_name string")
    found = components.component_radii(rows, known, components.resolve(have, known, beside=beside))
    assert sorted((r.residue, r.radius, r.atom_class, r.source) for r in found.collect()) == [("AA", 1.88, "apolar", "beside"), ("KN", 1.0, "polar", "known"), ("QQ", None, "unknown", None)]


def test_symbols_that_begin_with_d(spark):
    df = spark.createDataFrame([("DU", 0, 1.0), ("D", 1, 1.0), ("DY", 66, None), ("H", 1, 1.2), ("HX", 1, 1.2), ("Q", 0, 1.0), ("CX", 6, 1.7)], "s string, number int, radius double")
    rows = df.withColumns({"got": atomic_number(F.col("s")), "r": vdw_radius(atomic_number(F.col("s")), F.col("s"))}).collect()
    assert all(r.got == r.number and (r.radius is None or r.r == r.radius) for r in rows)
    kept = policies.keep_atoms(df.select("s", atomic_number(F.col("s")).alias("element"), F.lit("ATOM").alias("record")))
    assert {r.s for r in kept.collect()} == {"DU", "DY", "Q", "CX"}


def test_frames_are_counted(spark, atoms):
    topology = atoms.where("structure_id = 't'")
    whole = topology.select("structure_id", "atom_index", "x", "y", "z")
    at = lambda df, n: df.withColumn("frame", F.lit(n))
    frames = at(whole, 0).union(at(whole.where("atom_index > 2"), 1)).union(at(whole.union(whole.where("atom_index = 1")), 2)).union(at(whole.withColumn("structure_id", F.lit("u")), 3)).union(at(whole.union(whole.where("atom_index = 1").withColumn("atom_index", F.lit(99))), 4))
    got = {r.frame: (r.n_atoms, r.error, r.total_sasa is None) for r in trajectory.frame_results(topology, frames, n_points=20).collect()}
    assert got == {0: (40, None, False), 1: (37, "37 of 40 atoms", True), 2: (41, "an atom stands twice", True), 3: (40, "no topology", True), 4: (41, "an atom is not in the topology", True)}
    assert [r.frame for r in trajectory.slice_range(spark.range(10).select(F.col("id").alias("frame")), 1, 8, 3).orderBy("frame").collect()] == [1, 4, 7]
    row = trajectory.in_square_nm(trajectory.in_angstrom(whole.where("atom_index = 0").withColumn("area", F.lit(250.0)))).first()
    assert row.area == pytest.approx(2.5) and row.x == pytest.approx(10 * whole.where("atom_index = 0").first().x)


def test_result_documents(spark):
    rows = spark.createDataFrame([("s", 1, "A", 1, "GLY", "", 2.0), ("s", 0, "A", 1, "GLY", "", 10.12345), ("s", 2, "B", 5, "ALA", "x", 0.0004)], "structure_id string, atom_index int, chain string, residue_num int, residue string, ins_code string, area double")
    doc = json.loads(sinks.residue_map_rows(analysis.runs(rows), rows).first().value)
    assert doc == {"status": "ok", "filename": "s", "total_area": 12.124, "atom_areas": [10.123, 2.0, 0.0], "residue_chain": ["A", "B"], "residue_name": ["GLY", "ALA"], "residue_number": [1, 5], "residue_insertion_code": ["", "x"], "residue_atom_start": [0, 2], "residue_atom_count": [2, 1], "residue_sasa": [12.123, 0.0]}
    assert list(doc)[:4] == ["status", "filename", "total_area", "atom_areas"]


def test_map_names_are_plain(spark, tmp_path):
    for name, fine in (("a.cif", True), ("../a.cif", False), ("..", False), ("d\\a.cif", False)):
        (tmp_path / "m.csv").write_text(f"filename,chains\n{name},A\n")
        if fine:
            assert files.read_chain_map(spark, str(tmp_path / "m.csv")).count() == 1
        else:
            with pytest.raises(InputError):
                files.read_chain_map(spark, str(tmp_path / "m.csv"))
