"""Registered queries over pseudo-atoms, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.elements import MAX_SASA, POLAR, NONPOLAR, RADIUS_BY_NUMBER, RADIUS_BY_SYMBOL, element_of_name, guessed_radius
from ..functions.geometry import N_POINTS, N_SLICES, PROBE, sphere_points
from ..functions.radii import BUILTIN
from ..operators import analysis, batch, classify, components, masks, neighbors, policies, selections, surface, trajectory
from ..sources import sinks
from ..sources.pseudo import ATOMS_SQL, pseudo_atoms

POINTS, SLICES = N_POINTS, N_SLICES
#: Points and thresholds of the adaptive passes, and atoms from which sr_routed spreads a structure: about the median of the pseudo-structures at every scale.
COARSE, FINE, LOW, HIGH = 64, 256, 0.10, 0.90
ROUTED = 600
#: A small classifier: exact rows and rows for any residue.
CLASSES = [("ALA", "CA", 1.87, "apolar"), ("SER", "OG1", 1.4, "polar"), ("ANY", "N", 1.65, "polar"), ("ANY", "O", 1.4, "polar"), ("ANY", "C", 1.76, "apolar"), ("GLY", "N", 1.7, "polar")]


def _areas(atoms: DataFrame, **options) -> DataFrame:
    return surface.shrake_rupley(atoms, n_points=POINTS, probe=PROBE, **options)


#: What names a residue.
RESIDUE = ("chain", "residue_num", "residue", "ins_code")


def _rows(spark: SparkSession, d: str, *carry: str) -> DataFrame:
    """Atoms with their areas and so many of their other columns, which pass through the kernel."""
    return _areas(pseudo_atoms(spark, d), carry=carry).drop("exposed")


def _r(*names: str) -> list:
    return [F.round(n, 3).alias(n) for n in names]


def neighbor_degree(spark, d):
    return neighbors.neighbor_degree(pseudo_atoms(spark, d), PROBE)


def sr_atoms(spark, d):
    return _areas(pseudo_atoms(spark, d)).select("structure_id", "atom_index", "exposed", *_r("area"))


def sr_atoms_by_structure(spark, d):
    """Areas of atoms by a kernel over each whole structure."""
    return _areas(pseudo_atoms(spark, d), by="structure").select("structure_id", "atom_index", "exposed", *_r("area"))


def sr_atoms_by_cell(spark, d):
    return _areas(pseudo_atoms(spark, d), by="cell").select("structure_id", "atom_index", "exposed", *_r("area"))


def sr_total(spark, d):
    return surface.totals(_areas(pseudo_atoms(spark, d))).select("structure_id", "n_atoms", *_r("total_area"))


def lr_total(spark, d):
    return surface.totals(surface.lee_richards(pseudo_atoms(spark, d), n_slices=SLICES)).select("structure_id", "n_atoms", F.round("total_area", 2).alias("total_area"))


def residue_areas(spark, d):
    return analysis.by_residue(_rows(spark, d, *RESIDUE)).select("structure_id", "chain", "residue_num", "ins_code", "residue", "first_atom", "n_atoms", *_r("area"))


def residue_classes(spark, d):
    atoms = _classified(spark, d)
    return analysis.by_residue_class(_areas(atoms, carry=("chain", "residue_num", "residue", "atom_class"))).select("structure_id", "chain", "residue_num", "residue", "n_atoms", *_r("area", "polar_area", "apolar_area"))


def residue_runs(spark, d):
    return analysis.runs(_rows(spark, d, *RESIDUE)).select("structure_id", "run", "chain", "residue_num", "residue", "ins_code", "atom_start", "atom_count", *_r("area"))


def rsa_table(spark, d):
    return analysis.breakdown(_rows(spark, d, *RESIDUE, "atom_name", "element")).select("structure_id", "chain", "residue", "residue_num", "ins_code", "level", *_r("total", "side", "main", "apolar", "polar"))


def residue_rsa(spark, d):
    return analysis.relative(analysis.by_residue(_rows(spark, d, *RESIDUE))).select("structure_id", "chain", "residue_num", "ins_code", "residue", F.round("rsa", 5).alias("rsa"))


def polar_summary(spark, d):
    return analysis.polar_summary(analysis.by_residue(_rows(spark, d, *RESIDUE))).select("structure_id", "n_polar", "n_nonpolar", "n_unknown", *_r("polar_area", "nonpolar_area", "unknown_area", "polar_fraction", "nonpolar_fraction"))


def class_totals(spark, d):
    atoms = _classified(spark, d)
    return analysis.class_totals(_areas(atoms, carry=("atom_class",))).select("structure_id", *_r("total_area", "polar_area", "apolar_area"))


def chain_totals(spark, d):
    return analysis.by_chain(_rows(spark, d, "chain")).select("structure_id", "chain", "n_atoms", *_r("area"))


def validation(spark, d):
    return schema.validate(pseudo_atoms(spark, d))


def standard_filters(spark, d):
    kept = policies.keep_atoms(pseudo_atoms(spark, d), model=2, chains=["A", "N"])
    return policies.selection_index(kept).select("structure_id", "atom_index", "source_atom_index")


def _altloc(mode, selected=None):
    def run(spark, d):
        return policies.alternate_locations(pseudo_atoms(spark, d), mode, selected).select("structure_id", "atom_index", "alt_loc")

    return run


def _classified(spark, d):
    return classify.classify(pseudo_atoms(spark, d), spark.createDataFrame(CLASSES, "residue string, atom_name string, radius double, atom_class string"))


def classified_atoms(spark, d):
    return _classified(spark, d).select("structure_id", "atom_index", "radius", "atom_class", "matched")


def naccess_atoms(spark, d):
    """Radii and classes of atoms by the built-in NACCESS table."""
    return classify.classify_builtin(pseudo_atoms(spark, d), "naccess").select("structure_id", "atom_index", "radius", "atom_class", "matched")


def oons_atoms(spark, d):
    """Radii and classes of atoms by the built-in OONS table."""
    return classify.classify_builtin(pseudo_atoms(spark, d), "oons").select("structure_id", "atom_index", "radius", "atom_class", "matched")


def builtin_counts(spark, d):
    """Atoms of structures by how the built-in tables found their radii."""
    made = [classify.match_counts(classify.classify_builtin(pseudo_atoms(spark, d), n)).withColumn("classifier", F.lit(n)) for n in BUILTIN]
    return made[0].unionByName(made[1]).select("classifier", "structure_id", "matched", "n_atoms")


def match_counts(spark, d):
    return classify.match_counts(_classified(spark, d))


def element_guess(spark, d):
    return pseudo_atoms(spark, d).select("atom_name", "element").distinct().select("atom_name", "element", element_of_name(F.col("atom_name")).alias("symbol"), guessed_radius(F.col("element"), F.col("atom_name")).alias("radius"))


_COMP_ATOMS = """SELECT p_partkey AS comp_id, idx, concat('X', CAST(idx AS VARCHAR(9))) AS atom_id,
    CASE (p_partkey + idx) % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'N' WHEN 2 THEN 'C' WHEN 3 THEN 'O' WHEN 4 THEN 'H' WHEN 5 THEN 'S' ELSE 'C' END AS type_symbol
    FROM part JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS v(idx) ON idx < p_size % 7 + 2"""
_COMP_BONDS = """SELECT p_partkey AS comp_id, idx AS atom_idx_1, idx + 1 AS atom_idx_2,
    CASE (p_partkey * 7 + idx) % 6 WHEN 0 THEN 'DOUB' WHEN 1 THEN 'TRIP' WHEN 2 THEN 'AROM' ELSE 'SING' END AS bond_order, (p_partkey + idx) % 9 = 0 AS aromatic
    FROM part JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS v(idx) ON idx < p_size % 7 + 1"""


def component_radii(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    atoms, bonds = (spark.sql(q.replace("FROM part", "FROM {part}"), part=part) for q in (_COMP_ATOMS, _COMP_BONDS))
    return classify.analyze_bonds(atoms, bonds).select("comp_id", "idx", "atom_id", "heavy_bonds", "heavy_valence", "h_bonds", "hybridization", "implicit_h", "radius", "atom_class")


def _entries(atoms: DataFrame) -> DataFrame:
    ids = atoms.select("structure_id").distinct()
    return ids.select("structure_id", F.inline(F.array(*[F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, c)).alias("chains")) for i, c in (("an", "AN"), ("na", "NA"), ("r", "R"), ("z", "Z"))])))


def chain_selections(spark, d):
    atoms = pseudo_atoms(spark, d)
    return selections.selection_areas(atoms, _entries(atoms), n_points=POINTS, probe=PROBE).select("structure_id", "id", "n_atoms", "status", "error", *_r("total_area"))


def _faces(atoms: DataFrame) -> DataFrame:
    return atoms.select("structure_id").distinct().select("structure_id", F.lit("a-r").alias("id"), F.array(F.lit("A")).alias("partner_a"), F.array(F.lit("R")).alias("partner_b"))


def buried_surface(spark, d):
    atoms = pseudo_atoms(spark, d)
    faces = _faces(atoms)
    return selections.interface_areas(atoms, faces, n_points=POINTS, probe=PROBE).select("structure_id", "id", "error", *_r("sasa_partner_a", "sasa_partner_b", "sasa_complex", "delta_sasa_total"), F.round("bsa", 2).alias("bsa"))


def _frames(spark, d):
    atoms = pseudo_atoms(spark, d)
    shift = F.col("frame") * (F.col("atom_index") % 5) * F.lit(0.0625)
    frames = atoms.select("structure_id", "atom_index", "x", "y", "z", F.explode(F.array(*map(F.lit, range(5)))).alias("frame")).withColumn("x", F.col("x") + shift)
    return atoms, trajectory.slice_frames(frames, 1, 3, 2)


def trajectory_totals(spark, d):
    atoms, frames = _frames(spark, d)
    return trajectory.frame_totals(trajectory.frame_areas(atoms, frames, n_points=POINTS, probe=PROBE)).select("structure_id", "frame", *_r("total_sasa"))


def trajectory_residues(spark, d):
    atoms, frames = _frames(spark, d)
    areas = trajectory.frame_areas(atoms, frames, n_points=POINTS, probe=PROBE, carry=("chain", "residue_num"))
    return analysis.dense_residues(areas, ["structure_id", "frame"]).select("structure_id", "frame", "residue_index", *_r("area"))


def sr_routed(spark, d):
    """Areas of atoms by the plan that each structure's size asks for."""
    return _areas(pseudo_atoms(spark, d), by="auto", large=ROUTED).select("structure_id", "atom_index", "exposed", *_r("area"))


def sr_bitmask(spark, d):
    """Areas of atoms from masks, and with the correction."""
    areas = masks.bitmask_areas(pseudo_atoms(spark, d), POINTS, PROBE)
    f = F.col("exposed") / POINTS
    return areas.select("structure_id", "atom_index", "exposed", *_r("area"), F.round(F.when(f > 0, F.col("area") / f).otherwise(0.0) * F.least(F.lit(1.0), f + masks.CORRECTION * f * (1 - f)), 3).alias("corrected"))


def sr_bitmask_corrected(spark, d):
    """Corrected areas of structures from masks."""
    return surface.totals(masks.bitmask_areas(pseudo_atoms(spark, d), POINTS, PROBE, correction=masks.CORRECTION)).select("structure_id", "n_atoms", *_r("total_area"))


def sr_adaptive(spark, d):
    """Areas of atoms in two passes, with the points of the pass that counts."""
    return masks.adaptive_areas(pseudo_atoms(spark, d), COARSE, FINE, LOW, HIGH, PROBE).select("structure_id", "atom_index", "points", "exposed", *_r("area"))


def frame_variants(spark, d):
    """Frame totals from masks in the three modes: one table, a table made for each frame (the same points), and four turned tables in turn."""
    atoms, frames = _frames(spark, d)
    rows, key = trajectory.placed(atoms, frames), ["structure_id", "frame"]
    modes = [("single", {}), ("per-frame", {"variant": F.lit(0), "variants": 1}), ("cycle", {"variant": F.col("frame").cast("int") % masks.VARIANTS, "variants": masks.VARIANTS})]
    out = None
    for mode, options in modes:
        got = masks.bitmask_areas(rows, POINTS, PROBE, key=key, **options).groupBy(*key).agg(F.sum("area").alias("total_sasa")).withColumn("mode", F.lit(mode))
        out = got if out is None else out.unionByName(got)
    return out.select("mode", "structure_id", "frame", *_r("total_sasa"))


_JOBS = """SELECT p_partkey AS job_id, 'SR' AS algorithm, CASE WHEN p_size % 2 = 0 THEN 40 ELSE 60 END AS resolution,
    CAST(CASE WHEN p_partkey % 50 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1.2 ELSE 1.4 END AS DOUBLE) AS probe,
    CASE WHEN p_partkey % 37 = 0 THEN 'Z' ELSE CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N,R' WHEN 2 THEN 'R,N,R' END END AS chain_text FROM part"""


def job_areas(spark, d):
    """Areas of every structure for a job of each part: two resolutions, two probes, some chains or all; a probe of 0 and an unknown chain are error rows."""
    part = spark.read.parquet(f"{d}/part.parquet")
    jobs = spark.sql(_JOBS.replace("FROM part", "FROM {part}"), part=part).withColumn("chains", F.split("chain_text", ","))
    return batch.job_areas(pseudo_atoms(spark, d), jobs).select("structure_id", "job_id", "status", "error", "n_atoms", "n_sharing", *_r("total_area"))


def _faulty(spark, d):
    """Pseudo-atoms of which some structures have a coordinate that is no number, radii below 0, or other chains."""
    x = F.when((F.col("structure_id") % 17 == 3) & (F.col("atom_index") == 5), float("nan")).otherwise(F.col("x"))
    r = F.when((F.col("structure_id") % 13 == 2) & (F.col("atom_index") % 100 == 7), -1.0).otherwise(F.col("radius"))
    return pseudo_atoms(spark, d).withColumns({"x": x, "radius": r, "chain": F.when(F.col("structure_id") % 19 == 4, "Z").otherwise(F.col("chain"))})


def batch_status(spark, d):
    """A batch with faulty structures: an error row for each of them, areas for the others."""
    return batch.batch_areas(_faulty(spark, d), chains=["A", "N"], n_points=POINTS, probe=PROBE).select("structure_id", "status", "error", "n_atoms", *_r("total_area"))


def batch_summary(spark, d):
    return analysis.batch_summary(batch.batch_areas(_faulty(spark, d), chains=["A", "N"], n_points=POINTS, probe=PROBE))


def interface_atoms(spark, d):
    """Atoms of interfaces: points free alone and in the complex, and what is buried."""
    atoms = pseudo_atoms(spark, d)
    return selections.buried_atoms(atoms, _faces(atoms), POINTS, PROBE).select("structure_id", "id", "atom_index", "partner", "isolated", "complex", *_r("isolated_area", "complex_area", "delta"))


def interface_residues(spark, d):
    """Residues of interfaces, their areas and what is buried (not halved)."""
    atoms = pseudo_atoms(spark, d)
    return selections.residue_deltas(selections.buried_atoms(atoms, _faces(atoms), POINTS, PROBE, RESIDUE)).select("structure_id", "id", "partner", "chain", "residue_num", "ins_code", "residue", "n_atoms", *_r("isolated_area", "complex_area", "delta"))


def residue_map_json(spark, d):
    """Result documents of structures with the runs of their residues as arrays."""
    rows = _rows(spark, d, *RESIDUE)
    return sinks.residue_map_rows(analysis.runs(rows), rows.select("structure_id", "atom_index", "area"))


def interface_json(spark, d):
    """Result documents of interfaces with their residues as arrays."""
    atoms = pseudo_atoms(spark, d)
    buried = selections.buried_atoms(atoms, _faces(atoms), POINTS, PROBE, RESIDUE)
    return sinks.interface_rows(selections.interface_areas(atoms, _faces(atoms), n_points=POINTS, probe=PROBE), selections.residue_deltas(buried))


#: Three dictionaries of components made from part that overlap, each with atoms of its own; atoms of a component as in component_radii. The residues of the atoms are part keys of lineitem, those that are multiples of 7 are known.
_SOURCES = {"beside": (2, 0), "inline": (3, 1), "external": (5, 2)}
_NEEDED = "SELECT DISTINCT CAST(l_partkey AS VARCHAR(20)) AS residue FROM lineitem WHERE l_partkey % 11 <> 0"


def _source_sql(name: str, sql: str, extra: str) -> str:
    every, shift = _SOURCES[name]
    sql = sql.replace("p_partkey AS comp_id", f"CAST(p_partkey AS VARCHAR(20)) AS comp_id{extra}").replace("(p_partkey + idx) % 7", f"(p_partkey + idx + {shift}) % 7")
    return f"{sql} WHERE p_partkey % {every} = 0"


def resolved_components(spark, d):
    """Radii of the atoms of needed components from three dictionaries, the last one counting."""
    part, lineitem = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "lineitem"))
    made = {n: tuple(spark.sql(_source_sql(n, q, "").replace("FROM part", "FROM {part}"), part=part) for q in (_COMP_ATOMS, _COMP_BONDS)) for n in _SOURCES}
    atoms = spark.sql(_NEEDED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    known = part.where("p_partkey % 7 = 0").select(F.col("p_partkey").cast("string").alias("residue"))
    return components.resolve(atoms, known, **made).select("residue", "atom_name", "radius", "atom_class", "source")


def frame_results(spark, d):
    """Totals of whole frames, error rows for frames that lack atoms."""
    atoms, frames = _frames(spark, d)
    frames = frames.where(~((F.col("structure_id") % 5 == 2) & (F.col("frame") == 3) & (F.col("atom_index") % 50 == 3)))
    return trajectory.frame_results(atoms, frames, n_points=POINTS, probe=PROBE).select("structure_id", "frame", "n_atoms", "status", "error", *_r("total_sasa"))


def selection_json(spark, d):
    """Result documents of chain selections with what their atoms are, or errors."""
    atoms = pseudo_atoms(spark, d)
    entries, areas = selections.selection_atoms(atoms, _entries(atoms), n_points=POINTS, probe=PROBE, carry=(*RESIDUE, "atom_name", "element"))
    return sinks.selection_rows(entries, areas)


def rsa_lines(spark, d):
    """The lines of the table of absolute and relative areas."""
    return sinks.rsa_lines(analysis.breakdown(_rows(spark, d, *RESIDUE, "atom_name", "element")))


def summary_text(spark, d):
    """A text report on each structure."""
    return sinks.summary_text(surface.totals(_areas(pseudo_atoms(spark, d))), "points", "none", PROBE, ("points", POINTS))


def first_problems(spark, d):
    """The first ten rows of a faulty table that can't be atoms."""
    return schema.first_problems(_faulty(spark, d)).select("structure_id", "atom_index", "problem")


def trajectory_mean(spark, d):
    """Mean area over frames, and their number."""
    atoms, frames = _frames(spark, d)
    return trajectory.mean_total(trajectory.frame_totals(trajectory.frame_areas(atoms, frames, n_points=POINTS, probe=PROBE))).select("structure_id", "n_frames", *_r("mean_sasa"))


QUERIES = {
    f.__name__: f
    for f in (neighbor_degree, sr_atoms, sr_atoms_by_cell, sr_atoms_by_structure, sr_total, lr_total, residue_areas, residue_classes, residue_runs, rsa_table, residue_rsa, polar_summary, class_totals, chain_totals, validation, standard_filters, classified_atoms, match_counts, naccess_atoms, oons_atoms, builtin_counts, element_guess, component_radii, chain_selections, buried_surface, trajectory_totals, trajectory_residues,
              sr_routed, sr_bitmask, sr_bitmask_corrected, sr_adaptive, frame_variants, job_areas, batch_status, batch_summary, interface_atoms, interface_residues, residue_map_json, interface_json, resolved_components, frame_results, first_problems, trajectory_mean, selection_json, rsa_lines, summary_text)
} | {"altloc_auto": _altloc("auto"), "altloc_highest": _altloc("highest-occupancy"), "altloc_selected": _altloc("selected", "B"), "altloc_all": _altloc("all")}


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _case(table: dict, key: str) -> str:
    one = lambda k: f"'{k}'" if isinstance(k, str) else str(k)
    return f"CASE {key} " + " ".join(f"WHEN {one(k)} THEN {_d(v)}" for k, v in table.items()) + " END"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _builtin_sql(name: str, named: str, by_name: str) -> str:
    """A built-in table as ranked candidates of which the first counts: 0 the residue's own, 1 those of ANY, 2 the name's element, 3 the row's radius."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(r)}, {quoted(a)}, {_d(x)}, {quoted(c)})" for r, a, x, c in BUILTIN[name]())
    return f"""(WITH t(r, a, x, c) AS (VALUES {rows}), q AS (SELECT * FROM {named}),
        found AS (SELECT structure_id, atom_index, CASE WHEN r = 'ANY' THEN 1 ELSE 0 END AS rank, t.x, c FROM q JOIN t ON a = atom_name AND r IN (residue, 'ANY')
            UNION ALL SELECT structure_id, atom_index, 2, {by_name}, 'unknown' FROM q WHERE {by_name} IS NOT NULL UNION ALL SELECT structure_id, atom_index, 3, radius, 'unknown' FROM q)
        SELECT structure_id, atom_index, arg_min(x, rank) AS radius, arg_min(c, rank) AS atom_class, CASE min(rank) WHEN 0 THEN 'exact' WHEN 1 THEN 'any' WHEN 2 THEN 'element' ELSE 'original' END AS matched FROM found GROUP BY structure_id, atom_index)"""


def _points(points) -> str:
    return ", ".join(f"({i}, {_d(float(x))}, {_d(float(y))}, {_d(float(z))})" for i, (x, y, z) in enumerate(points))


def _pairs(source: str, keys: str = "structure_id", probe: str = "") -> str:
    """CTEs wide (radius with probe as r) and pairs of a relation of atoms: every ordered pair of neighbours, a the first and b the second."""
    cols = [k.strip() for k in keys.split(",")]
    same, ka = " AND ".join(f"a.{k} = b.{k}" for k in cols), ", ".join(f"a.{k}" for k in cols)
    d2 = " + ".join(f"(a.{k} - b.{k}) * (a.{k} - b.{k})" for k in "xyz")
    return f"""wide AS (SELECT *, radius + {probe or _d(PROBE)} AS r FROM {source}),
    pairs AS MATERIALIZED (SELECT {ka}, a.atom_index, a.x, a.y, a.z, a.r, b.x AS bx, b.y AS by_, b.z AS bz, b.r AS br, b.atom_index AS other FROM wide a JOIN wide b ON {same} AND a.atom_index <> b.atom_index AND {d2} < (a.r + b.r) * (a.r + b.r))"""


def _sr(source: str, keys: str = "structure_id") -> str:
    """CTEs pts, pairs and areas(keys, atom_index, exposed, area) for a relation of atoms."""
    cols = [k.strip() for k in keys.split(",")]
    ka = ", ".join(f"a.{k}" for k in cols)
    at = " + ".join(f"(({c} + r * p{c}) - {o}) * (({c} + r * p{c}) - {o})" for c, o in (("x", "bx"), ("y", "by_"), ("z", "bz")))
    return f"""pts(k, px, py, pz) AS (VALUES {_points(sphere_points(POINTS))}), {_pairs(source, keys)},
    buried AS (SELECT DISTINCT {keys}, atom_index, k FROM pairs, pts WHERE {at} < br * br),
    areas AS (SELECT {ka}, a.atom_index, {POINTS} - count(b.k) AS exposed, any_value({_d(12.566370614359172)} * a.r * a.r) * ({POINTS} - count(b.k)) / {POINTS} AS area
              FROM wide a LEFT JOIN buried b ON {" AND ".join(f"a.{k} = b.{k}" for k in cols)} AND a.atom_index = b.atom_index GROUP BY {ka}, a.atom_index)"""


def _masked(name: str, points: list, keys: str = "structure_id", variant: str = "0", only: str = "TRUE") -> str:
    """CTE name(keys, atom_index, r, exposed) from the pairs: without masks, each point held against the middle of the neighbour's direction bin and the cosine of its angle bin. points: of each variant."""
    cols = [k.strip() for k in keys.split(",")]
    n, side, top = len(points[0]), masks.SIDE, masks.ANGLES - 1
    ka, same = ", ".join(f"a.{k}" for k in cols), " AND ".join(f"a.{k} = b.{k}" for k in cols)
    values = ", ".join(f"({v}, {i}, {_d(float(x))}, {_d(float(y))}, {_d(float(z))})" for v, p in enumerate(points) for i, (x, y, z) in enumerate(p))
    fold = lambda c, o: f"CASE WHEN dz < 0 THEN (1 - abs({o})) * CASE WHEN {c} >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE {c} END"
    cell = lambda c: f"CAST(floor(least(greatest(({c} + 1) * 0.5::DOUBLE * {side}, 0.0::DOUBLE), {side - 1}.0::DOUBLE)) AS INT)"
    middle = lambda c: f"({c} + 0.5::DOUBLE) / {side} * 2 - 1"
    return f"""{name}_p(variant, k, px, py, pz) AS (VALUES {values}),
    {name}_1 AS (SELECT {keys}, atom_index, r, br, bx - x AS dx, by_ - y AS dy, bz - z AS dz, sqrt((bx - x) * (bx - x) + (by_ - y) * (by_ - y) + (bz - z) * (bz - z)) AS d, {variant} AS variant FROM pairs WHERE {only}),
    {name}_2 AS (SELECT *, (r * r + d * d - br * br) / (2 * r * d) AS cosine, abs(dx) + abs(dy) + abs(dz) AS l1 FROM {name}_1 WHERE d >= 1e-10),
    {name}_3 AS (SELECT *, {fold('u', 'v')} AS fu, {fold('v', 'u')} AS fv FROM (SELECT *, dx / l1 AS u, dy / l1 AS v FROM {name}_2 WHERE cosine < 1) AS q),
    {name}_4 AS (SELECT {keys}, atom_index, variant, cosine <= -1 AS hidden, {middle(cell('fu'))} AS mu, {middle(cell('fv'))} AS mv, floor(least(greatest((cosine + 1) * 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) * {top} + 0.5::DOUBLE) / {top} * 2 - 1 AS least_cos FROM {name}_3),
    {name}_5 AS (SELECT *, 1 - abs(mu) - abs(mv) AS mz FROM {name}_4),
    {name}_6 AS (SELECT * EXCLUDE (mu, mv), CASE WHEN mz < 0 THEN (1 - abs(mv)) * CASE WHEN mu >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE mu END AS mu, CASE WHEN mz < 0 THEN (1 - abs(mu)) * CASE WHEN mv >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE mv END AS mv FROM {name}_5),
    {name}_7 AS (SELECT {keys}, atom_index, variant, hidden, least_cos, mu / sqrt(mu * mu + mv * mv + mz * mz) AS ex, mv / sqrt(mu * mu + mv * mv + mz * mz) AS ey, mz / sqrt(mu * mu + mv * mv + mz * mz) AS ez FROM {name}_6),
    {name}_8 AS (SELECT {keys}, atom_index, count(DISTINCT CASE WHEN hidden OR px * ex + py * ey + pz * ez >= least_cos THEN k END) AS covered FROM {name}_7 JOIN {name}_p USING (variant) GROUP BY {keys}, atom_index),
    {name} AS (SELECT {ka}, a.atom_index, a.r, {n} - coalesce(covered, 0) AS exposed FROM wide a LEFT JOIN {name}_8 b ON {same} AND a.atom_index = b.atom_index)"""


def component_radii_sql(comp_atoms: str, comp_bonds: str) -> str:
    return f"""WITH atoms AS ({comp_atoms}), bonds AS ({comp_bonds}), ends AS (SELECT comp_id, atom_idx_1 AS idx, atom_idx_2 AS other, bond_order, aromatic FROM bonds UNION ALL SELECT comp_id, atom_idx_2, atom_idx_1, bond_order, aromatic FROM bonds),
            b AS (SELECT e.comp_id, e.idx, count(*) FILTER (WHERE o.type_symbol <> 'H') AS heavy_bonds, coalesce(sum(CASE bond_order WHEN 'TRIP' THEN 3 WHEN 'DOUB' THEN 2 WHEN 'AROM' THEN 2 ELSE 1 END) FILTER (WHERE o.type_symbol <> 'H'), 0) AS heavy_valence, count(*) FILTER (WHERE o.type_symbol = 'H') AS h_bonds, bool_or(bond_order = 'TRIP') AS triple, bool_or(bond_order IN ('DOUB', 'AROM') OR aromatic) AS flat
                  FROM ends e JOIN atoms o ON e.comp_id = o.comp_id AND e.other = o.idx GROUP BY e.comp_id, e.idx),
            r AS (SELECT a.*, coalesce(heavy_bonds, 0) AS heavy_bonds, coalesce(heavy_valence, 0)::BIGINT AS heavy_valence, coalesce(h_bonds, 0) AS h_bonds, CASE WHEN triple THEN 'sp' WHEN flat THEN 'sp2' WHEN heavy_bonds + h_bonds > 0 THEN 'sp3' ELSE 'unknown' END AS hybridization, CASE type_symbol WHEN 'C' THEN 4 WHEN 'N' THEN 3 WHEN 'O' THEN 2 WHEN 'S' THEN 2 END AS usual FROM atoms a LEFT JOIN b ON a.comp_id = b.comp_id AND a.idx = b.idx),
            i AS (SELECT *, coalesce(greatest(usual - heavy_valence - h_bonds, 0) + 0 * usual, 0) AS implicit_h FROM r)
            SELECT comp_id, idx, atom_id, heavy_bonds, heavy_valence, h_bonds, hybridization, implicit_h, CAST(CASE type_symbol WHEN 'C' THEN CASE hybridization WHEN 'sp2' THEN CASE implicit_h WHEN 0 THEN 1.61 ELSE 1.76 END WHEN 'sp3' THEN CASE implicit_h WHEN 0 THEN 1.61 ELSE 1.88 END WHEN 'sp' THEN 1.61 ELSE 1.88 END WHEN 'N' THEN 1.64 WHEN 'O' THEN CASE hybridization WHEN 'sp3' THEN 1.46 ELSE 1.42 END WHEN 'S' THEN 1.77 END AS DOUBLE) AS radius,
                CASE WHEN type_symbol IN ('N', 'O', 'S') THEN 'polar' WHEN type_symbol = 'C' THEN 'apolar' ELSE 'unknown' END AS atom_class FROM i"""


def _resolved_sql(radii) -> str:
    """Every dictionary's components under a name that holds the source, then the last source of each atom."""
    both = [" UNION ALL ".join(_source_sql(n, q, "").replace("CAST(p_partkey AS VARCHAR(20)) AS comp_id", f"'{n}|' || CAST(p_partkey AS VARCHAR(20)) AS comp_id") for n in _SOURCES) for q in (_COMP_ATOMS, _COMP_BONDS)]
    order = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(_SOURCES))
    return f"""SELECT residue, atom_name, arg_max(radius, prio) AS radius, arg_max(atom_class, prio) AS atom_class, arg_max(source, prio) AS source
        FROM (SELECT split_part(comp_id, '|', 2) AS residue, atom_id AS atom_name, radius, atom_class, split_part(comp_id, '|', 1) AS source, CASE split_part(comp_id, '|', 1) {order} END AS prio FROM ({radii(*both)}) AS q WHERE radius IS NOT NULL) AS t
        WHERE residue IN ({_NEEDED}) AND CAST(residue AS BIGINT) % 7 <> 0 GROUP BY residue, atom_name"""


def _job_sql() -> str:
    at = " + ".join(f"(({c} + r * p{c}) - {o}) * (({c} + r * p{c}) - {o})" for c, o in (("x", "bx"), ("y", "by_"), ("z", "bz")))
    values = ", ".join(f"({n}, {i}, {_d(float(x))}, {_d(float(y))}, {_d(float(z))})" for n in (40, 60) for i, (x, y, z) in enumerate(sphere_points(n)))
    return f"""WITH atoms AS ({ATOMS_SQL}), jobs AS (SELECT *, CASE WHEN probe = 0 THEN 'probe out of range' END AS bad, list_sort(list_distinct(string_split(chain_text, ','))) AS chains FROM ({_JOBS}) AS q),
        w AS (SELECT resolution, probe, chains, count(*) AS n, resolution || '|' || probe || '|' || coalesce(array_to_string(chains, ','), '*') AS c FROM jobs WHERE bad IS NULL GROUP BY resolution, probe, chains),
        picked AS (SELECT a.*, w.c, w.probe, w.resolution FROM atoms a JOIN w ON w.chains IS NULL OR list_contains(w.chains, a.chain)), {_pairs('picked', 'structure_id, c', 'probe')},
        pts(resolution, k, px, py, pz) AS (VALUES {values}), near AS (SELECT p.*, w.resolution FROM pairs p JOIN w USING (c)),
        buried AS (SELECT structure_id, c, atom_index, count(DISTINCT k) AS n FROM near JOIN pts USING (resolution) WHERE {at} < br * br GROUP BY structure_id, c, atom_index),
        t AS (SELECT a.structure_id, a.c, count(*) AS n_atoms, sum({_d(12.566370614359172)} * a.r * a.r * (a.resolution - coalesce(b.n, 0)) / a.resolution) AS area FROM wide a LEFT JOIN buried b ON a.structure_id = b.structure_id AND a.c = b.c AND a.atom_index = b.atom_index GROUP BY a.structure_id, a.c)
        SELECT s.structure_id, j.job_id, CASE WHEN coalesce(j.bad, CASE WHEN t.n_atoms IS NULL THEN 'no atoms' END) IS NULL THEN 'ok' ELSE 'err' END AS status, coalesce(j.bad, CASE WHEN t.n_atoms IS NULL THEN 'no atoms' END) AS error, t.n_atoms, coalesce(w.n, 0) AS n_sharing, round(t.area, 3) AS total_area
        FROM (SELECT DISTINCT structure_id FROM atoms) AS s JOIN jobs j ON TRUE LEFT JOIN w ON j.bad IS NULL AND w.resolution = j.resolution AND w.probe = j.probe AND w.chains IS NOT DISTINCT FROM j.chains LEFT JOIN t ON t.structure_id = s.structure_id AND t.c = w.c"""


def oracle() -> dict[str, str]:
    atoms = f"WITH atoms AS ({ATOMS_SQL})"
    sr = f"{atoms}, {_sr('atoms')}, rows_ AS (SELECT a.*, area FROM atoms a JOIN areas USING (structure_id, atom_index))"
    rnd = lambda *names: ", ".join(f"round(sum({n}), 3) AS {n}" for n in names)
    exact = [c for c in CLASSES if c[0] != "ANY"]
    anyone = [c for c in CLASSES if c[0] == "ANY"]
    pick = lambda i, show: "CASE " + " ".join(f"WHEN residue = '{r[0]}' AND atom_name = '{r[1]}' THEN {show(r[i])}" for r in exact) + " " + " ".join(f"WHEN atom_name = '{r[1]}' THEN {show(r[i])}" for r in anyone)
    is_exact = " OR ".join(f"(residue = '{r[0]}' AND atom_name = '{r[1]}')" for r in exact)
    guess = f"coalesce({_case(RADIUS_BY_NUMBER, 'element')}, {_case(RADIUS_BY_SYMBOL, 'symbol')})"
    two = _in(s for s in RADIUS_BY_SYMBOL if len(s) == 2)
    named = f"(SELECT *, CASE WHEN length(atom_name) >= 2 AND substring(atom_name, 1, 2) IN {two} THEN substring(atom_name, 1, 2) ELSE substring(atom_name, 1, 1) END AS symbol FROM atoms)"
    classes = f"""cls AS (SELECT * EXCLUDE (radius), {pick(2, _d)} ELSE coalesce({guess}, radius) END AS radius, {pick(3, lambda v: f"'{v}'")} ELSE 'unknown' END AS atom_class,
        CASE WHEN {is_exact} THEN 'exact' WHEN atom_name IN {_in(r[1] for r in anyone)} THEN 'any' WHEN {guess} IS NOT NULL THEN 'element' ELSE 'original' END AS matched FROM {named})"""
    csr = f"{atoms}, {classes}, {_sr('cls')}, rows_ AS (SELECT a.*, area FROM cls a JOIN areas USING (structure_id, atom_index))"
    residues = "SELECT structure_id, chain, residue_num, ins_code, arg_min(residue, atom_index) AS residue, min(atom_index) AS first_atom, count(*) AS n_atoms, sum(area) AS area FROM rows_ GROUP BY structure_id, chain, residue_num, ins_code"
    site = "structure_id, model_num, residue_num, chain, residue, ins_code, atom_name"
    main, polar = "atom_name IN ('N', 'CA', 'C', 'O', 'OXT')", "element IN (7, 8, 15, 16)"
    split = f"sum(area) AS total, sum(CASE WHEN {main} THEN 0 ELSE area END) AS side, sum(CASE WHEN {main} THEN area ELSE 0 END) AS main, sum(CASE WHEN {polar} THEN 0 ELSE area END) AS apolar, sum(CASE WHEN {polar} THEN area ELSE 0 END) AS polar"
    five = ", ".join(f"round({n}, 3) AS {n}" for n in ("total", "side", "main", "apolar", "polar"))
    degree = "SELECT a.structure_id, a.atom_index, count(b.atom_index) AS degree FROM w a LEFT JOIN w b ON a.structure_id = b.structure_id AND a.atom_index <> b.atom_index AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < (a.r + b.r) * (a.r + b.r) GROUP BY a.structure_id, a.atom_index"
    frames = f"{atoms}, moved AS (SELECT a.* EXCLUDE (x), a.x + frame * (atom_index % 5) * {_d(0.0625)} AS x, frame FROM atoms a JOIN (VALUES (1), (3)) AS f(frame) ON TRUE), {_sr('moved', 'structure_id, frame')}"
    sets = f"{atoms}, picked AS (SELECT a.*, s.s FROM atoms a JOIN (VALUES ('A', 'an'), ('N', 'an'), ('R', 'r')) AS s(chain, s) USING (chain)), {_sr('picked', 'structure_id, s')}, tot AS (SELECT structure_id, s, sum(area) AS area, count(*) AS n FROM areas GROUP BY structure_id, s)"
    faces = f"{atoms}, picked AS (SELECT a.*, s.s FROM atoms a JOIN (VALUES ('A', 'a'), ('R', 'b'), ('A', 'ab'), ('R', 'ab')) AS s(chain, s) USING (chain)), {_sr('picked', 'structure_id, s')}, tot AS (SELECT structure_id, sum(CASE WHEN s = 'a' THEN area ELSE 0 END) AS a, sum(CASE WHEN s = 'b' THEN area ELSE 0 END) AS b, sum(CASE WHEN s = 'ab' THEN area ELSE 0 END) AS ab FROM areas GROUP BY structure_id), there AS (SELECT structure_id, bool_or(chain = 'A') AS has_a, bool_or(chain = 'R') AS has_b FROM atoms GROUP BY structure_id)"
    face = lambda e, n, k: f"CASE WHEN has_a AND has_b THEN round({e}, {k}) END AS {n}"
    two_pi = _d(6.283185307179586)
    ball, f = f"{_d(12.566370614359172)} * r * r", f"(exposed::DOUBLE / {POINTS})"
    corrected = f"least(1.0::DOUBLE, {f} + {_d(masks.CORRECTION)} * {f} * (1 - {f}))"
    moved = f"{atoms}, moved AS (SELECT a.* EXCLUDE (x), a.x + frame * (atom_index % 5) * {_d(0.0625)} AS x, frame FROM atoms a JOIN (VALUES (1), (3)) AS f(frame) ON TRUE)"
    runs = f"""{sr}, marked AS (SELECT *, CASE WHEN atom_index > 0 AND (chain, residue_num, residue, ins_code) = (lag(chain) OVER o, lag(residue_num) OVER o, lag(residue) OVER o, lag(ins_code) OVER o) THEN 0 ELSE 1 END AS new FROM rows_ WINDOW o AS (PARTITION BY structure_id ORDER BY atom_index)),
            numbered AS (SELECT *, sum(new) OVER (PARTITION BY structure_id ORDER BY atom_index) - 1 AS run FROM marked)"""
    faulty = f"""{atoms}, odd AS (SELECT structure_id, min(CASE WHEN structure_id % 17 = 3 AND atom_index = 5 THEN atom_index END) AS nan, min(CASE WHEN structure_id % 13 = 2 AND atom_index % 100 = 7 THEN atom_index END) AS low FROM atoms GROUP BY structure_id),
            picked AS (SELECT * FROM atoms WHERE chain IN ('A', 'N') AND structure_id % 19 <> 4 AND structure_id NOT IN (SELECT structure_id FROM odd WHERE nan IS NOT NULL OR low IS NOT NULL)), {_sr('picked')},
            b AS (SELECT structure_id, CASE WHEN nan IS NOT NULL AND (low IS NULL OR nan < low) THEN 'coordinate is not finite at atom ' || nan WHEN low IS NOT NULL THEN 'radius out of range at atom ' || low WHEN n IS NULL THEN 'no atoms' END AS error, n, t
                  FROM odd LEFT JOIN (SELECT structure_id, count(*) AS n, sum(area) AS t FROM areas GROUP BY structure_id) AS q USING (structure_id))"""
    sided = f"{faces}, sided AS (SELECT structure_id, atom_index, max(CASE WHEN s = 'ab' THEN NULL ELSE s END) AS partner, max(CASE WHEN s <> 'ab' THEN exposed END) AS isolated, max(CASE WHEN s = 'ab' THEN exposed END) AS complex, max(CASE WHEN s <> 'ab' THEN area END) AS ia, max(CASE WHEN s = 'ab' THEN area END) AS ca FROM areas GROUP BY structure_id, atom_index)"
    return {
        "neighbor_degree": f"{atoms}, w AS (SELECT *, radius + {_d(PROBE)} AS r FROM atoms) {degree}",
        "sr_atoms": f"{sr} SELECT structure_id, atom_index, exposed, round(area, 3) AS area FROM areas",
        "sr_atoms_by_cell": f"{sr} SELECT structure_id, atom_index, exposed, round(area, 3) AS area FROM areas",
        "sr_atoms_by_structure": f"{sr} SELECT structure_id, atom_index, exposed, round(area, 3) AS area FROM areas",
        "sr_total": f"{sr} SELECT structure_id, count(*) AS n_atoms, round(sum(area), 3) AS total_area FROM areas GROUP BY structure_id",
        "lr_total": f"""{atoms}, {_pairs("atoms")},
            c AS (SELECT structure_id, atom_index, k, r, z, z - r + 2 * r / {SLICES} * (k + {_d(0.5)}) AS h, bz, br, sqrt((bx - x) * (bx - x) + (by_ - y) * (by_ - y)) AS d, atan2(by_ - y, bx - x) + pi() AS mid FROM pairs, range({SLICES}) AS v(k)),
            n AS (SELECT structure_id, atom_index, k, sqrt(greatest(0, r * r - (h - z) * (h - z))) AS own, sqrt(br * br - (h - bz) * (h - bz)) AS other, d, mid FROM c WHERE br * br - (h - bz) * (h - bz) > 0),
            m AS (SELECT *, CASE WHEN d < 1e-10 THEN other > own ELSE d + own <= other END AS inside FROM n WHERE d < own + other),
            arcs AS (SELECT structure_id, atom_index, k, mid - a AS lo, mid + a AS hi FROM (SELECT *, acos(greatest(-1, least(1, (own * own + d * d - other * other) / (2 * own * d)))) AS a FROM m WHERE NOT inside AND d >= 1e-10 AND d + other > own) AS q),
            fixed AS (SELECT structure_id, atom_index, k, CASE WHEN lo < 0 THEN lo + {two_pi} ELSE lo END AS lo, CASE WHEN hi > {two_pi} THEN hi - {two_pi} ELSE hi END AS hi FROM arcs),
            cut AS (SELECT structure_id, atom_index, k, lo, CASE WHEN lo > hi THEN {two_pi} ELSE hi END AS hi FROM fixed UNION ALL SELECT structure_id, atom_index, k, 0, hi FROM fixed WHERE lo > hi),
            swept AS (SELECT structure_id, atom_index, k, lo, hi, max(hi) OVER (PARTITION BY structure_id, atom_index, k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cut),
            free AS (SELECT structure_id, atom_index, k, sum(greatest(0, lo - coalesce(before, 0))) + {two_pi} - max(hi) AS arc FROM swept GROUP BY structure_id, atom_index, k),
            shut AS (SELECT DISTINCT structure_id, atom_index, k, {_d(0.0)} AS arc FROM m WHERE inside),
            lost AS (SELECT structure_id, atom_index, sum({two_pi} - arc) AS arc FROM (SELECT * FROM shut UNION ALL SELECT * FROM free ANTI JOIN shut USING (structure_id, atom_index, k)) AS q GROUP BY structure_id, atom_index)
            SELECT w.structure_id, count(*) AS n_atoms, round(sum(4 * pi() * r * r - 2 * r / {SLICES} * r * coalesce(arc, 0)), 2) AS total_area FROM wide w LEFT JOIN lost USING (structure_id, atom_index) GROUP BY w.structure_id""",
        "residue_areas": f"{sr} SELECT * EXCLUDE (area), round(area, 3) AS area FROM ({residues}) AS q",
        "residue_classes": f"{csr} SELECT structure_id, chain, residue_num, arg_min(residue, atom_index) AS residue, count(*) AS n_atoms, {rnd('area')}, round(sum(CASE WHEN atom_class = 'polar' THEN area ELSE 0 END), 3) AS polar_area, round(sum(CASE WHEN atom_class = 'apolar' THEN area ELSE 0 END), 3) AS apolar_area FROM rows_ GROUP BY structure_id, chain, residue_num",
        "residue_runs": f"""{sr}, marked AS (SELECT *, CASE WHEN atom_index > 0 AND (chain, residue_num, residue, ins_code) = (lag(chain) OVER o, lag(residue_num) OVER o, lag(residue) OVER o, lag(ins_code) OVER o) THEN 0 ELSE 1 END AS new FROM rows_ WINDOW o AS (PARTITION BY structure_id ORDER BY atom_index)),
            numbered AS (SELECT *, sum(new) OVER (PARTITION BY structure_id ORDER BY atom_index) - 1 AS run FROM marked)
            SELECT structure_id, run::BIGINT AS run, chain, residue_num, residue, ins_code, min(atom_index) AS atom_start, count(*) AS atom_count, {rnd('area')} FROM numbered GROUP BY structure_id, run, chain, residue_num, residue, ins_code""",
        "rsa_table": f"{sr}, f AS (SELECT structure_id, chain, residue, residue_num, ins_code, {split}, 0 AS level FROM rows_ GROUP BY structure_id, chain, residue, residue_num, ins_code UNION ALL SELECT structure_id, chain, NULL, NULL, NULL, {split}, 1 FROM rows_ GROUP BY structure_id, chain UNION ALL SELECT structure_id, NULL, NULL, NULL, NULL, {split}, 2 FROM rows_ GROUP BY structure_id) SELECT structure_id, chain, residue, residue_num, ins_code, level, {five} FROM f",
        "residue_rsa": f"{sr} SELECT structure_id, chain, residue_num, ins_code, residue, round(area / {_case(MAX_SASA, 'residue')}, 5) AS rsa FROM ({residues}) AS q",
        "polar_summary": f"""{sr}, q AS (SELECT structure_id, CASE WHEN residue IN {_in(POLAR)} THEN 1 WHEN residue IN {_in(NONPOLAR)} THEN 2 ELSE 3 END AS c, area FROM ({residues}) AS q),
            t AS (SELECT structure_id, count(*) FILTER (WHERE c = 1) AS n_polar, count(*) FILTER (WHERE c = 2) AS n_nonpolar, count(*) FILTER (WHERE c = 3) AS n_unknown, sum(CASE WHEN c = 1 THEN area ELSE 0 END) AS p, sum(CASE WHEN c = 2 THEN area ELSE 0 END) AS n, sum(CASE WHEN c = 3 THEN area ELSE 0 END) AS u FROM q GROUP BY structure_id)
            SELECT structure_id, n_polar, n_nonpolar, n_unknown, round(p, 3) AS polar_area, round(n, 3) AS nonpolar_area, round(u, 3) AS unknown_area, CASE WHEN p + n > 0 THEN round(p / (p + n), 3) ELSE 0 END AS polar_fraction, CASE WHEN p + n > 0 THEN round(n / (p + n), 3) ELSE 0 END AS nonpolar_fraction FROM t""",
        "class_totals": f"{csr} SELECT structure_id, round(sum(area), 3) AS total_area, round(sum(CASE WHEN atom_class = 'polar' THEN area ELSE 0 END), 3) AS polar_area, round(sum(CASE WHEN atom_class = 'apolar' THEN area ELSE 0 END), 3) AS apolar_area FROM rows_ GROUP BY structure_id",
        "chain_totals": f"{sr} SELECT structure_id, chain, count(*) AS n_atoms, {rnd('area')} FROM rows_ GROUP BY structure_id, chain",
        "validation": f"{atoms} SELECT structure_id, count(*) AS n_atoms, count(*) FILTER (WHERE radius <= 0 OR radius > 100) AS n_problems, count(*) - count(DISTINCT (x, y, z)) AS n_duplicates FROM atoms GROUP BY structure_id",
        "standard_filters": f"{atoms} SELECT structure_id, atom_index, row_number() OVER (PARTITION BY structure_id ORDER BY atom_index) - 1 AS source_atom_index FROM atoms WHERE record = 'ATOM' AND element <> 1 AND model_num = 2 AND chain IN ('A', 'N')",
        "classified_atoms": f"{atoms}, {classes} SELECT structure_id, atom_index, radius, atom_class, matched FROM cls",
        **{f"{n}_atoms": f"{atoms} SELECT * FROM {_builtin_sql(n, named, _case(RADIUS_BY_SYMBOL, 'symbol'))} AS f" for n in BUILTIN},
        "builtin_counts": f"{atoms} " + " UNION ALL ".join(f"SELECT '{n}' AS classifier, structure_id, matched, count(*) AS n_atoms FROM {_builtin_sql(n, named, _case(RADIUS_BY_SYMBOL, 'symbol'))} AS f GROUP BY structure_id, matched" for n in BUILTIN),
        "match_counts": f"{atoms}, {classes} SELECT structure_id, matched, count(*) AS n_atoms FROM cls GROUP BY structure_id, matched",
        "element_guess": f"{atoms} SELECT DISTINCT atom_name, element, symbol, {guess} AS radius FROM {named} AS q",
        "component_radii": component_radii_sql(_COMP_ATOMS, _COMP_BONDS),
        "chain_selections": f"""{sets}, e AS (SELECT DISTINCT structure_id FROM atoms), have AS (SELECT DISTINCT structure_id, chain FROM atoms)
            SELECT e.structure_id, q.id, CASE WHEN h.n = q.need THEN t.n END AS n_atoms, CASE WHEN h.n = q.need THEN 'ok' ELSE 'err' END AS status, CASE WHEN h.n = q.need THEN NULL ELSE 'selected chain not found: ' || h.lacks END AS error, CASE WHEN h.n = q.need THEN round(t.area, 3) END AS total_area
            FROM e JOIN (VALUES ('an', 'an', 2), ('na', 'an', 2), ('r', 'r', 1), ('z', 'z', 1)) AS q(id, s, need) ON TRUE
            JOIN (SELECT e.structure_id, c.s, count(have.chain) AS n, min(CASE WHEN have.chain IS NULL THEN c.chain END) AS lacks FROM e JOIN (VALUES ('A', 'an'), ('N', 'an'), ('R', 'r'), ('Z', 'z')) AS c(chain, s) ON TRUE LEFT JOIN have ON have.structure_id = e.structure_id AND have.chain = c.chain GROUP BY e.structure_id, c.s) AS h ON h.structure_id = e.structure_id AND h.s = q.s
            LEFT JOIN tot t ON t.structure_id = e.structure_id AND t.s = q.s""",
        "buried_surface": f"{faces} SELECT t.structure_id, 'a-r' AS id, CASE WHEN NOT has_a THEN 'partner A chain not found' WHEN NOT has_b THEN 'partner B chain not found' END AS error, {face('a', 'sasa_partner_a', 3)}, {face('b', 'sasa_partner_b', 3)}, {face('ab', 'sasa_complex', 3)}, {face('a + b - ab', 'delta_sasa_total', 3)}, {face('(a + b - ab) / 2', 'bsa', 2)} FROM there t LEFT JOIN tot USING (structure_id)",
        "trajectory_totals": f"{frames} SELECT structure_id, frame, round(sum(area), 3) AS total_sasa FROM areas GROUP BY structure_id, frame",
        "trajectory_residues": f"{frames}, ids AS (SELECT structure_id, chain, residue_num, row_number() OVER (PARTITION BY structure_id ORDER BY chain, residue_num) - 1 AS residue_index FROM (SELECT DISTINCT structure_id, chain, residue_num FROM atoms) AS q) SELECT structure_id, frame, residue_index, {rnd('area')} FROM areas JOIN atoms USING (structure_id, atom_index) JOIN ids USING (structure_id, chain, residue_num) GROUP BY structure_id, frame, residue_index",
        "first_problems": f"{atoms} SELECT structure_id, atom_index, CASE WHEN structure_id % 17 = 3 AND atom_index = 5 THEN 'coordinate is not finite' ELSE 'radius out of range' END AS problem FROM atoms WHERE structure_id % 17 = 3 AND atom_index = 5 OR structure_id % 13 = 2 AND atom_index % 100 = 7 ORDER BY structure_id, atom_index LIMIT 10",
        "frame_results": f"""{frames}, size AS (SELECT structure_id, count(*) AS n, count(*) FILTER (WHERE atom_index % 50 = 3) AS gone FROM atoms GROUP BY structure_id)
            SELECT structure_id, frame, any_value(n - CASE WHEN structure_id % 5 = 2 AND frame = 3 THEN gone ELSE 0 END) AS n_atoms, CASE WHEN structure_id % 5 = 2 AND frame = 3 THEN 'err' ELSE 'ok' END AS status,
                CASE WHEN structure_id % 5 = 2 AND frame = 3 THEN any_value((n - gone) || ' of ' || n || ' atoms') END AS error, CASE WHEN structure_id % 5 = 2 AND frame = 3 THEN NULL ELSE round(sum(area), 3) END AS total_sasa
            FROM areas JOIN size USING (structure_id) GROUP BY structure_id, frame""",
        "selection_json": f"""{sets}, e AS (SELECT DISTINCT structure_id FROM atoms), have AS (SELECT structure_id, list(DISTINCT chain) AS c FROM atoms GROUP BY structure_id),
            l AS (SELECT structure_id, s, round(sum(area), 3) AS total, list(round(area, 3) ORDER BY atom_index) AS ar, list(atom_index ORDER BY atom_index) AS ix, list(chain ORDER BY atom_index) AS ch, list(residue ORDER BY atom_index) AS na, list(residue_num ORDER BY atom_index) AS nu, list(ins_code ORDER BY atom_index) AS ic, list(atom_name ORDER BY atom_index) AS an, list(element ORDER BY atom_index) AS el
                  FROM areas JOIN atoms USING (structure_id, atom_index) GROUP BY structure_id, s),
            q AS (SELECT e.structure_id, v.*, list_sort(list_filter(chains, lambda x: NOT list_contains(have.c, x))) AS missing FROM e JOIN have USING (structure_id) JOIN (VALUES ('an', 'an', ['A', 'N']), ('na', 'an', ['N', 'A']), ('r', 'r', ['R']), ('z', 'z', ['Z'])) AS v(id, s, chains) ON TRUE)
            SELECT structure_id, id, CASE WHEN len(missing) = 0 THEN CAST(to_json({{'status': 'ok', 'filename': structure_id::VARCHAR, 'id': id, 'chains': chains, 'total_area': total, 'atom_areas': ar, 'source_atom_index': ix, 'atom_chain': ch, 'atom_residue_name': na, 'atom_residue_number': nu, 'atom_insertion_code': ic, 'atom_name': an, 'atom_element': el}}) AS VARCHAR)
                ELSE CAST(to_json({{'status': 'err', 'filename': structure_id::VARCHAR, 'id': id, 'chains': chains, 'error': 'selected chain not found: ' || missing[1]}}) AS VARCHAR) END AS value FROM q LEFT JOIN l USING (structure_id, s)""",
        "rsa_lines": f"""{sr}, r AS (SELECT structure_id, chain, residue, residue_num, ins_code, {split}, min(atom_index) AS f FROM rows_ GROUP BY structure_id, chain, residue, residue_num, ins_code),
            c AS (SELECT structure_id, chain, {', '.join(f'sum({n}) AS {n}' for n in ('total', 'side', 'main', 'apolar', 'polar'))}, row_number() OVER (PARTITION BY structure_id ORDER BY min(f)) AS no FROM r GROUP BY structure_id, chain),
            t AS (SELECT structure_id, {', '.join(f'sum({n}) AS {n}' for n in ('total', 'side', 'main', 'apolar', 'polar'))} FROM c GROUP BY structure_id)
            SELECT structure_id, (f + 10)::BIGINT AS place, printf('RES %3s %3s %-4s ', residue, chain, residue_num || ins_code) || printf('%7.2f%6.1f', total, 100 * total / {_case(MAX_SASA, 'residue')}) || printf('%7.2f   N/A%7.2f   N/A%7.2f   N/A%7.2f   N/A', side, main, apolar, polar) AS value FROM r
            UNION ALL SELECT structure_id, {1 << 40} + no, printf('CHAIN%3d %3s %10.1f   %10.1f   %10.1f   %10.1f   %10.1f', no, chain, total, side, main, apolar, polar) FROM c
            UNION ALL SELECT structure_id, {2 << 40} + 1, printf('TOTAL        %10.1f   %10.1f   %10.1f   %10.1f   %10.1f', total, side, main, apolar, polar) FROM t
            UNION ALL SELECT structure_id, p, CASE n WHEN 0 THEN 'REM  Absolute and relative areas of ' || structure_id ELSE v END FROM t JOIN (VALUES (0, 0, ''), (1, 1, 'REM RES _ NUM      All-atoms   Total-Side   Main-Chain    Non-polar    All polar'),
                (2, 2, 'REM                ABS   REL    ABS   REL    ABS   REL    ABS   REL    ABS   REL'), (3, {1 << 40}, 'END  Absolute sums over single chains surface'), (4, {2 << 40}, 'END  Absolute sums over all chains')) AS h(n, p, v) ON TRUE""",
        "summary_text": f"{sr} SELECT structure_id, 'PARAMETERS' || chr(10) || 'algorithm    : points' || chr(10) || 'classifier   : none' || chr(10) || 'probe-radius : 1.40' || chr(10) || 'points       : {POINTS}' || chr(10) || 'input        : ' || structure_id || chr(10) || chr(10) || 'RESULTS (A^2)' || chr(10) || printf('Total   : %10.2f', sum(area)) AS value FROM areas GROUP BY structure_id",
        "trajectory_mean": f"{frames} SELECT structure_id, count(*) AS n_frames, round(avg(s), 3) AS mean_sasa FROM (SELECT structure_id, frame, sum(area) AS s FROM areas GROUP BY structure_id, frame) AS q GROUP BY structure_id",
        "sr_routed": f"{sr} SELECT structure_id, atom_index, exposed, round(area, 3) AS area FROM areas",
        "sr_bitmask": f"{atoms}, {_pairs('atoms')}, {_masked('m', [sphere_points(POINTS)])} SELECT structure_id, atom_index, exposed, round({ball} * exposed / {POINTS}, 3) AS area, round({ball} * {corrected}, 3) AS corrected FROM m",
        "sr_bitmask_corrected": f"{atoms}, {_pairs('atoms')}, {_masked('m', [sphere_points(POINTS)])} SELECT structure_id, count(*) AS n_atoms, round(sum({ball} * {corrected}), 3) AS total_area FROM m GROUP BY structure_id",
        "sr_adaptive": f"""{atoms}, {_pairs('atoms')}, {_masked('m', [sphere_points(COARSE)])}, open_ AS (SELECT structure_id, atom_index FROM m WHERE exposed > {LOW} * {COARSE} AND exposed < {HIGH} * {COARSE}),
            {_masked('f', [sphere_points(FINE)], only="(structure_id, atom_index) IN (SELECT (structure_id, atom_index) FROM open_)")}
            SELECT structure_id, atom_index, {COARSE} AS points, exposed, round({ball} * exposed / {COARSE}, 3) AS area FROM m ANTI JOIN open_ USING (structure_id, atom_index)
            UNION ALL SELECT structure_id, atom_index, {FINE}, exposed, round({ball} * exposed / {FINE}, 3) FROM f SEMI JOIN open_ USING (structure_id, atom_index)""",
        "frame_variants": f"""{moved}, {_pairs('moved', 'structure_id, frame')}, {_masked('m', [sphere_points(POINTS)], 'structure_id, frame')}, {_masked('t', [masks.rotated_points(POINTS, v) for v in range(masks.VARIANTS)], 'structure_id, frame', f'frame % {masks.VARIANTS}')},
            s AS (SELECT structure_id, frame, round(sum({ball} * exposed / {POINTS}), 3) AS total_sasa FROM m GROUP BY structure_id, frame)
            SELECT 'single' AS mode, * FROM s UNION ALL SELECT 'per-frame', * FROM s UNION ALL SELECT 'cycle', structure_id, frame, round(sum({ball} * exposed / {POINTS}), 3) FROM t GROUP BY structure_id, frame""",
        "job_areas": _job_sql(),
        "batch_status": f"{faulty} SELECT structure_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'err' END AS status, error, n AS n_atoms, round(t, 3) AS total_area FROM b",
        "batch_summary": f"{faulty} SELECT count(*) AS n_files, count(*) FILTER (WHERE error IS NULL) AS n_ok, count(*) FILTER (WHERE error IS NOT NULL) AS n_failed, coalesce(sum(n), 0)::BIGINT AS n_atoms FROM b",
        "interface_atoms": f"{sided} SELECT structure_id, 'a-r' AS id, atom_index, partner, isolated, complex, round(ia, 3) AS isolated_area, round(ca, 3) AS complex_area, round(ia - ca, 3) AS delta FROM sided",
        "interface_residues": f"{sided} SELECT structure_id, 'a-r' AS id, partner, chain, residue_num, ins_code, arg_min(residue, atom_index) AS residue, count(*) AS n_atoms, round(sum(ia), 3) AS isolated_area, round(sum(ca), 3) AS complex_area, round(sum(ia - ca), 3) AS delta FROM sided JOIN atoms USING (structure_id, atom_index) GROUP BY structure_id, partner, chain, residue_num, ins_code",
        "residue_map_json": f"""{runs}, r AS (SELECT structure_id, run, chain, residue_num, residue, ins_code, min(atom_index) AS s, count(*) AS c, round(sum(area), 3) AS a FROM numbered GROUP BY structure_id, run, chain, residue_num, residue, ins_code),
            l AS (SELECT structure_id, list(chain ORDER BY run) AS ch, list(residue ORDER BY run) AS na, list(residue_num ORDER BY run) AS nu, list(ins_code ORDER BY run) AS ic, list(s ORDER BY run) AS st, list(c ORDER BY run) AS ct, list(a ORDER BY run) AS ar FROM r GROUP BY structure_id),
            t AS (SELECT structure_id, round(sum(area), 3) AS total, list(round(area, 3) ORDER BY atom_index) AS areas FROM rows_ GROUP BY structure_id)
            SELECT structure_id, CAST(to_json({{'status': 'ok', 'filename': structure_id::VARCHAR, 'total_area': total, 'atom_areas': areas, 'residue_chain': ch, 'residue_name': na, 'residue_number': nu, 'residue_insertion_code': ic, 'residue_atom_start': st, 'residue_atom_count': ct, 'residue_sasa': ar}}) AS VARCHAR) AS value FROM t JOIN l USING (structure_id)""",
        "interface_json": f"""{sided}, r AS (SELECT structure_id, partner, chain, residue_num, ins_code, arg_min(residue, atom_index) AS residue, min(atom_index) AS f, round(sum(ia), 3) AS i, round(sum(ca), 3) AS c, round(sum(ia - ca), 3) AS d FROM sided JOIN atoms USING (structure_id, atom_index) GROUP BY structure_id, partner, chain, residue_num, ins_code),
            l AS (SELECT structure_id, list(partner ORDER BY f) AS pa, list(chain ORDER BY f) AS ch, list(residue ORDER BY f) AS na, list(residue_num ORDER BY f) AS nu, list(ins_code ORDER BY f) AS ic, list(i ORDER BY f) AS li, list(c ORDER BY f) AS lc, list(d ORDER BY f) AS ld FROM r GROUP BY structure_id),
            t AS (SELECT structure_id, sum(CASE WHEN partner = 'a' THEN ia ELSE 0 END) AS a, sum(CASE WHEN partner = 'b' THEN ia ELSE 0 END) AS b, sum(ca) AS ab FROM sided GROUP BY structure_id)
            SELECT structure_id, 'a-r' AS id, CASE WHEN has_a AND has_b THEN CAST(to_json({{'status': 'ok', 'filename': structure_id::VARCHAR, 'id': 'a-r', 'analysis': 'bsa', 'sasa_partner_a': round(a, 3), 'sasa_partner_b': round(b, 3), 'sasa_complex': round(ab, 3), 'delta_sasa_total': round(a + b - ab, 3), 'bsa': round((a + b - ab) / 2, 3),
                'residue_partner': pa, 'residue_chain': ch, 'residue_name': na, 'residue_number': nu, 'residue_insertion_code': ic, 'residue_sasa_isolated': li, 'residue_sasa_complex': lc, 'residue_delta_sasa': ld}}) AS VARCHAR)
                ELSE CAST(to_json({{'status': 'err', 'filename': structure_id::VARCHAR, 'id': 'a-r', 'analysis': 'bsa', 'error': CASE WHEN has_a THEN 'partner B chain not found' ELSE 'partner A chain not found' END}}) AS VARCHAR) END AS value
            FROM there LEFT JOIN t USING (structure_id) LEFT JOIN l USING (structure_id)""",
        "resolved_components": _resolved_sql(component_radii_sql),
        "altloc_auto": f"""{atoms}, f AS (SELECT *, min(CASE WHEN alt_loc IN (' ', 'A') THEN atom_index END) OVER s AS first, max(CASE WHEN alt_loc <> ' ' THEN occupancy END) OVER s AS top FROM atoms WINDOW s AS (PARTITION BY {site})),
            g AS (SELECT *, max(CASE WHEN atom_index = first THEN alt_loc END) OVER (PARTITION BY {site}) AS mark, min(CASE WHEN alt_loc <> ' ' AND occupancy = top THEN atom_index END) OVER (PARTITION BY {site}) AS best FROM f)
            SELECT structure_id, atom_index, alt_loc FROM g WHERE alt_loc = ' ' OR (first IS NULL AND atom_index = best) OR (mark = 'A' AND alt_loc = 'A')""",
        "altloc_highest": f"{atoms}, f AS (SELECT *, max(CASE WHEN alt_loc <> ' ' THEN occupancy END) OVER (PARTITION BY {site}) AS top FROM atoms) SELECT structure_id, atom_index, alt_loc FROM f WHERE alt_loc = ' ' OR occupancy = top",
        "altloc_selected": f"{atoms} SELECT structure_id, atom_index, alt_loc FROM atoms WHERE alt_loc IN (' ', 'B')",
        "altloc_all": f"{atoms} SELECT structure_id, atom_index, alt_loc FROM atoms",
    }
