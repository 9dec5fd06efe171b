import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from surfacis.operators import policies, surface
from surfacis.schema import InputError
from surfacis.sources import files, sinks


def pdb_line(record, n, name, alt, res, chain, num, x, y, z, symbol="  "):
    return f"{record:<6}{n:>5} {name:<4}{alt}{res:>3} {chain}{num:>4}    {x:>8.3f}{y:>8.3f}{z:>8.3f}{1.0:>6.2f}{0.0:>6.2f}          {symbol:>2}"


PDB = "\n".join([
    "HEADER", "MODEL        1", pdb_line("ATOM", 1, " N  ", " ", "ALA", "A", 1, 0, 0, 0, " N"), pdb_line("ATOM", 2, " CA ", " ", "ALA", "A", 1, 1.5, 0, 0), "ATOM      3  C", "ENDMDL",
    "MODEL        2", pdb_line("HETATM", 1, "1HB ", "B", "HOH", " ", -2, -1.25, 2, 3), "END",
])

CIF = """data_x
_entry.id x
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.auth_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM N "N" . ALA A Q 1 0.0 0.0 0.0
ATOM C 'C A' . ? A Q . 1.5(2) 0.0 0.0 # a comment
#
_cell.length_a 3
loop_
_chem_comp_atom.comp_id
_chem_comp_atom.atom_id
_chem_comp_atom.type_symbol
EOH C1 C
EOH O O
loop_
_chem_comp_bond.comp_id
_chem_comp_bond.atom_id_1
_chem_comp_bond.atom_id_2
_chem_comp_bond.value_order
EOH C1 O SING
"""


@pytest.fixture
def folder(tmp_path):
    import zstandard

    (tmp_path / "one.PDB").write_text(PDB)
    with gzip.open(tmp_path / "two.cif.gz", "wt") as f:
        f.write(CIF)
    (tmp_path / "three.json.zst").write_bytes(zstandard.compress(json.dumps({"x": [0, 9], "y": [0, 0], "z": [0, 0], "r": [1, 2]}).encode()))
    return str(tmp_path)


def test_pdb(spark, folder):
    rows = files.read_pdb(spark, folder).orderBy("atom_index").collect()
    assert [(r.model_num, r.record, r.atom_name, r.element, r.residue, r.chain, r.residue_num, r.alt_loc, r.x, r.radius) for r in rows] == [
        (1, "ATOM", "N", 7, "ALA", "A", 1, " ", 0.0, 1.55), (1, "ATOM", "CA", 6, "ALA", "A", 1, " ", 1.5, 1.7), (2, "HETATM", "1HB", 1, "HOH", "", -2, "B", -1.25, 1.2),
    ]
    assert policies.keep_atoms(files.read_pdb(spark, folder)).count() == 2


def test_mmcif_and_components(spark, folder):
    rows = files.read_mmcif(spark, folder).orderBy("atom_index").collect()
    assert [(r.structure_id, r.atom_name, r.residue, r.chain, r.auth_chain, r.residue_num, r.x, r.radius) for r in rows] == [("two", "N", "ALA", "A", "Q", 1, 0.0, 1.55), ("two", "C A", "UNK", "A", "Q", 0, 1.5, 1.7)]
    assert {r.chain for r in files.read_mmcif(spark, folder, auth_chain=True).collect()} == {"Q"}
    atoms, bonds = files.read_components(spark, folder)
    assert atoms.count() == 2 and [(r.comp_id, r.atom_idx_1, r.atom_idx_2, r.bond_order) for r in bonds.collect()] == [("EOH", 0, 1, "SING")]


def test_structures_to_areas(spark, folder):
    atoms = files.read_structures(spark, folder)
    assert {r.structure_id: r["count"] for r in atoms.groupBy("structure_id").count().collect()} == {"one": 3, "two": 2, "three": 2}
    lines = sinks.csv_rows(surface.shrake_rupley(atoms.where("structure_id = 'three'"))).orderBy("place").collect()
    assert [r.value.split(",")[0] for r in lines] == ["atom_index", "0", "1", "total"]


def test_uneven_json_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"x": [0, 1], "y": [0], "z": [0, 0], "r": [1, 1]}')
    with pytest.raises(Exception, match="unequal"):
        files.read_json(spark, str(tmp_path)).collect()


def test_formats(spark):
    rows = spark.createDataFrame([("a/1abc.cif.GZ",), ("b.ent",), ("c.mol",), ("d.BCIF.zst",), ("e.txt",)], "p string")
    assert [tuple(r) for r in rows.select(files.file_format(F.col("p")), files.is_supported(F.col("p")), files.structure_id(F.col("p"))).collect()] == [
        ("mmcif", True, "1abc"), ("pdb", True, "b"), ("sdf", True, "c"), ("bcif", True, "d"), ("json", False, "e"),
    ]


def test_chain_map(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text('FileName,chains,id\na.pdb,"A, B",x\na.pdb,C,y\n')
    assert sorted((r.filename, r.chains, r.id, r.asym_id_type) for r in files.read_chain_map(spark, str(path)).collect()) == [("a.pdb", ["A", "B"], "x", "label"), ("a.pdb", ["C"], "y", "label")]
    path.write_text("filename,chains,id\na.pdb,A,x\na.pdb,C,x\n")
    with pytest.raises(InputError):
        files.read_chain_map(spark, str(path))


def test_sinks(spark, tmp_path):
    areas = spark.createDataFrame([("s", 1, 2.25), ("s", 0, -0.001), ("t", 0, 1.0)], "structure_id string, atom_index int, area double")
    assert {r.structure_id: json.loads(r.value) for r in sinks.json_rows(areas, 1).collect()} == {"s": {"total_area": 2.2, "atom_areas": [0.0, 2.3]}, "t": {"total_area": 1.0, "atom_areas": [1.0]}}
    errors = spark.createDataFrame([("u", "no atoms")], "structure_id string, error string")
    assert sorted(json.loads(r.value)["status"] for r in sinks.jsonl_rows(areas, errors, atoms=False).collect()) == ["error", "ok", "ok"]
    sinks.write_per_structure(sinks.csv_rows(areas), str(tmp_path / "out"))
    part = [f for f in os.listdir(tmp_path / "out" / "structure_id=s") if f.startswith("part-")]
    assert (tmp_path / "out" / "structure_id=s" / part[0]).read_text() == "atom_index,area\n0,-0.001000\n1,2.250000\ntotal,2.249000\n"
    assert sinks.json_rows(areas.limit(0)).count() == 0


def test_json_and_interface_maps(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text('[{"filename": "a.cif", "chains": ["A", "C"]}, {"filename": "b.cif", "chains": ["X"], "asym_id_type": "AUTH"}]')
    assert sorted((r.filename, r.chains, r.asym_id_type) for r in files.read_chain_map(spark, str(path)).collect()) == [("a.cif", ["A", "C"], "label"), ("b.cif", ["X"], "auth")]
    path.write_text('[{"filename": "a.cif", "chains": []}]')
    with pytest.raises(InputError):
        files.read_chain_map(spark, str(path))
    face = tmp_path / "faces.csv"
    face.write_text('filename,Partner_A,partner_b\na.cif,"A,B",C\n')
    assert [(r.filename, r.partner_a, r.partner_b, r.id) for r in files.read_interface_map(spark, str(face)).collect()] == [("a.cif", ["A", "B"], ["C"], None)]
    face.write_text("filename,partner_a\na.cif,A\n")
    with pytest.raises(InputError):
        files.read_interface_map(spark, str(face))


def test_map_rows_without_files_and_files_without_rows(spark):
    entries = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "filename string, id string")
    found, errors = files.matched_files(entries, spark.createDataFrame([("a",), ("a",), ("c",)], "filename string"))
    assert sorted(r.id for r in found.collect()) == ["x", "y"]
    assert sorted(map(tuple, errors.collect())) == [("b", "input file not found"), ("c", "file is not in the map")]
