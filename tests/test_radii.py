"""Built-in radius tables: values, the order of look-ups, odd rows, and the registered queries against their SQL."""

import math

import pytest

from surfacis.functions import radii
from surfacis.operators import classify
from surfacis.schema import InputError

COLUMNS = "structure_id string, atom_index int, residue string, atom_name string, element int, radius double"


def looked_up(spark, name, rows):
    atoms = spark.createDataFrame([("s", i, r, a, 0, 9.0) for i, (r, a) in enumerate(rows)], COLUMNS)
    return {r["atom_index"]: (r["radius"], r["atom_class"], r["matched"]) for r in classify.classify_builtin(atoms, name).collect()}


@pytest.mark.parametrize("name, n_any, n", [("naccess", 19, 206), ("oons", 36, 136)])
def test_tables_have_each_key_once(name, n_any, n):
    rows = radii.BUILTIN[name]()
    assert len(rows) == len({r[:2] for r in rows}) == n
    assert sum(r[0] == "ANY" for r in rows) == n_any
    assert all(1.0 < r[2] <= 2.0 and r[3] in ("polar", "apolar") and math.isfinite(r[2]) for r in rows)


def test_residue_before_any_before_the_name(spark):
    got = looked_up(spark, "naccess", [("LYS", "NZ"), ("ALA", "CA"), ("XXX", "O"), ("DA", "N9"), ("U", "O4"), ("ALA", "CD1"), ("ALA", "OG1"), ("XXX", "?1"), (" LYS", " NZ ")])
    assert got[0] == (1.50, "polar", "exact")
    assert got[1] == (1.87, "apolar", "any")
    assert got[2] == (1.40, "polar", "any")
    assert got[3] == (1.60, "polar", "exact") and got[4] == (1.40, "polar", "exact")
    assert got[5] == (1.58, "unknown", "element")  # a name that begins like cadmium, with no space before it
    assert got[6] == (1.52, "unknown", "element")
    assert got[7] == (9.0, "unknown", "original")
    assert got[8] == got[0]
    got = looked_up(spark, "oons", [("PRO", "CB"), ("ALA", "CB"), ("ALA", "C"), ("HOH", "O"), ("GLX", "XE1"), ("DT", "C7"), ("MET", "SD")])
    assert got == {0: (1.75, "apolar", "exact"), 1: (2.00, "apolar", "any"), 2: (1.55, "polar", "any"), 3: (1.40, "polar", "exact"), 4: (1.50, "polar", "exact"), 5: (1.75, "apolar", "any"), 6: (2.00, "polar", "exact")}


def test_the_element_column_is_not_asked(spark):
    atoms = spark.createDataFrame([("s", 0, "XXX", "Q1", 6, 9.0), ("s", 1, "XXX", "F1", 6, 9.0)], COLUMNS)
    got = {r["atom_index"]: (r["radius"], r["matched"]) for r in classify.classify_builtin(atoms, "naccess").collect()}
    assert got == {0: (9.0, "original"), 1: (1.47, "element")}
    by_table = {r["atom_index"]: (r["radius"], r["matched"]) for r in classify.classify(atoms, classify.builtin(spark, "naccess")).collect()}
    assert by_table == {0: (1.70, "element"), 1: (1.70, "element")}


def test_nulls_repeats_other_columns_and_empty_tables(spark):
    rows = [("s", 0, None, "CA", None, None, "kept"), ("s", 0, None, "CA", None, None, "kept"), ("s", 1, "ALA", None, None, 1.5, "kept"), ("s", 2, None, None, None, None, None)]
    atoms = spark.createDataFrame(rows, COLUMNS + ", matched_by string")
    got = sorted((r["atom_index"], r["radius"], r["atom_class"], r["matched"], r["matched_by"]) for r in classify.classify_builtin(atoms, "oons").collect() if r["atom_index"] < 2)
    assert got == [(0, 2.0, "apolar", "any", "kept")] * 2 + [(1, 1.5, "unknown", "original", "kept")]
    last = [r for r in classify.classify_builtin(atoms, "oons").collect() if r["atom_index"] == 2][0]
    assert (last["radius"], last["matched"]) == (None, "none")
    assert classify.classify_builtin(atoms.limit(0), "oons").count() == 0


def test_unknown_names_are_refused(spark):
    with pytest.raises(InputError, match="naccess, oons"):
        classify.builtin(spark, "protor")


def test_queries_equal_their_sql(spark):
    import duckdb

    from surfacis.plans import catalogue

    d, sql = "/root/testdata/sf0.001", catalogue.oracle()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet'")
    for name in ("naccess_atoms", "oons_atoms", "builtin_counts"):
        mine = catalogue.QUERIES[name](spark, d)
        theirs = con.execute(sql[name])
        names = [c[0] for c in theirs.description]
        assert sorted(mine.columns) == sorted(names)
        assert sorted(map(tuple, mine.select(*names).collect())) == sorted(theirs.fetchall())
