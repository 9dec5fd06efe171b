"""Pseudo-atoms: a deterministic atoms view of the lineitem table, for queries over tables that hold no molecules.

The text is SQL that Spark and DuckDB read alike; these are not chemistry, only atoms of about protein density.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAMES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
_ATOM_NAMES = "N CA C O CB OG1 CD1".split()


def _pick(index: str, names: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_NUMBERED = """
SELECT l_suppkey AS structure_id, l_returnflag AS chain, l_orderkey, l_linenumber, l_partkey,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS INT) AS atom_index,
       CAST(CAST(round(100 * l_extendedprice) AS BIGINT) % 3000 AS DOUBLE) / CAST(100 AS DOUBLE) AS x,
       CAST(0.6 AS DOUBLE) * l_quantity AS y,
       CAST((7919 * l_partkey + 104729 * l_orderkey) % 3000 AS DOUBLE) / CAST(100 AS DOUBLE) AS z,
       CASE l_orderkey % 4 WHEN 0 THEN CAST(1.88 AS DOUBLE) WHEN 1 THEN CAST(1.64 AS DOUBLE) WHEN 2 THEN CAST(1.42 AS DOUBLE) ELSE CAST(1.77 AS DOUBLE) END AS radius
FROM lineitem"""

ATOMS_SQL = f"""
SELECT structure_id, atom_index, chain, x, y, z, radius,
       CAST(l_orderkey % 97 AS INT) AS residue_num,
       {_pick("l_orderkey % 20", _NAMES)} AS residue,
       CASE WHEN l_partkey % 29 = 0 THEN 'A' ELSE '' END AS ins_code,
       {_pick("(l_partkey + l_linenumber) % 7", _ATOM_NAMES)} AS atom_name,
       CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN 7 WHEN 3 THEN 8 WHEN 5 THEN 8 ELSE CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 6 END END AS element,
       CASE WHEN l_orderkey % 13 = 0 THEN 'HETATM' ELSE 'ATOM' END AS record,
       CASE WHEN l_partkey % 5 = 0 THEN 'A' WHEN l_partkey % 5 = 1 THEN 'B' ELSE ' ' END AS alt_loc,
       CAST(l_partkey % 4 AS DOUBLE) / CAST(4 AS DOUBLE) AS occupancy,
       CAST(l_orderkey % 3 AS INT) + 1 AS model_num
FROM ({_NUMBERED}) AS numbered"""


def pseudo_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ATOMS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
