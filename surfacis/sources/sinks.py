"""Results as files: JSON, JSON lines, CSV and trajectory tables, each a DataFrame of text lines that Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elements import MAX_SASA, lookup
from ..schema import InputError


def rounded(value: Column, decimals: int) -> Column:
    """Half away from zero, without a negative zero."""
    if not 0 <= decimals <= 15:
        raise InputError(f"decimals {decimals}: 0 to 15")
    r = F.round(value, decimals)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def json_rows(areas: DataFrame, decimals: int | None = None, total: bool = True, atoms: bool = True) -> DataFrame:
    """structure_id and value, a JSON object of total_area and atom_areas (in order of atom_index) for each structure. One structure's areas meet in one row, as the format demands."""
    shown = (lambda c: rounded(c, decimals)) if decimals is not None else (lambda c: c)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("atom_index", "area"))), lambda s: shown(s["area"]))
    per = areas.groupBy("structure_id").agg(shown(F.sum("area")).alias("total_area"), listed.alias("atom_areas"))
    return per.select("structure_id", F.to_json(F.struct(*(["total_area"] if total else []), *(["atom_areas"] if atoms else []))).alias("value"))


def jsonl_rows(areas: DataFrame, errors: DataFrame | None = None, decimals: int | None = None, total: bool = True, atoms: bool = True) -> DataFrame:
    """value, a JSON line for each structure: status ok, filename and areas; or status error, filename and error for each row of errors (structure_id, error)."""
    shown = (lambda c: rounded(c, decimals)) if decimals is not None else (lambda c: c)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("atom_index", "area"))), lambda s: shown(s["area"]))
    per = areas.groupBy("structure_id").agg(shown(F.sum("area")).alias("total_area"), listed.alias("atom_areas"))
    out = per.select(F.to_json(F.struct(F.lit("ok").alias("status"), F.col("structure_id").alias("filename"), *(["total_area"] if total else []), *(["atom_areas"] if atoms else []))).alias("value"))
    if errors is not None:
        out = out.unionByName(errors.select(F.to_json(F.struct(F.lit("error").alias("status"), F.col("structure_id").alias("filename"), "error")).alias("value")))
    return out


def csv_rows(areas: DataFrame) -> DataFrame:
    """structure_id, place and value, the lines of a CSV of atom_index, area and a total row; order by structure_id and place."""
    lines = areas.select("structure_id", F.col("atom_index").cast("long").alias("place"), F.format_string("%d,%.6f", "atom_index", "area").alias("value"))
    return _framed(lines, areas, "atom_index,area", F.format_string("total,%.6f", "total"))


def rich_csv_rows(atoms: DataFrame) -> DataFrame:
    """As csv_rows(), with chain, residue, number, name, place and radius of each atom of a table that has them and area."""
    text = F.format_string("%s,%s,%d,%s,%.3f,%.3f,%.3f,%.3f,%.6f", "chain", "residue", "residue_num", "atom_name", "x", "y", "z", "radius", "area")
    lines = atoms.select("structure_id", F.col("atom_index").cast("long").alias("place"), text.alias("value"))
    return _framed(lines, atoms, "chain,residue,resnum,atom_name,x,y,z,radius,area", F.format_string("total,,,,,,,,%.6f", "total"))


def _framed(lines: DataFrame, areas: DataFrame, header: str, last: Column) -> DataFrame:
    totals = areas.groupBy("structure_id").agg(F.sum("area").alias("total"))
    ends = F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.lit(header).alias("value")), F.struct(F.lit(2**62).alias("place"), last.alias("value")))).alias("e")
    return lines.unionByName(totals.select("structure_id", ends).select("structure_id", "e.place", "e.value"))


def trajectory_rows(frames: DataFrame) -> DataFrame:
    """frame and value, the lines of a CSV of frame, step, time and total_sasa in frame order, for a table with those columns."""
    return frames.orderBy("frame").select("frame", F.format_string("%d,%d,%.3f,%.2f", "frame", "step", "time", "total_sasa").alias("value"))


def write_per_structure(rows: DataFrame, path: str) -> None:
    """Lines (structure_id, value and perhaps place) as text files, in a folder for each structure; structures share tasks by hash, and each one's lines are in order."""
    order = ["structure_id", *(["place"] if "place" in rows.columns else [])]
    rows.repartition("structure_id").sortWithinPartitions(*order).select("structure_id", "value").write.partitionBy("structure_id").text(path)


def _columns_of(rows: Column, names: dict[str, str]) -> list[Column]:
    """An array of structs as one array for each field: names of the arrays and the fields."""
    return [rows.getField(field).alias(name) for name, field in names.items()]


def residue_map_rows(runs: DataFrame, areas: DataFrame, decimals: int = 3) -> DataFrame:
    """value, a JSON line for each structure: total_area, atom_areas in order of atoms, and the runs of its residues (of analysis.runs) as arrays of equal length, in order of runs."""
    shown = lambda c: rounded(c, decimals)
    atoms = F.array_sort(F.collect_list(F.struct("atom_index", shown(F.col("area")).alias("area"))))
    per = areas.groupBy("structure_id").agg(shown(F.sum("area")).alias("total_area"), F.transform(atoms, lambda s: s["area"]).alias("atom_areas"))
    run = F.struct("run", "chain", "residue", "residue_num", "ins_code", "atom_start", "atom_count", shown(F.col("area")).alias("area"))
    listed = runs.groupBy("structure_id").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    names = {"residue_chain": "chain", "residue_name": "residue", "residue_number": "residue_num", "residue_insertion_code": "ins_code", "residue_atom_start": "atom_start", "residue_atom_count": "atom_count", "residue_sasa": "area"}
    doc = F.struct(F.lit("ok").alias("status"), F.col("structure_id").cast("string").alias("filename"), "total_area", "atom_areas", *_columns_of(F.col("runs"), names))
    return per.join(listed, "structure_id").select("structure_id", F.to_json(doc).alias("value"))


def interface_rows(faces: DataFrame, residues: DataFrame, decimals: int = 3) -> DataFrame:
    """value, a JSON line for each interface: areas, delta and bsa with its residues (of selections.residue_deltas) as arrays in order of their first atoms, or status err and the error."""
    shown = lambda c: rounded(F.col(c), decimals)
    one = F.struct("first_atom", "partner", "chain", "residue", "residue_num", "ins_code", *[shown(c).alias(c) for c in ("isolated_area", "complex_area", "delta")])
    listed = residues.groupBy("structure_id", "id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    names = {
        "residue_partner": "partner", "residue_chain": "chain", "residue_name": "residue", "residue_number": "residue_num", "residue_insertion_code": "ins_code", "residue_sasa_isolated": "isolated_area",
        "residue_sasa_complex": "complex_area", "residue_delta_sasa": "delta",
    }
    sums = ("sasa_partner_a", "sasa_partner_b", "sasa_complex", "delta_sasa_total", "bsa")
    start = [F.col("structure_id").cast("string").alias("filename"), "id", F.lit("bsa").alias("analysis")]
    good = F.to_json(F.struct(F.lit("ok").alias("status"), *start, *[shown(c).alias(c) for c in sums], *_columns_of(F.col("rows"), names)))
    bad = F.to_json(F.struct(F.lit("err").alias("status"), *start, "error"))
    return faces.join(listed, ["structure_id", "id"], "left").select("structure_id", "id", F.when(F.col("error").isNull(), good).otherwise(bad).alias("value"))


def selection_rows(entries: DataFrame, areas: DataFrame, atoms: DataFrame | None = None, decimals: int = 3) -> DataFrame:
    """value, a JSON line for each entry of selection_atoms(): its chains as asked, areas and what the atoms are as arrays in order of atoms, or status err and the error. atoms: what the atoms are, if areas don't carry it."""
    shown = lambda c: rounded(c, decimals)
    one = F.struct("atom_index", shown(F.col("area")).alias("shown"), "area", "chain", "residue", "residue_num", "ins_code", "atom_name", "element")
    named = areas if atoms is None else areas.join(atoms.select("structure_id", "atom_index", "chain", "residue", "residue_num", "ins_code", "atom_name", "element"), ["structure_id", "atom_index"])
    listed = named.groupBy("structure_id", "id").agg(shown(F.sum("area")).alias("total_area"), F.array_sort(F.collect_list(one)).alias("rows"))
    names = {
        "atom_areas": "shown", "source_atom_index": "atom_index", "atom_chain": "chain", "atom_residue_name": "residue", "atom_residue_number": "residue_num", "atom_insertion_code": "ins_code", "atom_name": "atom_name",
        "atom_element": "element",
    }
    start = [F.col("structure_id").cast("string").alias("filename"), "id", "chains"]
    good = F.to_json(F.struct(F.lit("ok").alias("status"), *start, "total_area", *_columns_of(F.col("rows"), names)))
    bad = F.to_json(F.struct(F.lit("err").alias("status"), *start, "error"))
    return entries.join(listed, ["structure_id", "id"], "left").select("structure_id", "id", F.when(F.col("status") == "ok", good).otherwise(bad).alias("value"))


def rsa_lines(parts: DataFrame) -> DataFrame:
    """structure_id, place and value, the lines of a table of absolute and relative areas from analysis.breakdown(): residues in order of their first atoms, chains, and the total. order by structure_id and place."""
    best = lookup(MAX_SASA, F.col("residue"))
    share = lambda rel: F.coalesce(F.format_string("%6.1f", rel), F.lit("   N/A")) if rel is not None else F.lit("   N/A")
    sums = ["total", "side", "main", "apolar", "polar"]
    both = F.concat(*[F.concat(F.format_string("%7.2f", n), F.when(best > 0, share(F.col("total") * 100 / best)).otherwise(share(None)) if n == "total" else share(None)) for n in sums])
    number = F.concat(F.col("residue_num").cast("string"), F.coalesce("ins_code", F.lit("")))
    wide = F.concat_ws("   ", *[F.format_string("%10.1f", n) for n in sums])
    chain = F.format_string("%3s", F.coalesce("chain", F.lit("")))
    step = 1 << 40  # more than a structure has atoms
    residues = parts.where("level = 0").select("structure_id", (F.col("first_atom") + 10).alias("place"), F.concat(F.lit("RES "), F.format_string("%3s", F.coalesce("residue", F.lit(""))), F.lit(" "), chain, F.lit(" "), F.rpad(number, F.greatest(F.lit(4), F.length(number)), F.lit(" ")), F.lit(" "), both).alias("value"))
    at = F.row_number().over(Window.partitionBy("structure_id").orderBy("first_atom"))
    chains = parts.where("level = 1").withColumn("no", at).select("structure_id", (F.lit(step) + F.col("no")).alias("place"), F.concat(F.format_string("CHAIN%3d ", "no"), chain, F.lit(" "), wide).alias("value"))
    whole = parts.where("level = 2")
    total = whole.select("structure_id", F.lit(2 * step + 1).alias("place"), F.concat(F.lit("TOTAL        "), wide).alias("value"))
    fixed = [
        (0, F.concat(F.lit("REM  Absolute and relative areas of "), F.col("structure_id").cast("string"))), (1, F.lit("REM RES _ NUM      All-atoms   Total-Side   Main-Chain    Non-polar    All polar")),
        (2, F.lit("REM                ABS   REL    ABS   REL    ABS   REL    ABS   REL    ABS   REL")), (step, F.lit("END  Absolute sums over single chains surface")), (2 * step, F.lit("END  Absolute sums over all chains")),
    ]
    rest = whole.select("structure_id", F.inline(F.array(*[F.struct(F.lit(n).cast("long").alias("place"), v.alias("value")) for n, v in fixed])))
    return residues.unionByName(chains).unionByName(total).unionByName(rest)


def summary_text(totals: DataFrame, algorithm: str, classifier: str, probe: float, detail: tuple[str, int] | None = None) -> DataFrame:
    """structure_id and value, a short text report on each structure's total_area."""
    lines = ["PARAMETERS", f"algorithm    : {algorithm}", f"classifier   : {classifier}", f"probe-radius : {probe:.2f}", *([f"{detail[0]:<13}: {detail[1]}"] if detail else [])]
    return totals.select("structure_id", F.concat(F.lit("\n".join(lines) + "\ninput        : "), F.col("structure_id").cast("string"), F.lit("\n\nRESULTS (A^2)\n"), F.format_string("Total   : %10.2f", "total_area")).alias("value"))
