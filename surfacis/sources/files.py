"""Structure files as the atoms table: PDB, mmCIF and JSON arrays, plain, .gz or .zst; component dictionaries; chain and interface maps."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import atomic_number, vdw_radius
from ..schema import InputError

#: Bytes that a compressed file may unpack to.
UNPACKED_CAP = 4 << 30
#: Extensions by format; any other one counts as JSON.
EXTENSIONS = {"pdb": ["pdb", "ent"], "mmcif": ["cif", "mmcif"], "bcif": ["bcif"], "sdf": ["sdf", "mol"], "json": ["json"]}


def file_format(path: Column) -> Column:
    """Format of a path by its extension in any case, after .gz or .zst; json if unknown."""
    bare, out = F.regexp_replace(F.lower(path), r"\.(gz|zst)$", ""), F.lit("json")
    for name, ends in EXTENSIONS.items():
        out = F.when(bare.rlike(rf"\.({'|'.join(ends)})$"), name).otherwise(out)
    return out


def is_supported(path: Column) -> Column:
    ends = "|".join(e for es in EXTENSIONS.values() for e in es)
    return F.lower(path).rlike(rf"\.({ends})(\.gz|\.zst)?$")


def structure_id(path: Column) -> Column:
    """File name without its extension and compression."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)\.[^.]*?(\.gz|\.zst)?$", "")


def _glob(fmt: str) -> str:
    either = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    return "*.{" + ",".join(either(e + z) for e in EXTENSIONS[fmt] for z in ("", ".gz", ".zst")) + "}"


def unpacked(path: str, raw: bytes, cap: int = UNPACKED_CAP) -> bytes:
    """Bytes of a file, decompressed by its extension; an error beyond cap."""
    if path.lower().endswith(".gz"):
        raw = gzip.GzipFile(fileobj=io.BytesIO(raw)).read(cap + 1)
    elif path.lower().endswith(".zst"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read(cap + 1)
    if len(raw) > cap:
        raise InputError(f"{path} unpacks to more than {cap} bytes")
    return raw


def contents(spark: SparkSession, paths: str | list[str], fmt: str | None = None, cap: int = UNPACKED_CAP) -> DataFrame:
    """path, structure_id and content (decompressed) of the files in folders (not below them) or of the files named."""
    read = spark.read.format("binaryFile")
    files = (read.option("pathGlobFilter", _glob(fmt)) if fmt else read).load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [unpacked(path, raw.as_py(), cap)]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return files.mapInArrow(run, "path string, content binary").withColumn("structure_id", structure_id(F.col("path")))


def _number(text: Column) -> Column:
    """A decimal number without exponent as a double, else null: no NaN, no infinity."""
    return F.when(text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"), text.try_cast("double"))


def _part(line: Column, start: int, size: int) -> Column:
    return F.trim(F.substring(line, start, size))


def read_pdb(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Atoms of PDB files. Lines that are too short or whose coordinates aren't numbers are passed over.

    Column expressions only: a file's ATOM and HETATM lines become one array, whose positions are the atom indices,
    so no shuffle is needed to number them. A file without atoms gives no rows.
    """
    text = F.col("content").cast("string")
    model = lambda s: F.when(F.startswith(s, F.lit("MODEL")), F.coalesce(_part(s, 11, 4).try_cast("int"), F.lit(1))).otherwise(1)
    lines = lambda s: F.filter(F.split(s, "\r?\n"), lambda r: F.startswith(r, F.lit("ATOM  ")) | F.startswith(r, F.lit("HETATM")))
    atoms = F.flatten(F.transform(F.split(text, "(?m)^(?=MODEL )"), lambda s: F.transform(lines(s), lambda r: F.struct(r.alias("r"), model(s).alias("m")))))
    rows = contents(spark, paths, "pdb").select("structure_id", F.posexplode(atoms).alias("atom_index", "a"))
    r = F.col("a.r")
    name = F.substring(r, 13, 4)
    guess = F.when(F.substring(name, 1, 1).rlike("[ 0-9]"), F.substring(name, 2, 1)).otherwise(F.substring(name, 1, 1))
    symbol = F.when(_part(r, 77, 2) != "", _part(r, 77, 2)).otherwise(guess)
    rows = rows.select(
        "structure_id", "atom_index", F.col("a.m").alias("model_num"), _part(r, 1, 6).alias("record"),
        *[F.when(F.length(r) >= 54, _number(_part(r, at, 8))).alias(c) for c, at in (("x", 31), ("y", 39), ("z", 47))],
        symbol.alias("symbol"), atomic_number(symbol).alias("element"), F.trim(name).alias("atom_name"), _part(r, 18, 3).alias("residue"), _part(r, 22, 1).alias("chain"), _part(r, 22, 1).alias("auth_chain"),
        F.coalesce(_part(r, 23, 4).try_cast("int"), F.lit(0)).alias("residue_num"), _part(r, 27, 1).alias("ins_code"), F.rpad(F.substring(r, 17, 1), 1, " ").alias("alt_loc"),
        F.coalesce(_part(r, 55, 6).try_cast("double"), F.lit(0.0)).alias("occupancy"),
    )
    return rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumn("radius", vdw_radius(F.col("element"), F.col("symbol"))).drop("symbol")


_TOKEN = re.compile(r"""^;([\s\S]*?)^;|'((?:[^'\n]|'(?=\S))*)'(?=\s|\Z)|"((?:[^"\n]|"(?=\S))*)"(?=\s|\Z)|\#[^\n]*|(\S+)""", re.MULTILINE)


def cif_tables(text: str, wanted: set[str]) -> Iterator[tuple[str, list[str], list[list[str | None]]]]:
    """(category, column names, rows) of the wanted categories, as loops or as single items. An unquoted . or ? is null."""
    tags, values, loop, single = [], [], False, {}

    def done():
        if loop and tags and tags[0].split(".")[0] in wanted:
            if len(values) % len(tags):
                raise InputError(f"a row of {tags[0].split('.')[0]} is cut off")
            yield tags[0].split(".")[0], [t.split(".")[-1] for t in tags], [values[i : i + len(tags)] for i in range(0, len(values), len(tags))]
        if not loop:
            for tag, value in zip(tags, values):
                single.setdefault(tag.split(".")[0], {})[tag.split(".")[-1]] = value

    for m in _TOKEN.finditer(text):
        bare = m.group(4)
        if bare is None:
            if m.lastindex:
                values.append(m.group(m.lastindex))
            continue
        low = bare.lower()
        if low == "loop_" or low.startswith(("data_", "save_")):
            yield from done()
            tags, values, loop = [], [], low == "loop_"
            if not loop:
                yield from ((c, list(row), [list(row.values())]) for c, row in single.items() if c in wanted)
                single = {}
        elif bare[0] == "_":
            if loop and values or not loop and tags:
                yield from done()
                tags, values, loop = [], [], False
            tags.append(low)
        else:
            values.append(None if bare in (".", "?") else bare)
    yield from done()
    yield from ((c, list(row), [list(row.values())]) for c, row in single.items() if c in wanted)


def _cif_frame(spark: SparkSession, files: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """structure_id, row number and the named columns (strings, null where absent) of a category; has_ says which columns a table has."""
    names = [c.lower() for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, raw in zip(batch.column("structure_id").to_pylist(), batch.column("content")):
                at = 0
                for _, cols, rows in cif_tables(raw.as_py().decode("utf-8", "replace"), {category}):
                    place = [cols.index(c) if c in cols else None for c in names]
                    held = [pa.array([None if i is None else r[i] for r in rows], pa.string()) for i in place]
                    has = [c for c, i in zip(columns, place) if i is not None]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([sid] * n, pa.string()), pa.array(range(at, at + n), pa.int32()), pa.array([has] * n, pa.list_(pa.string())), *held], ["structure_id", "row", "has_", *columns])
                    at += n

    return files.select("structure_id", "content").mapInArrow(run, "structure_id string, row int, has_ array<string>, " + ", ".join(f"`{c}` string" for c in columns))


_SITE = (
    "Cartn_x Cartn_y Cartn_z type_symbol label_atom_id auth_atom_id label_comp_id auth_comp_id label_asym_id auth_asym_id label_seq_id auth_seq_id "
    "pdbx_PDB_ins_code group_PDB label_alt_id occupancy pdbx_PDB_model_num"
).split()


def read_mmcif(spark: SparkSession, paths: str | list[str], auth_chain: bool = False, strict: bool = True) -> DataFrame:
    """Atoms of mmCIF files. label columns come first, auth ones where a file lacks the label column (auth_chain: the other way round for chains); an uncertainty in brackets is cut off.

    A coordinate that isn't a finite number fails the query if strict, else it is null and the column fault says so, for batches to make an error row of.
    """
    rows = _cif_frame(spark, contents(spark, paths, "mmcif"), "_atom_site", _SITE)
    pick = lambda a, b: F.when(F.array_contains("has_", a), F.col(a)).otherwise(F.col(b))
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\([0-9]*\)$", "")
    number = lambda c: F.when(bare(c).rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), bare(c).try_cast("double"))
    chain = ("auth_asym_id", "label_asym_id") if auth_chain else ("label_asym_id", "auth_asym_id")
    place = lambda c: F.when(number(c).isNull(), F.raise_error(F.lit(f"{c} is not a number")).cast("double")).otherwise(number(c)) if strict else number(c)
    odd = F.lit(None).cast("string")
    for c in "zyx":
        odd = F.when(number(f"Cartn_{c}").isNull(), f"Cartn_{c} is not a number").otherwise(odd)
    rows = rows.select(
        "structure_id", F.col("row").alias("atom_index"), F.col("pdbx_PDB_model_num").try_cast("int").alias("model_num"), F.coalesce("group_PDB", F.lit("ATOM")).alias("record"),
        *[place(f"Cartn_{c}").alias(c) for c in "xyz"], "type_symbol", atomic_number(F.coalesce("type_symbol", F.lit("X"))).alias("element"), *([] if strict else [odd.alias("fault")]),
        F.coalesce(pick("label_atom_id", "auth_atom_id"), F.lit("X")).alias("atom_name"), F.coalesce(pick("label_comp_id", "auth_comp_id"), F.lit("UNK")).alias("residue"),
        F.coalesce(pick(*chain), F.lit("")).alias("chain"), F.coalesce("auth_asym_id", F.lit("")).alias("auth_chain"), F.coalesce(pick("label_seq_id", "auth_seq_id").try_cast("int"), F.lit(0)).alias("residue_num"),
        F.coalesce("pdbx_PDB_ins_code", F.lit("")).alias("ins_code"), F.coalesce(F.substring("label_alt_id", 1, 1), F.lit(" ")).alias("alt_loc"), F.coalesce(F.col("occupancy").try_cast("double"), F.lit(0.0)).alias("occupancy"),
    )
    return rows.withColumn("radius", vdw_radius(F.col("element"), F.coalesce("type_symbol", F.lit("X")))).drop("type_symbol")


def read_json(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """Atoms of JSON files of arrays x, y, z, r and, if given, residue, atom_name, element. Arrays of unequal length fail the query if strict, else the file is one row without a place, whose column fault says so."""
    kind = "x array<double>, y array<double>, z array<double>, r array<double>, residue array<string>, atom_name array<string>, element array<int>"
    rows = contents(spark, paths, "json").select("structure_id", F.from_json(F.col("content").cast("string"), kind).alias("j")).select("structure_id", "j.*")
    n = F.coalesce(F.size("x"), F.lit(-1))
    uneven = n < 0
    for c in ("y", "z", "r"):
        uneven = uneven | F.coalesce(F.size(c) != n, F.lit(True))
    for c in ("residue", "atom_name", "element"):
        uneven = uneven | F.coalesce((F.size(c) != n) & F.col(c).isNotNull(), F.lit(False))
    if not strict:
        rows = rows.withColumn("fault", F.when(uneven, "arrays of unequal length"))
        one = lambda c, kind: F.when(F.col("fault").isNotNull(), F.array(F.lit(None).cast(kind))).otherwise(F.col(c))
        rows = rows.withColumns({c: one(c, k) for c, k in (("x", "double"), ("y", "double"), ("z", "double"), ("r", "double"), ("residue", "string"), ("atom_name", "string"), ("element", "int"))})
    else:
        rows = rows.withColumn("x", F.when(uneven, F.raise_error(F.concat(F.lit("arrays of unequal length in "), F.col("structure_id"))).cast("array<double>")).otherwise(F.col("x")))
    for c, k in (("residue", "string"), ("atom_name", "string"), ("element", "int")):
        rows = rows.withColumn(c, F.coalesce(c, F.transform("x", lambda _: F.lit(None).cast(k))))
    extra = [] if strict else ["fault"]
    rows = rows.select("structure_id", *extra, F.posexplode(F.arrays_zip("x", "y", "z", "r", "residue", "atom_name", "element")).alias("atom_index", "a"))
    null = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "structure_id", "atom_index", null("int").alias("model_num"), F.lit("ATOM").alias("record"), "a.x", "a.y", "a.z", "a.element", "a.atom_name", "a.residue", F.lit("").alias("chain"), F.lit("").alias("auth_chain"),
        F.lit(0).alias("residue_num"), F.lit("").alias("ins_code"), F.lit(" ").alias("alt_loc"), F.lit(0.0).alias("occupancy"), F.col("a.r").alias("radius"), *extra,
    )


def read_structures(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Atoms of the PDB, mmCIF and JSON files of a folder; structures of one name in two formats would meet, so names have to be unique. Unless strict, faulty files have a fault in place of an error."""
    return read_pdb(spark, path).unionByName(read_mmcif(spark, path, strict=strict), allowMissingColumns=True).unionByName(read_json(spark, path, strict=strict), allowMissingColumns=True)


def structure_files(spark: SparkSession, path: str) -> DataFrame:
    """path and structure_id of the supported files of a folder in bytewise order of paths, for a batch to name what it should hold; nothing is read but the listing."""
    files = spark.read.format("binaryFile").load(path).select("path").where(is_supported(F.col("path")))
    return files.withColumn("structure_id", structure_id(F.col("path"))).orderBy("path")


def read_components(spark: SparkSession, paths: str | list[str], ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """comp_atoms and comp_bonds of component dictionaries in CIF (also those inside mmCIF structures), of the named components only if ids are given."""
    files = contents(spark, paths, "mmcif")
    a = _cif_frame(spark, files, "_chem_comp_atom", ["comp_id", "atom_id", "type_symbol", "pdbx_aromatic_flag", "pdbx_leaving_atom_flag"])
    b = _cif_frame(spark, files, "_chem_comp_bond", ["comp_id", "atom_id_1", "atom_id_2", "value_order", "pdbx_aromatic_flag"])
    if ids is not None:
        a, b = a.where(F.col("comp_id").isin(ids)), b.where(F.col("comp_id").isin(ids))
    flag = lambda c: F.coalesce(F.upper(c) == "Y", F.lit(False))
    atoms = a.select("comp_id", F.col("row").alias("idx"), "atom_id", "type_symbol", flag("pdbx_aromatic_flag").alias("aromatic"), flag("pdbx_leaving_atom_flag").alias("leaving"))
    ends = [atoms.select("comp_id", F.col("atom_id").alias(f"atom_id_{i}"), F.col("idx").alias(f"atom_idx_{i}")) for i in (1, 2)]
    bonds = b.join(ends[0], ["comp_id", "atom_id_1"]).join(ends[1], ["comp_id", "atom_id_2"])
    return atoms, bonds.select("comp_id", "atom_idx_1", "atom_idx_2", F.col("value_order").alias("bond_order"), flag("pdbx_aromatic_flag").alias("aromatic"))


def read_chain_map(spark: SparkSession, path: str) -> DataFrame:
    """filename, chains (array), id, asym_id_type of a CSV with a header in any case, or of a JSON array of objects (.json); rows checked by checked_map()."""
    rows = _map_rows(spark, path, ["chains"])
    return checked_map(rows.select("filename", "chains", "id", "asym_id_type"))


def read_interface_map(spark: SparkSession, path: str) -> DataFrame:
    """filename, partner_a and partner_b (arrays), id, asym_id_type of a CSV or JSON file, checked as chain maps are; no partner may be empty."""
    rows = _map_rows(spark, path, ["partner_a", "partner_b"])
    either = F.when((F.size("partner_a") > 0) & (F.size("partner_b") > 0), F.concat("partner_a", "partner_b"))
    return checked_map(rows.select("filename", "partner_a", "partner_b", "id", "asym_id_type", either.alias("chains"))).drop("chains")


def _map_rows(spark: SparkSession, path: str, lists: list[str]) -> DataFrame:
    """Rows of a map file: texts of lists split at commas, asym_id_type label or auth in lower case, label where there is none."""
    if path.lower().endswith(".json"):
        rows = spark.read.schema(", ".join(["filename string", "id string", *(f"{c} array<string>" for c in lists), "asym_id_type string"])).option("multiLine", True).option("mode", "FAILFAST").json(path)
    else:
        rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
        rows = rows.toDF(*[c.strip("\ufeff ").lower() for c in rows.columns])
        if missing := [c for c in ("filename", *lists) if c not in rows.columns]:
            raise InputError(f"map columns needed: {', '.join(missing)}")
        rows = rows.withColumns({c: F.split(c, ",") for c in lists})
    for c in ("id", "asym_id_type"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    kind = F.coalesce(F.nullif(F.lower(F.trim("asym_id_type")), F.lit("")), F.lit("label"))
    return rows.withColumns({c: F.transform(c, lambda x: F.trim(x)) for c in lists} | {"asym_id_type": kind})


def matched_files(entries: DataFrame, structures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries whose filename is one of structures, errors: filename and error of the entries without a file and the files without an entry). Rows of structures may repeat a filename."""
    there = structures.select("filename").distinct().withColumn("__file", F.lit(True))
    named = entries.select("filename").distinct().withColumn("__entry", F.lit(True))
    both = there.join(named, "filename", "full_outer")
    error = F.when(F.col("__file").isNull(), "input file not found").when(F.col("__entry").isNull(), "file is not in the map")
    return entries.join(there, "filename", "left_semi"), both.select("filename", error.alias("error")).where("error IS NOT NULL")


def is_plain_name(name: Column) -> Column:
    """A file name that leads nowhere else: not empty, without slashes, not . or .."""
    return (name != "") & ~name.rlike(r"[/\\]|^[.][.]?$")


def checked_map(rows: DataFrame) -> DataFrame:
    """rows, or an error: file names are plain, an id is needed where a file repeats, ids are unique, a file has one asym_id_type, label or auth, chains are not empty."""
    per = rows.groupBy("filename").agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.count_distinct("asym_id_type").alias("types"), F.max((F.size("chains") == 0) | F.exists("chains", lambda c: c == "")).alias("blank"), F.max(~F.col("asym_id_type").isin("label", "auth")).alias("kind"))
    per = per.withColumn("plain", is_plain_name(F.coalesce("filename", F.lit(""))))
    bad = per.where("(n > 1 AND ids < n) OR types > 1 OR kind OR blank OR blank IS NULL OR NOT plain").limit(1).collect()
    twice = rows.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).collect()
    if bad or twice:
        raise InputError(f"chain map: check {bad[0].filename if bad else twice[0].id}")
    return rows
