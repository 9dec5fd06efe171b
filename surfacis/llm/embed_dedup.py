"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected

#: Tables, projections to a table, and the width of a quantisation step for unit vectors. At a cosine of 0.9 (0.447 apart) one
#: projection agrees with probability 0.76, a table with 0.11 and some table with 0.95; at 0.95 some table with 0.998.
TABLES, PROJECTIONS, WIDTH, SEED = 24, 8, 1.5, 5
#: Vectors of a bucket to a tile; rows of tiles to a call of Python, about.
TILE, BATCH = 1024, 8192


def _hasher(tables: int, projections: int, width: float, seed: int):
    planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def buckets(x: np.ndarray) -> np.ndarray:
        """Per vector a 64-bit bucket in each table: quantised random (2-stable) projections, hashed together."""
        d = x.shape[1]
        if d not in planes:
            rng = np.random.default_rng([seed, d])
            planes[d] = rng.standard_normal((d, tables * projections)), rng.uniform(0, width, tables * projections)
        a, b = planes[d]
        cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, projections).astype(np.uint64)
        out = np.full((len(x), tables), d, np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(projections):
            out = (out ^ cells[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], {}
            for i, v in enumerate(batch.column("e").to_pylist()):
                x = np.array(v if v is not None and None not in v else [], np.float64)
                ids.append(None)
                if len(x) and np.isfinite(x).all() and (size := np.abs(x).max()) > 0:
                    x = x / size
                    rows[i] = x / np.sqrt(x @ x)
            unit, keys, g = [None] * len(ids), [None] * len(ids), [(None, None)] * len(ids)
            for d in {len(x) for x in rows.values()}:
                at = [i for i, x in rows.items() if len(x) == d]
                for i, k in zip(at, buckets(np.stack([rows[i] for i in at]))):
                    unit[i], keys[i] = rows[i].tolist(), k.tolist()
                    g[i] = tuple(np.frombuffer(hashlib.blake2b(rows[i].tobytes(), digest_size=16).digest(), np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in g], pa.int64()), pa.array([x[1] for x in g], pa.int64()), pa.array(unit, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))], ["id", "g1", "g2", "x", "keys"])

    return run


def spanning_links(close: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """Links (id, smallest id of its component) of a symmetric matrix's components: one for every row but the smallest of each."""
    free, out = close.any(1), []
    linked = np.flatnonzero(free)
    for root in linked[np.argsort(ids[linked], kind="stable")].tolist():
        todo = [root] if free[root] else []
        free[root] = False
        while todo:
            new = np.flatnonzero(close[todo.pop()] & free)
            free[new] = False
            out += [(ids[k], ids[root]) for k in new]
            todo += new.tolist()
    return out


def _tile_links(x: np.ndarray, keys: np.ndarray, ids: np.ndarray, copies: np.ndarray, tile: np.ndarray, t: int, least: float) -> tuple[np.ndarray, list[tuple]]:
    """Of one tile pair: how many vectors (copies counted) each links with, and the links that span them. A pair counts in the first table that it shares."""
    links, all_close = np.zeros(len(ids), np.int64), np.zeros((len(ids), len(ids)), bool)
    cross = tile.min() != tile.max()
    for i in range(0, len(ids), 256):
        close = x[i : i + 256] @ x.T >= least
        close &= (tile[i : i + 256, None] != tile[None]) if cross else ~np.eye(len(ids), dtype=bool)[i : i + 256]
        r, c = np.nonzero(close)
        if len(r):
            first = ~(keys[r + i, :t] == keys[c, :t]).any(1)
            np.add.at(links, r[first] + i, copies[c[first]])
            all_close[i : i + 256] = close
    return links, spanning_links(all_close | all_close.T, ids) if links.any() or all_close.any() else []


def _pairs(least: float):
    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        """Counts (u, null, n) and spanning links (u, v, 0) of a batch of tile pairs."""
        pdf = pdf.sort_values(["t", "key", "a", "b"], ignore_index=True)
        at = pdf[["t", "key", "a", "b"]].to_numpy()
        cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.append(cuts, len(pdf))
        vectors, keys = pdf["x"].to_numpy(), pdf["keys"].to_numpy()
        ids, copies, tile, t = (pdf[c].to_numpy() for c in ("id", "copies", "tile", "t"))
        u, v, n = [], [], []
        for i, j in zip(starts.tolist(), ends.tolist()):
            if j - i < 2:
                continue
            x = np.stack(vectors[i:j])
            if j - i == 2 and x[0] @ x[1] < least:
                continue
            links, out = _tile_links(x, np.stack(keys[i:j]), ids[i:j], copies[i:j], tile[i:j], int(t[i]), least)
            k = np.flatnonzero(links)
            u += ids[i:j][k].tolist() + [a for a, _ in out]
            v += [None] * len(k) + [b for _, b in out]
            n += links[k].tolist() + [0] * len(out)
        return pd.DataFrame({"u": pd.Series(u, dtype="Int64"), "v": pd.Series(v, dtype="Int64"), "n": pd.Series(n, dtype="int64")})

    return near


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """One row for each row of vectors: id_col, n_links, component_id, kept.

    Vectors link when a hash table brings them together and their cosine (in double precision) is cosine or
    more. n_links counts other vectors linked directly, component_id is the smallest id reachable, kept whether
    it is the row's own. Null, empty or zero vectors, ones with null or non-finite components, and ones of another
    length link with nothing. Vectors of one direction are a class: their links are counted, not listed. A bucket is compared by
    tiles of TILE classes, in bounded tasks whatever its size; each sends counts and a spanning forest of its links, one for each class at most.
    Rows that share an id are vectors of their own, whether equal or not: each counts as a link of the others and has its own row. Rows with a null id come back with no links. An empty table gives an empty table; other columns are dropped.
    """
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("e"))
    hashed = stage(rows.mapInArrow(_hasher(tables, projections, width, seed), f"id {kind}, g1 long, g2 long, x array<double>, keys array<long>"), "vec-hashes")
    usable = hashed.where("g1 IS NOT NULL AND id IS NOT NULL")
    classes = usable.groupBy("g1", "g2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first(F.struct("x", "keys")).alias("v"))
    reps = stage(classes.select(F.monotonically_increasing_id().alias("id"), "g1", "g2", "first", "copies", "v.x", "v.keys"), "vec-reps")
    which = reps.select("g1", "g2", F.col("id").alias("rep"), "copies")
    members = stage(hashed.select("id", "g1", "g2").join(which, ["g1", "g2"], "left").select("id", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"), "copies"), "vec-members")

    keyed = reps.select("id", F.posexplode("keys").alias("t", "key"))  # ids only: vectors come to those that share a bucket
    sizes = reps.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").count().where("count > 1")
    sizes = stage(sizes.select("t", "key", "count", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "vec-tiles")
    batches = int(sizes.agg(F.sum(F.col("count") * F.col("tiles"))).first()[0] or 0) // BATCH + 1
    tiled = keyed.join(sizes.drop("count"), ["t", "key"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("t", "key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id").join(reps.select("id", "x", "keys", "copies"), "id")
    tiled = tiled.withColumn("batch", F.pmod(F.xxhash64("t", "key", "a", "b"), F.lit(batches)))
    found = stage(tiled.groupBy("batch").applyInPandas(_pairs(cosine), "u long, v long, n long"), "vec-links")
    comp = connected(found.where("v IS NOT NULL").select("u", "v"))
    least = stage(comp.join(reps.select("id", "first"), "id").select("id", "component", "first"), "vec-components")
    least = least.select("id", "component").join(least.groupBy("component").agg(F.min("first").alias("least")), "component").select(F.col("id").alias("rep"), "least")
    links = found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    alone = reps.select(F.col("id").alias("rep"), "first")
    out = members.join(alone, "rep", "left").join(links, "rep", "left").join(least, "rep", "left")
    n_links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    out = out.select(F.col("id").alias(id_col), F.when(F.col("rep").isNull(), F.lit(0)).otherwise(n_links).cast("long").alias("n_links"), F.coalesce("least", "first", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
