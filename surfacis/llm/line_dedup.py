"""Reversible line dedup: sharded cuckoo filters in front of an exact table of reference counts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stage

#: Keys to a filter shard, and lines that one probe task takes at a time.
SHARD_KEYS, PROBE_LINES = 32768, 16384


class CuckooFilter:
    """Four 16-bit fingerprints to a bucket; keys are pairs of 64-bit digests. Deleting a key that was put in once takes exactly it out."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        n = 1 << max(1, math.ceil(math.log2(max(1, capacity) / self.SLOTS / 0.85)))
        self.table = np.zeros((n, self.SLOTS), np.uint16) if table is None else table

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))

    def _places(self, d1: np.ndarray, d2: np.ndarray):
        mask = np.uint64(len(self.table) - 1)
        mark = (d2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        a = d1.astype(np.uint64) & mask
        return mark, a, (a ^ self._mix(mark)) & mask

    def contains(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(d1, d2)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, d1: np.ndarray, d2: np.ndarray) -> bool:
        """False if a key found no place; the caller then builds a larger filter."""
        mask, rng = len(self.table) - 1, np.random.default_rng(7)
        for m, *places in zip(*(x.tolist() for x in self._places(d1, d2))):
            at = next((p for p in places if (self.table[p] == 0).any()), None)
            if at is None:
                at = places[0]
                for _ in range(self.KICKS):
                    s = int(rng.integers(self.SLOTS))
                    m, self.table[at, s] = int(self.table[at, s]), m
                    at = (at ^ int(self._mix(np.array([m]))[0])) & mask
                    if (self.table[at] == 0).any():
                        break
                else:
                    return False
            self.table[at, int(np.argmin(self.table[at] != 0))] = m
        return True

    def delete(self, d1: np.ndarray, d2: np.ndarray) -> None:
        for m, *places in zip(*(x.tolist() for x in self._places(d1, d2))):
            for p in places:
                if len(at := np.flatnonzero(self.table[p] == m)):
                    self.table[p, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def of_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())


def filter_of(d1: np.ndarray, d2: np.ndarray) -> CuckooFilter:
    room = max(8, len(d1))
    while not (f := CuckooFilter(room)).insert(d1, d2):
        room *= 2
    return f


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            at: dict[bytes, list[int]] = {}
            for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                if key := line.strip(b" \t\n\r\x0b\x0c").lower():
                    at.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(i)
            two = np.frombuffer(b"".join(at), "<i8").reshape(-1, 2).tolist() if at else []
            out.append([{"d1": a, "d2": b, "at": p} for (a, b), p in zip(two, at.values())])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(out, pa.list_(pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("at", pa.list_(pa.int32()))])))], ["id", "h", "keys"])


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs and distinct key in it: id, h (a hash of the text, so that rows sharing an id stay apart), the key's 128-bit digest d1, d2 and the line numbers at."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(_keys, f"id {kind}, h long, keys array<struct<d1:long,d2:long,at:array<int>>>")
    return found.select("id", "h", F.explode("keys").alias("k")).select("id", "h", "k.d1", "k.d2", "k.at")


def _shard(n: int) -> Column:
    return F.pmod(F.col("d1").bitwiseXOR(F.shiftright("d1", 32)), F.lit(n)).cast("int")


def _documents(keys: DataFrame) -> DataFrame:
    """id, h and n, how often the document is in keys: each of its copies has one row for each of its keys."""
    return keys.groupBy("id", "h", "d1", "d2").agg(F.count("*").alias("n")).groupBy("id", "h").agg(F.max("n").alias("n"))


@dataclass
class LineIndex:
    """refs (d1, d2, n_docs): the exact number of documents with each key. filters (shard, filter): cuckoo filters of the keys with min_docs or more. documents (id, h, n): what is in the index."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    documents: DataFrame

    @classmethod
    def build(cls, keys: DataFrame, min_docs: int) -> LineIndex:
        """The index of documents given by their line_keys(). Repeated documents count each time."""
        refs = stage(keys.groupBy("d1", "d2").agg(F.count("*").alias("n_docs")), "line-refs")
        return cls._of(refs, min_docs, _documents(keys))

    @classmethod
    def _of(cls, refs: DataFrame, min_docs: int, documents: DataFrame) -> LineIndex:
        hot = refs.where(F.col("n_docs") >= min_docs)
        shards = max(1, math.ceil(hot.count() / SHARD_KEYS))

        def made(key, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [key[0]], "filter": [filter_of(pdf["d1"].to_numpy(), pdf["d2"].to_numpy()).to_bytes()]})

        filters = hot.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(made, "shard int, filter binary")
        return cls(refs, stage(filters, "line-filters"), shards, min_docs, documents)

    def _changed(self, keys: DataFrame, sign: int) -> LineIndex:
        """Counts move by the documents' keys; only keys that cross the threshold touch their shard's filter. No document is taken out more often than it is in."""
        held, copies = self.documents.select(F.col("id").alias("was_id"), F.col("h").alias("was_h"), "n"), keys.groupBy("id", "h", "d1", "d2").agg(F.count("*").alias("copies"))
        if sign < 0:
            copies = copies.join(held, F.col("id").eqNullSafe(F.col("was_id")) & F.col("h").eqNullSafe(F.col("was_h"))).select("id", "h", "d1", "d2", F.least("copies", "n").alias("copies"))
        copies = stage(copies, "line-copies")
        change = copies.groupBy("id", "h").agg((F.max("copies") * sign).alias("n"))
        documents = stage(self.documents.select("id", "h", "n").unionByName(change).groupBy("id", "h").agg(F.sum("n").alias("n")).where("n > 0"), "line-documents")
        moved = copies.groupBy("d1", "d2").agg((F.sum("copies") * sign).alias("by"))
        old = self.refs.select("d1", "d2", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("by"))
        both = old.unionByName(moved.select("d1", "d2", F.lit(0).cast("long").alias("was"), "by")).groupBy("d1", "d2").agg(F.sum("was").alias("was"), (F.sum("was") + F.sum("by")).alias("n_docs"))
        both = stage(both, "line-moves")
        crossed = both.where((F.col("was") >= self.min_docs) != (F.col("n_docs") >= self.min_docs)).select(_shard(self.shards).alias("shard"), "d1", "d2", (F.col("n_docs") >= self.min_docs).alias("up"))

        def apply(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.of_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(8)
            down, up = new[~new["up"].astype(bool)], new[new["up"].astype(bool)]
            f.delete(down["d1"].to_numpy(), down["d2"].to_numpy())
            fits = f.insert(up["d1"].to_numpy(), up["d2"].to_numpy())
            return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()], "fits": [fits]})

        filters = stage(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(apply, "shard int, filter binary, fits boolean"), "line-filters")
        refs = both.where("n_docs > 0").select("d1", "d2", "n_docs")
        if not filters.where("NOT fits").isEmpty():  # a full shard: all are laid out anew from the exact table
            return self._of(refs, self.min_docs, documents)
        return LineIndex(refs, filters.drop("fits"), self.shards, self.min_docs, documents)

    def insert(self, keys: DataFrame) -> LineIndex:
        """The index with these documents as well; one that is in it already counts once more."""
        return self._changed(keys, 1)

    def delete(self, keys: DataFrame) -> LineIndex:
        """The index without these documents, as if they had never been in it; one that isn't in it, or not so often, is passed over."""
        return self._changed(keys, -1)

    def hits(self, keys: DataFrame, rows: int | None = None) -> DataFrame:
        """Rows of keys whose key min_docs documents or more have: those that the filters let through, then held against the exact table.

        A shard's lines are dealt to cells of about PROBE_LINES lines by document, each with a copy of the
        shard's filter. Lines are counted for each shard here (rows, their number in all, is no longer needed), so that a shard with a line of a third of all documents has as many more cells.
        """
        lines = keys.withColumn("shard", _shard(self.shards))
        cells = stage(lines.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_LINES).cast("int").alias("cells")), "line-cells")
        copies = self.filters.join(cells, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        lines = lines.join(cells, "shard").withColumn("salt", F.pmod(F.xxhash64("id", "h"), F.col("cells")).cast("int"))

        def probe(key, f: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            if not len(f) or not len(pdf):
                return pdf.iloc[:0][names]
            return pdf[CuckooFilter.of_bytes(f["filter"].iloc[0]).contains(pdf["d1"].to_numpy(), pdf["d2"].to_numpy())][names]

        names = keys.columns
        passed = copies.select("shard", "salt", "filter").groupBy("shard", "salt").cogroup(lines.groupBy("shard", "salt")).applyInPandas(probe, keys.schema)
        return passed.join(self.refs.where(F.col("n_docs") >= self.min_docs).select("d1", "d2"), ["d1", "d2"])


def drop_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col without the line numbers in dropped (id, h, at), and n_lines and n_dropped of each row."""
    of_text, of_id, of_hash, at, lines = free_names(docs, "text_hash", "gone_id", "gone_hash", "gone_at", "text_lines")
    gone = dropped.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias(at)).select(F.col("id").alias(of_id), F.col("h").alias(of_hash), at)
    rows = docs.withColumn(of_text, F.xxhash64(text_col)).join(gone, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(of_text) == F.col(of_hash)), "left")
    rows = rows.withColumn(lines, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    text = F.when(F.col(at).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.col(lines)[i]), "\n"))
    return rows.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(at), F.lit(0)).cast("long"), text_col: text}).drop(of_text, of_id, of_hash, at, lines)


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key (stripped of ASCII space, A-Z lower-cased, one code point at least) stands in min_docs documents or more.

    Returns the columns of docs with text_col cut, plus n_lines (before) and n_dropped; columns of docs
    with these two names are replaced. Null or empty text is one empty line and stays as it is. Every row
    counts as a document, also rows that repeat or share an id; a null id is an id like others. A line
    counts once for each document. An empty table gives an empty table.
    """
    keys = stage(line_keys(docs, id_col, text_col), "line-keys")
    index = LineIndex.build(keys, min_docs)
    return drop_lines(docs.drop("n_lines", "n_dropped"), index.hits(keys), id_col, text_col)
