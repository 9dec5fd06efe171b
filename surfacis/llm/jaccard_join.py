"""N-gram Jaccard join: sets cut into blocks by size band, joined block by block, weeded out by parity sketches, then verified."""

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

#: Size bands grow by this factor. Longs of the sketch that weeds out pairs before sets are compared. Members of a bucket to a tile. Rows of tiles to a call of Python, about.
BAND, SKETCH, TILE, BATCH = 2.2, 16, 1024, 16384
_SEGMENT = 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> _U(30)
    y ^= x
    y *= _U(0xBF58476D1CE4E5B9)
    y ^= y >> _U(27)
    y *= _U(0x94D049BB133111EB)
    y ^= y >> _U(31)
    return y


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


_P = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []


def _word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word between ASCII white space: a polynomial over its bytes, by prefix sums over the text."""
    b = np.frombuffer(raw, np.uint8)
    if not _tables or len(_tables[0]) <= len(b):
        n = max(1 << 16, 1 << (len(b) + 1).bit_length())
        _tables[:] = [np.cumprod(np.concatenate(([_U(1)], np.full(n - 1, p, np.uint64)))) for p in (_U(_P), _U(pow(_P, -1, 2**64)))]
    up, down = _tables
    word = np.concatenate(([False], (b != 32) & ((b < 9) | (b > 13)), [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate(([_U(0)], np.cumsum((b.astype(np.uint64) + _U(1)) * up[: len(b)])))
    return _mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words with A-Z lower-cased; long texts pass in segments cut at white space."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _SEGMENT)
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        parts.append(_word_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; with fewer words the whole sequence is one; empty without words."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, _U(size))
    for k in range(size):
        out *= _U(0xD6E8FEB86659FD93)
        out += w[k : len(w) - size + 1 + k]
    return _distinct(_mix(out))


def most_apart(total, p: int, q: int):
    """Largest symmetric difference of two sets of total elements together whose Jaccard similarity is p/q or more."""
    return total * (q - p) // (q + p)


def schemes(n: int, p: int, q: int) -> list[tuple[int, int]]:
    """(scheme, blocks) that a set of n elements takes part in: its size band's, and a border's if a partner may lie beyond it.

    Blocks are one more than elements can differ between any two linked sets of the scheme, so two
    linked sets agree in a block at least.
    """
    k, low = 0, 1
    while n >= (high := max(low + 1, int(low * BAND))):
        k, low = k + 1, high
    out = [(2 * k, most_apart(2 * (high - 1), p, q) + 1)]
    for at, edge in ((2 * k - 1, low), (2 * k + 1, high)):
        largest = (edge - 1) * q // p  # a smaller set's partner beyond the edge
        if edge > 1 and largest >= edge and edge * p <= n * q and n <= largest:
            out.append((at, most_apart(edge - 1 + largest, p, q) + 1))
    return out


def block_marks(s: np.ndarray, blocks: int) -> np.ndarray:
    """For each of blocks the XOR of the whole 64-bit hashes in it, 0 for a blank one; every element of the sorted set s lies in the block that its hash names.

    Equal blocks have equal marks, and different ones don't meet by chance. (A few parity bits for a block would: one element has some
    thousand patterns of them, and the rows that share one by chance grow with the square of the table.)
    """
    block = ((s >> _U(32)) * _U(blocks)) >> _U(32)
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))  # blocks follow the order of s
    marks = np.zeros(blocks, np.uint64)
    marks[block[starts].astype(np.int64)] = np.bitwise_xor.reduceat(s, starts)
    return marks


def wide_sketch(s: np.ndarray, p: int, q: int) -> np.ndarray:
    """Parity bits of a set, in a power of two of longs, SKETCH at least: four bits or more for each element that a linked set of the same size may differ in. XORing its halves gives the sketch of half the size."""
    longs = SKETCH
    while longs * 64 < 4 * most_apart(2 * len(s), p, q):
        longs *= 2
    odd = np.bincount((_mix(s) & _U(longs * 64 - 1)).astype(np.int64), minlength=longs * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def folded(sketch: np.ndarray, longs: int) -> np.ndarray:
    while len(sketch) > longs:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def needed(marks: np.ndarray, apart: int) -> np.ndarray:
    """Blocks whose keys a set gives out, if it differs from a linked set by apart elements at most: the first that hold apart + 1 which aren't blank, without the blank ones; all if it has fewer.

    Linked sets u and v differ in no more blocks than elements. Say that u's first blocks end no later than v's (or
    v gives out all): of the apart + 1 of u that aren't blank one agrees with v's, is thus not blank there, and v gives it out too.
    If both give out all blocks, one of them agrees. So blank blocks, which all small enough sets share, make no bucket.
    """
    full = np.flatnonzero(marks)
    return full[: apart + 1] if len(full) > apart else np.arange(len(marks))


def block_keys(s: np.ndarray, p: int, q: int) -> np.ndarray:
    out, n = [], len(s)
    for scheme, blocks in schemes(n, p, q):
        marks = block_marks(s, blocks)
        at = needed(marks, min(blocks - 1, most_apart(n + n * q // p, p, q)))
        out.append(_mix(marks[at] ^ _mix(at.astype(np.uint64) + _U(scheme << 40))))
    return np.concatenate(out).view(np.int64)


def _features(words: int, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                n, g1, g2, keys, sketch, wide = [], [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingle_set(text, words)
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    n.append(len(s))
                    g1.append(d[0])
                    g2.append(d[1])
                    keys.append(block_keys(s, p, q) if len(s) else np.zeros(0, np.int64))
                    w = wide_sketch(s, p, q)
                    sketch.append(folded(w, SKETCH).view(np.int64))
                    wide.append(w.tobytes() if len(w) > SKETCH else b"")
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64())), pa.array(wide, pa.binary())], ["id", "n", "g1", "g2", "keys", "sketch", "wide"])

    return run


#: Bits of the Bloom filters that spare a shuffle rows that can't join: 4 MB whatever the input; a full one lets all rows pass.
BLOOM_BITS = 1 << 25


def _bloom(df: DataFrame, h: str):
    """A broadcast bit array with two bits for each value of the hash column h, put together on the cluster."""
    mask = F.lit(BLOOM_BITS - 1).cast("long")
    at = F.explode(F.array(F.col(h).bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("p")
    words = df.select(at).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    bits = np.zeros(BLOOM_BITS // 64, np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(bits)


def _may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.astype(np.int64).view(np.uint64)
    a, b = h & _U(BLOOM_BITS - 1), (h >> _U(32)) & _U(BLOOM_BITS - 1)
    return ((bits[a >> _U(6)] >> (a & _U(63))) & (bits[b >> _U(6)] >> (b & _U(63))) & _U(1)).astype(bool)


def _kept_keys(bloom):
    """g and key of the keys that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            key, g = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(batch.column("g1").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            keep = _may_hold(bloom.value, key)
            yield pa.RecordBatch.from_arrays([pa.array(g[keep]), pa.array(key[keep])], ["g", "key"])

    return run


def _sets(words: int, bloom):
    """Sets of the texts whose id the filter lets through, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_may_hold(bloom.value, batch.column("h").to_numpy(zero_copy_only=False))))
            packed = [shingle_set(t, words).astype("<u8").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "s"])

    return run


def common(u: pd.Series, v: pd.Series) -> pd.Series:
    """Elements that two packed sets share."""
    return pd.Series([len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True)) for a, b in zip(u, v)], dtype="int64")


def _sketch_near(p: int, q: int) -> str:
    """SQL: two sketches differ in no more bits than linked sets have elements apart."""
    bits = " + ".join(f"bit_count(u_sketch[{i}] ^ v_sketch[{i}])" for i in range(SKETCH))
    return f"({bits}) * {q + p} <= (u_n + v_n) * {q - p} AND least(u_n, v_n) * {q} >= greatest(u_n, v_n) * {p}"


def similarity_links(docs: DataFrame, words: int, p: int, q: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links). members: id, n_shingles, rep for every row, rep the smallest id with the same shingle set (its own without words). links: u, v, pairs of reps with Jaccard similarity p/q or more that join all that such pairs connect.

    Two sets linked agree in a block of their size band (see schemes()), so every link shares a bucket. A bucket's
    rows aren't paired: its smallest id is its hub. First every row is held against its smallest hub, then against the others
    of another component; buckets that one component then holds are done. The rest of a bucket gets a new hub, and what is left after that is
    compared by tiles of TILE rows on bit sketches, across components only. Sets are compared exactly for what passes. Links
    within a component that are left out connect nothing new.
    """
    kind = dict(docs.dtypes)[id_col]
    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = every.where("id IS NOT NULL")
    made = every.mapInArrow(_features(words, p, q), f"id {kind}, n long, g1 long, g2 long, keys array<long>, sketch array<long>, wide binary")
    all_feats = stage(made, "jaccard-features")
    feats = all_feats.where("id IS NOT NULL")
    nodes = stage(feats.where("n > 0").groupBy("g1", "g2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "jaccard-nodes")
    same = nodes.select("g1", "g2", F.col("id").alias("rep"))
    members = stage(all_feats.select("id", "n", "g1", "g2").join(same, ["g1", "g2"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("rep")), "jaccard-members")
    nodes = nodes.drop("g2")

    keyed = feats.where("n > 0").select("g1", F.explode("keys").alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.min("g1").alias("a"), F.max("g1").alias("b")).where("a <> b").select("key"), "jaccard-keys")
    near = feats.where("n > 0").select("g1", "keys").mapInArrow(_kept_keys(_bloom(shared, "key")), "g long, key long").distinct()
    near = near.join(shared, "key").join(nodes.select(F.col("g1").alias("g"), "id"), "g").select("key", "id")
    buckets = stage(near, "jaccard-members-by-key")
    buckets = stage(buckets.join(buckets.groupBy("key").agg(F.min("id").alias("hub")), "key"), "jaccard-buckets")

    star = stage(_star_pairs(buckets, nodes, p, q), "jaccard-star")
    best = star.groupBy("v").agg(F.min_by(F.struct("u", "u_n", "v_n"), "u").alias("t")).select("t.u", "v", "t.u_n", "t.v_n")
    edges = _verified(best, nodes, texts, words, p, q, kind)
    comp = connected(edges)
    edges = edges.unionByName(_verified(_across(star, comp), nodes, texts, words, p, q, kind))
    for last in (False, True):
        comp = connected(edges)
        buckets = stage(_unsettled(buckets, comp), "jaccard-buckets")
        if buckets.isEmpty():
            break
        pairs = _tiled(buckets, nodes, p, q, kind) if last else _across(_star_pairs(buckets, nodes, p, q), comp)
        edges = edges.unionByName(_verified(pairs, nodes, texts, words, p, q, kind))
    return members, edges


def _star_pairs(buckets: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """Hub u and row v of every bucket, once each, whose sketches are near enough."""
    pairs = buckets.where("id <> hub").select(F.least("hub", "id").alias("u"), F.greatest("hub", "id").alias("v")).distinct()
    u = nodes.select(F.col("id").alias("u"), F.col("n").alias("u_n"), F.col("sketch").alias("u_sketch"))
    v = nodes.select(F.col("id").alias("v"), F.col("n").alias("v_n"), F.col("sketch").alias("v_sketch"))
    return pairs.join(v, "v").join(u, "u").where(_sketch_near(p, q)).select("u", "v", "u_n", "v_n")


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of two components."""
    a = comp.select(F.col("id").alias("u"), F.col("component").alias("a"))
    b = comp.select(F.col("id").alias("v"), F.col("component").alias("b"))
    return pairs.join(a, "u", "left").join(b, "v", "left").where("coalesce(a, u) <> coalesce(b, v)").select("u", "v", "u_n", "v_n")


def _unsettled(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (key, id, component, hub) of buckets without their old hub, which all rows have been held against, as far as several components are left; with a new hub."""
    rows = buckets.select("key", "id", "hub").where("id <> hub").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = rows.groupBy("key").agg(F.min("id").alias("hub"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key", "hub")
    return rows.join(mixed, "key")


def _wide_near(p: int, q: int):
    """UDF: whether two wide sketches, the larger folded to the size of the smaller, differ in no more bits than linked sets have elements apart. An empty one stands for a sketch that was compared before."""

    def run(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for x, y, m in zip(a, b, most):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            longs = min(len(x), len(y))
            out.append(not longs or int(np.bitwise_count(folded(x, longs) ^ folded(y, longs)).sum(dtype=np.int64)) <= m)
        return pd.Series(out, dtype="bool")

    return F.pandas_udf(run, "boolean")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, p: int, q: int, kind: str) -> DataFrame:
    """The pairs u, v whose shingle sets are similar enough. Wide sketches weed out most pairs of long texts, whose sets are large.
    Sets are made anew for texts in a pair that is left; a Bloom filter of their ids keeps the other texts out of every shuffle."""
    pairs = stage(pairs, "jaccard-pairs")
    wide = nodes.where("length(wide) > 0")
    far = pairs.join(wide.select(F.col("id").alias("v"), F.col("wide").alias("v_w")), "v", "left").join(wide.select(F.col("id").alias("u"), F.col("wide").alias("u_w")), "u", "left")
    none, most = F.lit(b""), F.floor((F.col("u_n") + F.col("v_n")) * (q - p) / (q + p))
    pairs = stage(far.where(_wide_near(p, q)(F.coalesce("u_w", none), F.coalesce("v_w", none), most)).select("u", "v", "u_n", "v_n"), "jaccard-near-pairs")
    if pairs.isEmpty():
        return pairs.select("u", "v")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = texts.withColumn("h", F.xxhash64("id")).mapInArrow(_sets(words, _bloom(ids.withColumn("h", F.xxhash64("id")), "h")), f"id {kind}, s binary")
    sets = stage(sets, "jaccard-sets")
    both = pairs.join(sets.select(F.col("id").alias("v"), F.col("s").alias("v_s")), "v").join(sets.select(F.col("id").alias("u"), F.col("s").alias("u_s")), "u")
    both = both.withColumn("common", F.pandas_udf(common, "long")("u_s", "v_s"))
    return stage(both.where(f"common * {q} >= (u_n + v_n - common) * {p}").select("u", "v"), "jaccard-links")


def _tiled(buckets: DataFrame, nodes: DataFrame, p: int, q: int, kind: str) -> DataFrame:
    """Pairs u, v, u_n, v_n across components in the same bucket whose sketches are near enough, by tiles of TILE rows, so that a bucket of any size is compared in bounded tasks; many tiles share a call of Python."""
    sized = stage(buckets.groupBy("key").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles")), "jaccard-tiles")
    batches = int(sized.agg(F.sum(F.col("rows") * F.col("tiles"))).first()[0]) // BATCH + 1
    rows = buckets.join(sized, "key").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id", "component").join(nodes.select("id", "n", "sketch"), "id")
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("key", "a", "b"), F.lit(batches)))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "a", "b"], ignore_index=True)
        sk, n = np.stack(pdf["sketch"].to_numpy()).astype(np.int64).view(np.uint64), pdf["n"].to_numpy()
        comp, ids, tile = pdf["component"].to_numpy(), pdf["id"].to_numpy(), pdf["tile"].to_numpy()
        cross = (pdf["a"] != pdf["b"]).to_numpy()
        at = pdf[["key", "a", "b"]].to_numpy()
        ends = np.append(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(ids))
        ends, out = np.repeat(ends, np.diff(ends, prepend=0)), []  # the end of each row's tile
        for i in range(len(ids)):
            if i + 1 == ends[i]:
                continue
            js = np.arange(i + 1, ends[i])
            js = js[(comp[js] != comp[i]) & ((tile[js] != tile[i]) if cross[i] else True)]
            if not len(js):
                continue
            js = js[(np.bitwise_count(sk[js] ^ sk[i]).sum(1, dtype=np.int64) * (q + p) <= (n[js] + n[i]) * (q - p)) & (np.minimum(n[js], n[i]) * q >= np.maximum(n[js], n[i]) * p)]
            out += [(*((ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])), n[i], n[j]) for j in js]
        return pd.DataFrame(out, columns=["u", "v", "u_n", "v_n"]).drop_duplicates(["u", "v"])

    return rows.groupBy("batch").applyInPandas(near, f"u {kind}, v {kind}, u_n long, v_n long").dropDuplicates(["u", "v"])


def jaccard_components(docs: DataFrame, words: int = 5, p: int = 4, q: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept.

    Texts link when their sets of distinct word shingles (A-Z lower-cased, ASCII white space between words)
    have a Jaccard similarity of p/q or more; component_id is the smallest id reachable, kept whether it is the
    row's own. Fewer words than a shingle count as one; null, empty or blank texts link with nothing. Rows that share
    an id must be copies (each is returned); a row without an id has the component
    of the rows whose set equals its own, or null, and links nothing itself. An
    empty table gives an empty table; other columns are dropped. Nothing is capped or sampled.
    """
    members, links = similarity_links(docs, words, p, q, id_col, text_col)
    comp = connected(links).select(F.col("id").alias("rep"), "component")
    out = members.join(comp, "rep", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(False)))
