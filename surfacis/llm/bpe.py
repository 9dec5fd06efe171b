"""Byte-level BPE by higher-order functions over a constant rank table."""

from __future__ import annotations

import base64
import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, shuffle_parts, stage

#: Frequent distinct words whose ids are looked up; part counts up to which a fold makes one merge a step.
DICTIONARY, SHORT = 524_288, 48
#: Bits of an id. A pair is two ids side by side; an entry of the rank table is a pair and the rank of both together.
BITS = 20
NONE = 1 << BITS
_END, _PLACE = NONE << 2 * BITS, NONE - 1 << BITS
#: Factors of the pairs' hashes; the second is where the search for one without clashes begins.
_A, _B, _C = 40_503, 7_919, 104_729


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def mergeable(ranks: dict[bytes, int]) -> np.ndarray:
    """left id, right id and rank of every two pieces that make a third."""
    found = [(ranks[whole[:i]], ranks[whole[i:]], rank) for whole, rank in ranks.items() for i in range(1, len(whole)) if whole[:i] in ranks and whole[i:] in ranks]
    return np.array(found, np.int64).reshape(-1, 3)


def unreached(ranks: dict[bytes, int]) -> dict[str, int]:
    """Pieces that merging their own bytes doesn't make, so that only a look-up of the whole word finds them."""
    out = {}
    for whole, rank in ranks.items():
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 1:
            least, i = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if least == NONE:
                out |= {whole.decode(): rank} if whole.decode("utf-8", "ignore").encode() == whole else {}
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return out


def rank_table(pairs: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A perfect hash of the pairs: a factor, shifts by group and the slots' entries, a power of two of each. ByteBpe.rank() looks it up."""
    size = 1 << max(4, int(2 * len(pairs)).bit_length())
    groups, left, right = size >> 3, pairs[:, 0], pairs[:, 1]
    group = (left * _A + right) & (groups - 1)
    for by in range(_B, 1 << 20, 2):
        home = (left * by + right * _C) & (size - 1)
        if len(np.unique(group * size + home)) == len(pairs):
            break
    entry = ((left << BITS | right) << BITS) | pairs[:, 2]
    shifts, slots, taken = np.zeros(groups, np.int64), np.full(size, 1 << 62, np.int64), bytearray(size)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for members in sorted(np.split(order, cuts) if len(order) else [], key=len, reverse=True):
        homes, mask = home[members].tolist(), size - 1
        shift = next(d for d in range(size) if not any(taken[(h + d) & mask] for h in homes))
        shifts[group[members[0]]] = shift
        for h, m in zip(homes, members.tolist()):
            taken[(h + shift) & mask] = 1
            slots[(h + shift) & mask] = entry[m]
    return by, shifts, slots


class ByteBpe:
    """Ranks as constants of a plan: one-row relations whose value scalar() puts where a literal would stand, so that plans and their texts hold a reference and not megabytes. tables() and their parts are bound once by let()."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.spark, self.pattern = spark, pattern
        self.by, shifts, slots = rank_table(mergeable(ranks))
        self.groups, self.size = len(shifts), len(slots)
        by_id, top = {v: k for k, v in ranks.items()}, max(ranks.values(), default=0)
        self.by_id = [by_id.get(i, b"") for i in range(top + 1)]
        if top >= NONE:
            raise ValueError(f"ranks have to be below {NONE}")
        values = {
            "shifts": (shifts, pa.int64()), "slots": (slots, pa.int64()), "bytes": ([ranks.get(bytes([b])) for b in range(256)], pa.int64()),
            "pieces": ([by_id.get(i) for i in range(top + 1)], pa.binary()), "packed": ([i.to_bytes(4, "little") for i in range(top + 1)], pa.binary()),
        }
        table = pa.table({n: pa.array([v], pa.list_(t)) for n, (v, t) in values.items()})
        row = spark.createDataFrame(table)
        self.constants = row.select("shifts", "slots", "bytes", F.col("pieces").cast("array<string>").alias("pieces"), F.col("packed").cast("array<string>").alias("packed"))
        self.unreached = unreached(ranks)

    def with_constants(self, df: DataFrame, body, name: str) -> DataFrame:
        """df with the column name: body of the constants. They enter by a column that is read once, so that the optimizer puts the subquery into its place and no row carries them."""
        whole = self.constants.select(F.struct("*").alias("v")).scalar()
        return df.withColumn("__t", whole).withColumn(name, let(F.col("__t"), body)).drop("__t")

    def words(self, text: Column) -> Column:
        """The matches of the pattern, each to be encoded on its own."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + self.pattern), F.lit(0))

    def rank(self, t: Column, a: Column, b: Column) -> Column:
        """Rank of two parts together, or NONE and more: an entry of the table without its pair, or against another's."""
        group = (a * _A + b).bitwiseAND(F.lit(self.groups - 1))
        slot = (a * self.by + b * _C + t["shifts"][group]).bitwiseAND(F.lit(self.size - 1))
        return F.shiftleft(F.shiftleft(a, BITS).bitwiseOR(b), BITS).bitwiseXOR(t["slots"][slot])

    def fold(self, t: Column, word: Column) -> Column:
        """Ids of a word: its bytes' ids, of which the leftmost pair of least rank merges until no pair has a rank. The state is an array of longs, each a part: the rank of the pair it begins, its place in the word and its id, so that the least is the pair to merge. Words of over SHORT bytes merge all places of a pair in one step, where that gives the same."""
        start = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), F.lit(""), -1), lambda c: t["bytes"][F.ascii(c)])

        def short(p: Column) -> Column:
            first = F.transform(p, lambda a, i: self.part(self.rank(t, a, F.get(p, i + 1)), F.shiftleft(i.cast("long"), BITS), a))
            folded = lambda s: F.aggregate(s, s, lambda x, _: F.when(F.array_min(x) >= _END, x).otherwise(self.step(t, x)))
            return let(first, lambda s: F.transform(folded(s), lambda e: e.bitwiseAND(F.lit(NONE - 1))))

        def long(p: Column) -> Column:
            first = let(self.ranks_of(t, p), lambda r: self.state(p, r))
            return F.aggregate(p, first, lambda s, _: F.when(s["m"] >= NONE, s).otherwise(self.wide_step(t, s)), lambda s: s["p"])

        by_merges = let(start, lambda p: F.when(F.size(p) <= SHORT, short(p)).otherwise(long(p))).cast("array<int>")
        if not self.unreached:
            return by_merges
        whole = F.create_map(*[F.lit(x) for kv in self.unreached.items() for x in kv])[word]
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(by_merges)

    def part(self, rank: Column, placed: Column, id: Column) -> Column:
        """A part as one long; placed is its place, shifted by BITS."""
        return F.shiftleft(F.least(rank, F.lit(NONE).cast("long")), 2 * BITS).bitwiseOR(placed).bitwiseOR(id)

    def step(self, t: Column, s: Column) -> Column:
        """Merge the leftmost pair of least rank: its first part becomes the merged one, its second goes, and the part before gets a new rank. No two parts are equal, as each has its place."""
        id = lambda e: e.bitwiseAND(F.lit(NONE - 1))
        placed = lambda e: e.bitwiseAND(F.lit(_PLACE))

        def merged(m: Column, k: Column) -> Column:
            made = F.shiftright(m, 2 * BITS)
            own = self.part(self.rank(t, made, id(F.get(s, k + 1))), placed(m), made)
            before = lambda e: self.part(self.rank(t, id(e), made), placed(e), id(e))
            return F.transform(F.array_remove(s, F.get(s, k)), lambda e, i: F.when(e == m, own).when(i == k - 2, before(e)).otherwise(e))

        return let(F.array_min(s), lambda m: let(F.array_position(s, m).cast("int"), lambda k: merged(m, k)))

    def ranks_of(self, t: Column, p: Column) -> Column:
        return F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: self.rank(t, a, b))

    def state(self, p: Column, r: Column) -> Column:
        """Parts, ranks of pairs and the least of these."""
        return F.struct(p.alias("p"), r.alias("r"), F.coalesce(F.array_min(r), F.lit(NONE).cast("long")).alias("m"))

    def one_step(self, t: Column, s: Column) -> Column:
        """Merge the leftmost pair of least rank of a long word."""
        p, m = s["p"], s["m"]
        merged = lambda i: let(F.concat(F.slice(p, 1, i - 1), F.array(m), F.slice(p, i + 2, F.size(p))), lambda q: let(self.ranks_of(t, q), lambda x: self.state(q, x)))
        return let(F.array_position(s["r"], m).cast("int"), merged)

    def wide_step(self, t: Column, s: Column) -> Column:
        """Merge every place of the leftmost pair of least rank, from the left, if no other pair has that rank and no new pair a lower one; else the leftmost place only."""
        p, r, m = s["p"], s["r"], s["m"]
        name = lambda x: F.concat(F.lpad(x.cast("string"), 7, "0"), F.lit(";"))

        def merged(i: Column) -> Column:
            joined = F.replace(F.array_join(F.transform(p, name), ""), F.concat(name(p[i - 1]), name(p[i])), name(m))
            parts = F.transform(F.split(F.rtrim(joined, F.lit(";")), F.lit(";"), -1), lambda x: x.cast("bigint"))
            same = F.zip_with(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: (a == p[i - 1]) & (b == p[i])), r, lambda x, y: x | (y != m))
            after = let(parts, lambda q: let(self.ranks_of(t, q), lambda x: self.state(q, x)))
            return let(after, lambda n: F.when(F.forall(same, lambda x: x) & (n["m"] > m), n).otherwise(self.one_step(t, s)))

        return let(F.array_position(r, m).cast("int"), merged)

    def with_dictionary(self, docs: DataFrame, text_col: str, words: int = DICTIONARY) -> ByteBpe:
        """Fold the most frequent distinct words of all docs once. They come in buckets of two by their hash, the most frequent first, as one more constant whose size is bounded by words; a word that isn't in it is folded where it stands, to the same ids."""
        counted = docs.select(F.explode(self.words(F.col(text_col))).alias("w")).groupBy("w").count()
        top = counted.orderBy(F.desc("count"), "w").limit(words).repartition(shuffle_parts(self.spark), "w")
        top = stage(self.with_constants(top, lambda t: self.word(t, F.col("w")), "v"), "bpe-words")
        self.buckets = 1 << max(4, top.count().bit_length())
        of = F.xxhash64("w").bitwiseAND(F.lit(self.buckets - 1)).alias("bucket")
        pairs = top.groupBy(of).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "w", "v"))), 1, 2).alias("e"))
        entry = F.struct(F.get("e.w", F.lit(0)).alias("w"), F.get("e.v", F.lit(0)).alias("v"), F.get("e.w", F.lit(1)).alias("w2"), F.get("e.v", F.lit(1)).alias("v2"))
        every = self.spark.range(self.buckets).withColumnRenamed("id", "bucket").join(pairs, "bucket", "left").select("bucket", entry.alias("e"))
        known = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "e"))), lambda x: x["e"]).alias("known"))
        self.constants = self.constants.drop("known").join(F.broadcast(known))
        return self

    def word(self, t: Column, word: Column) -> Column:
        """A word's ids, these packed as four bytes each, and their binary pieces; bytes are held as strings, which needn't be UTF-8, for array_join()."""
        joined = lambda ids, part: F.array_join(F.transform(ids, lambda i: t[part][i]), "").alias(part)
        return let(self.fold(t, word), lambda ids: F.struct(ids.alias("ids"), joined(ids, "packed"), joined(ids, "pieces")))

    def dictionary(self, docs: DataFrame, text_col: str, words: int = DICTIONARY) -> pa.Table:
        """w and ids of the most frequent distinct words of all docs, each folded once. Its size is bounded by words."""
        counted = docs.select(F.explode(self.words(F.col(text_col))).alias("w")).groupBy("w").count()
        top = counted.orderBy(F.desc("count"), "w").limit(words).select("w").repartition(shuffle_parts(self.spark), "w")
        return stage(self.with_constants(top, lambda t: self.fold(t, F.col("w")), "ids"), "bpe-words").toArrow()

    def split(self, docs: DataFrame, text_col: str, known: pa.Table) -> DataFrame:
        """docs with the words of the dictionary encoded and decoded: rest, the other words in their order, and ids, ids_packed and decoded of the stretches before, between and behind them, one more than rest."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, known.schema) as out:
            out.write_table(known)
        shared, key = self.spark.sparkContext.broadcast(sink.getvalue()), uuid.uuid4().hex
        pieces, pattern, names = self.by_id, self.pattern, docs.columns

        def run(batches):
            piece = pieces.__getitem__
            find, known_ids = _loaded(key, shared, pattern)
            for whole in batches:
                for i in range(0, whole.num_rows, 512):
                    batch = whole.slice(i, 512)
                    rest, ids, texts = [], [], []
                    for text in batch.column(text_col).to_pylist():
                        words = find(text or "")
                        found = list(map(known_ids, words))
                        own, stretches, at = [], [], 0
                        for _ in range(found.count(None)):
                            j = found.index(None, at)
                            own.append(words[j])
                            stretches.append(b"".join(found[at:j]))
                            at = j + 1
                        stretches.append(b"".join(found[at:]))
                        rest.append(own)
                        ids.append(stretches)
                        decoded = list(map(piece, np.frombuffer(b"".join(stretches), "<u4").tolist()))
                        cuts = [0, *itertools.accumulate(len(x) // 4 for x in stretches)]
                        texts.append([b"".join(decoded[a:b]) for a, b in zip(cuts, cuts[1:])])
                    packed = pa.array(ids, pa.list_(pa.binary()))
                    flat = np.frombuffer(b"".join(x for xs in ids for x in xs), "<i4")
                    ends = np.cumsum([0, *(len(x) // 4 for xs in ids for x in xs)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(packed.offsets, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rest, pa.list_(pa.string())), lists, packed, pa.array(texts, pa.list_(pa.binary()))], [*names, "__rest", "__ids", "__packed", "__decoded"])

        more = T.StructType.fromDDL("__rest array<string>, __ids array<array<int>>, __packed array<binary>, __decoded array<binary>")
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more.fields]))

    def coded(self, t: Column) -> Column:
        """ids (array of int), ids_packed (little-endian unsigned 32-bit integers) and decoded (the binary pieces of ids, concatenated) of a row of split(): its other words are folded and put between the stretches."""

        def between(stretches: Column, part: Column) -> Column:
            return F.array_join(F.flatten(F.zip_with(stretches, part, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "").cast("binary")

        def whole(c: Column) -> Column:
            none = F.array().cast("array<int>")
            ids = F.flatten(F.flatten(F.zip_with(F.col("__ids"), c["ids"], lambda a, b: F.array(a, F.coalesce(b, none)))))
            packed, decoded = (between(F.col(n).cast("array<string>"), c[p]) for n, p in (("__packed", "packed"), ("__decoded", "pieces")))
            return F.struct(ids.alias("ids"), packed.alias("ids_packed"), decoded.alias("decoded"))

        return let(F.transform("__rest", lambda w: self.word(t, w)), whole)


_memo: list = []


def _loaded(key: str, shared, pattern: str):
    """The word finder and the dictionary of a broadcast, kept by the Python worker for its next tasks."""
    if not _memo or _memo[0] != key:
        import regex

        table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        ids = table.column("ids").combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), (np.cumsum([0, *pc.list_value_length(ids).to_pylist()]) * 4).tolist()
        _memo[:] = [key, regex.compile(pattern).findall, {w: flat[a:b] for w, a, b in zip(table.column("w").to_pylist(), ends, ends[1:])}.get]
    return _memo[1:]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", dictionary: int = DICTIONARY) -> DataFrame:
    """docs with ids (array of int), ids_packed (little-endian unsigned 32-bit integers) and decoded (binary), the bytes that ids stand for.

    Null text counts as empty: no ids, no bytes. Every row is encoded on its own, whatever repeats; columns of
    these names are replaced, others stay. An empty table gives an empty table. A word takes time by its bytes squared up to
    SHORT bytes and by its bytes times the distinct merges in it beyond.
    """
    bpe, docs = ByteBpe(docs.sparkSession, load_ranks(ranks_path), pattern), docs.drop("ids", "ids_packed", "decoded")
    rows = bpe.split(docs, text_col, bpe.dictionary(docs, text_col, dictionary))
    return bpe.with_constants(rows, bpe.coded, "__coded").select(*docs.columns, "__coded.*")
