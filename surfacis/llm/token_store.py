"""Token-id output as a content-addressed store: rolling-hash chunks stored once, recipes, Merkle manifests."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_ranges, new_path, running_sum, stage

#: Ids in the rolling window; chunks have LEAST to MOST ids, about MEAN.
WINDOW, LEAST, MEAN, MOST = 16, 128, 512, 2048
#: Words and chunk keys that a Python worker remembers at most.
MEMO_WORDS, MEMO_KEYS = 300_000, 200_000
#: Bytes of texts, about, that a worker splits into words at a time; longer texts are cut at white space for that.
PIECE = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_tokenizers: dict[str, Encoder] = {}


def cut_points(coded: list[bytes], kind: np.dtype) -> list[list[int]]:
    """Ends of the chunks of every list of packed ids: where the polynomial hash of the last WINDOW ids falls on a pattern, LEAST to MOST ids apart."""
    gap = WINDOW - 1  # zeros between the lists, so that no window sees ids of the list before
    ids = np.frombuffer(bytes(gap * kind.itemsize).join(coded), kind)
    sizes = np.array([len(raw) // kind.itemsize for raw in coded], np.int64)
    stops = np.cumsum(sizes + gap) - gap
    rolled = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(32)
    rolled[(stops[:-1, None] + np.arange(gap)).ravel()] = 0
    step, power = 1, int(_P)
    while step < WINDOW:  # windows of twice the ids from two neighbours; WINDOW is a power of 2
        rolled[step:] += rolled[:-step] * np.uint64(power)
        step, power = 2 * step, power * power % 2**64
    hits = np.flatnonzero((rolled >> np.uint64(40)).astype(np.uint32) % np.uint32(MEAN - LEAST) == 0) + 1
    places = np.searchsorted(hits, stops, "right").tolist()
    out, hits, i = [], hits.tolist(), 0
    for n, stop, k in zip(sizes.tolist(), stops.tolist(), places):
        ends, last, start = [], 0, stop - n
        for p in [*(h - start for h in hits[i:k] if h > start), n]:
            while p - last > MOST:
                last += MOST
                ends.append(last)
            if p - last >= LEAST or p == n and p > last:
                last = p
                ends.append(p)
        out.append(ends)
        i = k
    return out


def merkle(keys: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is."""
    while len(keys) > 1:
        keys = [hashlib.blake2b(b"".join(keys[i : i + 2]), digest_size=16).digest() if i + 1 < len(keys) else keys[i] for i in range(0, len(keys), 2)]
    return keys[0] if keys else hashlib.blake2b(b"", digest_size=16).digest()


#: The parts of a tokenizer file for which words may be encoded one by one, as encode_words() does.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SUFFIX = "</w>"
#: Words to a text, and such texts to a call of the tokenizers library.
_JOINED = 64
#: ASCII white space; closing punctuation; letters and digits; last bytes of the letters of Latin-1 whose first byte is 0xC3.
_SPACE, _MARKS, _ALNUM, _SECOND = b" \t\n\r\x0b\x0c", b".,;:!?*#$%&|", bytes(c for c in range(128) if chr(c).isalnum()), bytes(c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7))
_GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: The number of these kinds, from 1 on, for every byte; 0 for all others.
_KINDS = bytes(next((k for k, some in enumerate((_SPACE, _MARKS, _ALNUM, _SECOND), 1) if c in some), 0) for c in range(256))
#: Words of lower-case letters of Latin-1.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def split_words(raw: bytes) -> tuple[pa.BinaryArray, np.ndarray]:
    """The parts of raw between ASCII white space, and where they start. Closing punctuation is a part of its own: behind a letter or digit of Latin-1, where the tokenizer always splits, up to white space."""
    padded = b"\n" + raw + b"\n"
    kinds, codes = np.frombuffer(padded.translate(_KINDS), np.uint8), np.frombuffer(padded, np.uint8)
    space = kinds == 1
    marks = np.flatnonzero(kinds == 2)
    first, last = marks[np.diff(marks, prepend=-2) != 1], marks[np.diff(marks, append=-2) != 1]
    first = first[space[last + 1] & ((kinds[first - 1] == 3) | (kinds[first - 1] == 4) & (codes[first - 2] == 0xC3))] - 1
    start, end = space[:-1] > space[1:], space[:-1] < space[1:]
    start[first] = end[first] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw.translate(None, _SPACE))]), starts


def _as_letters(words: bytes) -> str:
    """Words of _LATIN as a ByteLevel pre-tokenizer tells them, a letter for each byte: those of Latin-1, but for three bytes that have none there (fixed values)."""
    return words.decode("latin-1").replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")


class Encoder:
    """A tokenizer of the tokenizers library, what its worker remembers of words, and whether it is of the kind whose words can be remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.tokenizer, self.bare, self.old, self.young = Tokenizer.from_file(path), None, {}, {}
        vocab = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.added = [a["content"] for a in told.get("added_tokens", [])]
        self.marks = [a.encode() for a in self.added]
        splits = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = told.get("normalizer") == _NORMALIZER and splits[0].get("pattern") == {"Regex": _PATTERN} and len(splits) == 2 and told["model"].get("end_of_word_suffix") == _SUFFIX
        self.by_word = self.by_word and told["model"].get("dropout") is None and told.get("post_processor") is None and all(not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in told["added_tokens"])
        if self.by_word and splits[1].get("type") == "ByteLevel" and not splits[1].get("add_prefix_space"):
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = WhitespaceSplit()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for k, i in vocab.items() if k.endswith(_SUFFIX)]] = True

    def plain(self, texts: list[str]) -> list[bytes]:
        """The library's own call."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lowered(self, text: str) -> bytes:
        """The text in UTF-8, A-Z lower-cased, as the tokenizer does, unless a combining mark (U+0300 to U+037F) might join a letter before that, or the string of an added token would come up."""
        raw = text.encode("utf-8", "replace")
        low = raw.lower()
        return raw if b"\xcc" in raw or b"\xcd" in raw or any(a in low for a in self.marks) else low

    def parts(self, text: str) -> list[bytes]:
        """The lowered text between ASCII white space, with closing punctuation apart."""
        return split_words(self.lowered(text))[0].to_pylist()

    def words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word. Words of letters only are one piece to the tokenizer, whose last id marks its end, so many of them go into one call; those of lower-case Latin-1 are what its normalizer and splits leave as they are, so its model gets them alone, with bytes told as letters. All others have calls of their own."""
        out, plain, letters = {}, [], []
        for w in words:
            if self.bare and (w.isalpha() and w.islower() or _LATIN.fullmatch(w)):
                plain.append(w)
            elif (x := w.decode()).isalpha() and x.lower().isalpha():
                letters.append(w)
        for coder, some, told in ((self.bare, plain, _as_letters), (self.tokenizer, letters, bytes.decode)):
            groups = [some[i : i + _JOINED] for i in range(0, len(some), _JOINED)]
            coded = []
            for i in range(0, len(groups), _JOINED):
                coded += [np.array(e.ids, self.kind) for e in coder.encode_batch_fast(told(b"\n".join(map(b" ".join, groups[i : i + _JOINED]))).split("\n"), add_special_tokens=False)]
            sound = [i for i, (g, ids) in enumerate(zip(groups, coded)) if np.count_nonzero(last := self.ends[ids]) == len(g) and last[-1]]
            if sound:
                ids = np.concatenate([coded[i] for i in sound])
                cuts = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1)).astype(np.int32) * np.int32(self.kind.itemsize)
                whole = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
                out.update(zip(chain.from_iterable(groups[i] for i in sound), whole.to_numpy(zero_copy_only=False)))
        if len(out) < len(words):
            rest = [w for w in words if w not in out]
            out.update(zip(rest, self.plain([w.decode() for w in rest])))
        return out


def _encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def encode_words(texts: list[str], path: str) -> list[bytes]:
    """Ids of every text as packed integers, as the library's plain call gives them. Where the tokenizer drops white space and splits words by the rules above, ASCII white space parts a text into words, and closing punctuation a word; each distinct part is encoded once while the memo holds it. Texts with the string of an added token, and all texts of other tokenizers, go to the plain call.

    The memo has two generations of MEMO_WORDS words at most: when the young one is full, it takes the place of the old one.
    """
    coder = _encoder(path)
    whole = [i for i, t in enumerate(texts) if not coder.by_word or any(a in t for a in coder.added)]
    if whole:
        out, gone = dict(zip(whole, coder.plain([texts[i] for i in whole]))), set(whole)
        others = iter(encode_words([t for i, t in enumerate(texts) if i not in gone], path) if len(whole) < len(texts) else ())
        return [out[i] if i in gone else next(others) for i in range(len(texts))]
    stretches = [[raw] if len(raw) <= PIECE else list(_stretches(raw)) for raw in map(coder.lowered, texts)]
    flat, coded, at, size = [raw for some in stretches for raw in some], [], 0, 0
    for i, raw in enumerate(flat):
        size += len(raw)
        if size >= PIECE or i + 1 == len(flat):
            coded += _encode_stretches(coder, flat[at : i + 1])
            at, size = i + 1, 0
    left = iter(coded)
    return [b"".join(islice(left, len(some))) for some in stretches]


def _stretches(raw: bytes) -> Iterator[bytes]:
    """raw cut at white space, PIECE bytes and the word there at most."""
    at = 0
    while at < len(raw):
        found = _GAP.search(raw, at + PIECE)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def _encode_stretches(coder: Encoder, stretches: list[bytes]) -> list[bytes]:
    """Ids of lowered texts. Distinct parts are found by Arrow for all of them at once, and so are the ids put together; Python sees each distinct part once."""
    words, starts = split_words(b"\n".join(stretches))
    words = words.dictionary_encode()
    distinct, old, young = words.dictionary.to_numpy(zero_copy_only=False).tolist(), coder.old, coder.young
    known = list(map(young.get, distinct))
    holes = [i for i, ids in enumerate(known) if ids is None]
    new = []
    for i in holes:
        if (ids := old.get(w := distinct[i])) is not None:
            young[w] = ids
        else:
            new.append(w)
    young.update(coder.words(new))
    for i in holes:
        known[i] = young[distinct[i]]
    coder.old, coder.young = (young, {}) if len(young) > MEMO_WORDS else (old, young)
    ids = pa.array(known, pa.binary()).take(words.indices)
    _, offsets, data = ids.buffers()
    ends = np.cumsum([len(raw) + 1 for raw in stretches])
    at = np.frombuffer(offsets, np.int32)[np.concatenate(([0], np.searchsorted(starts, ends)))].tolist()
    return [data[a:b].to_pybytes() for a, b in zip(at, at[1:])]


_CHUNK = pa.struct([("key", pa.binary()), ("n", pa.int32()), ("ids", pa.binary())])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows, each PIECE bytes of text and one text more at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)) // PIECE
    cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _chunked(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and scanning the memo's words costs more than encoding them
        kind, sent = _encoder(path).kind, set()
        end = np.array([end_id], kind).tobytes()
        for whole in batches:
            for batch in _pieces(whole):
                ends, counts, roots, keys, lens, parts = [0], [], [], [], [], []
                coded = [raw + end for raw in encode_words([t or "" for t in batch.column("text").to_pylist()], path)]
                for raw, stops in zip(coded, cut_points(coded, kind)):
                    last = 0
                    for e in stops:
                        piece = raw[last * kind.itemsize : e * kind.itemsize]
                        key = hashlib.blake2b(piece, digest_size=16).digest()
                        keys.append(key)
                        lens.append(e - last)
                        parts.append(None if key in sent else piece)
                        sent.add(key)
                        last = e
                    if len(sent) > MEMO_KEYS:
                        sent.clear()
                    counts.append(len(raw) // kind.itemsize)
                    roots.append(merkle(keys[ends[-1] :]))
                    ends.append(len(keys))
                chunks = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(lens, pa.int32()), pa.array(parts, pa.binary())], fields=list(_CHUNK))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)], ["id", "n_tokens", "root", "chunks"])

    return run


@dataclass
class TokenStore:
    """Folders chunks (key, n, ids: packed little-endian), recipes (id, n_tokens, root, keys, lens; ascending id, __pid the file's range) and manifest (__pid, root, n_tokens). width: bytes of a stored id."""

    spark: SparkSession
    path: str
    width: int

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def verified_chunks(self) -> DataFrame:
        """key, n, crc of the ids as little-endian unsigned 32-bit integers; fails on a chunk that isn't what its key says."""
        kind = f"<u{self.width}"

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                crcs = []
                for key, n, raw in zip(*(b.column(c).to_pylist() for c in ("key", "n", "ids"))):
                    if hashlib.blake2b(raw, digest_size=16).digest() != key or len(raw) != n * int(kind[2]):
                        raise ValueError(f"chunk {key.hex()} is damaged")
                    crcs.append(zlib.crc32(np.frombuffer(raw, kind).astype("<u4")))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(crcs, pa.int64())], ["key", "n", "crc"])

        return self.read("chunks").select("key", "n", "ids").mapInArrow(check, "key binary, n int, crc long")

    def documents(self) -> DataFrame:
        """id, start, n_tokens, ids_crc32 of every document, from the files alone.

        Each chunk's checksum is moved to its place in the document (crc32 is linear), so joining the
        recipes carries a number for each chunk instead of its ids, and bit_xor() adds them up.
        Fails where a recipe's root, lengths or chunks don't agree, or a range's recipes and its manifest.
        """
        if not self.verify():
            raise ValueError("the recipes aren't what the manifest says")
        recipes = self.read("recipes")
        docs = running_sum(recipes.select("row", "id", "n_tokens", "__pid"), [F.col("id").asc_nulls_first(), F.col("row")], "n_tokens", "start")
        after = F.pandas_udf(ids_after, "array<long>")("lens")
        total = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
        sound = F.pandas_udf(has_root, "boolean")("keys", "root") & (F.size("keys") == F.size("lens")) & (F.col("n_tokens") == total)
        parts = F.when(sound, F.arrays_zip("keys", "lens", "after")).otherwise(F.raise_error(F.lit("a recipe isn't what its root and length say")))
        pieces = recipes.withColumn("after", after).select("row", F.explode(parts).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.lens").alias("len"), F.col("p.after").alias("after"))
        placed = pieces.join(self.verified_chunks(), "key", "left").withColumn("term", F.when(F.col("crc").isNull(), F.raise_error(F.lit("a recipe names a chunk that isn't there"))).when(F.col("n") != F.col("len"), F.raise_error(F.lit("a recipe gives a chunk another length"))).otherwise(F.pandas_udf(shifted_crc, "long")("crc", F.col("after") * 4)))
        sums = placed.groupBy("row").agg(F.bit_xor("term").alias("ids_crc32"))
        return docs.join(sums, "row").select("id", "start", "n_tokens", "ids_crc32")

    def reconstruct(self) -> DataFrame:
        """id and ids (array of long) of every document, put together from its chunks and held against its Merkle root."""
        kind = f"<u{self.width}"

        @F.pandas_udf("array<long>")
        def joined(keys: pd.Series, parts: pd.Series, roots: pd.Series) -> pd.Series:
            out = []
            for k, p, r in zip(keys, parts, roots):
                if merkle([bytes(x) for x in k]) != bytes(r) or any(hashlib.blake2b(bytes(x), digest_size=16).digest() != bytes(y) for x, y in zip(p, k)):
                    raise ValueError("a document isn't what its manifest says")
                out.append(np.frombuffer(b"".join(map(bytes, p)), kind).astype(np.int64))
            return pd.Series(out)

        recipes = self.read("recipes")
        pieces = recipes.select("row", F.posexplode("keys").alias("pos", "key")).join(self.read("chunks").select("key", "ids"), "key")
        parts = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
        return recipes.join(parts, "row").select("id", joined("keys", F.col("parts.ids"), "root").alias("ids"))

    def verify(self) -> bool:
        """Whether every range's manifest follows from the roots of its recipes."""
        now = _manifest(self.read("recipes"))
        old = self.read("manifest").select("__pid", F.col("root").alias("was"), F.col("n_tokens").alias("had"))
        return now.join(old, "__pid", "full").where(~F.col("root").eqNullSafe(F.col("was")) | ~F.col("n_tokens").eqNullSafe(F.col("had"))).isEmpty()


def _manifest(recipes: DataFrame) -> DataFrame:
    """A Merkle root for each range of recipes: a digest over its documents' roots, which are combined by document."""

    def root(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"], na_position="first")
        return pd.DataFrame({"__pid": [key[0]], "root": [merkle([bytes(x) for x in pdf["root"]])], "n_tokens": [int(pdf["n_tokens"].sum())]})

    return recipes.select("__pid", "id", "row", "root", "n_tokens").groupBy("__pid").applyInPandas(root, "__pid int, root binary, n_tokens long")


def has_root(keys: pd.Series, roots: pd.Series) -> pd.Series:
    """Whether each list of chunk keys has its Merkle root."""
    return pd.Series([merkle([bytes(x) for x in k]) == bytes(r) for k, r in zip(keys, roots)], dtype=bool)


def ids_after(lens: pd.Series) -> pd.Series:
    """For each chunk of a document, the ids of the chunks behind it."""
    sums = [np.cumsum(np.asarray(x, np.int64)) for x in lens]
    return pd.Series([(x[-1] - x if len(x) else x) for x in sums], dtype=object)


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over two elements modulo the (reflected) polynomial of crc32."""
    out, b = np.zeros_like(a), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(k)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(0xEDB88320), b >> np.uint64(1))
    return out


def shifted_crc(crc: pd.Series, n_after: pd.Series) -> pd.Series:
    """The share in a whole text's crc32 of a piece of that crc with n_after bytes behind it."""
    out, n = crc.to_numpy().astype(np.uint64), n_after.to_numpy().astype(np.int64)
    power = np.full(1, 1 << 23, np.uint64)  # x ** 8: one byte
    while n.any():
        out = np.where(n & 1, _mul(np.broadcast_to(power, out.shape).copy(), out), out)
        power, n = _mul(power, power), n >> 1
    return pd.Series(out.astype(np.int64))


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode every text, append end_id, and write chunks, recipes in ascending id order and manifests to path.

    Null text counts as empty (one chunk of end_id). Rows that share an id each stay, in the order of
    their content's root; a null id comes first. An empty table gives empty folders. Other columns are not stored.
    Every text is encoded once, into a staged table; chunks are then stored once each by their key.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    kind = dict(docs.dtypes)[id_col]
    coded = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_chunked(tokenizer_path, end_id), f"id {kind}, n_tokens long, root binary, chunks array<struct<key:binary,n:int,ids:binary>>")
    coded = stage(coded, "token-chunks")
    chunks = coded.select(F.explode("chunks").alias("c")).select("c.key", "c.n", "c.ids").where("ids IS NOT NULL").dropDuplicates(["key"])
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = coded.select("id", "n_tokens", "root", F.col("chunks.key").alias("keys"), F.col("chunks.n").alias("lens"))
    order = [F.col("id").asc_nulls_first(), F.col("root")]
    recipes = in_ranges(recipes, order, "recipes").withColumn("row", F.monotonically_increasing_id())
    stage_rows = recipes.sortWithinPartitions("__pid", *order)
    stage_rows.write.option("compression", "zstd").parquet(f"{path}/recipes")
    store = TokenStore(spark, path, _encoder(tokenizer_path).kind.itemsize)
    _manifest(store.read("recipes")).write.parquet(f"{path}/manifest")
    return store
