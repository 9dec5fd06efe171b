"""One-permutation MinHash fingerprints with optimal densification, in DataFrame functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, in_ranges, let

#: Bins, low-order bits kept of each, words to a shingle. A hash has 63 bits: the top BIN_BITS choose the bin.
BIN_BITS, LOW_BITS, SHINGLE = 8, 8, 5
BINS, REST = 1 << BIN_BITS, 63 - BIN_BITS
TRIES = 12
#: The order in which an empty bin tries the others, fixed by a seed: near-independent from bin to bin, and it ends at a full bin if there is one.
PROBES = [random.Random(f"probe {i}").sample(range(1, BINS + 1), BINS) for i in range(BINS)]


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """63-bit hashes of all word shingles of a text; one of the whole sequence if it has fewer words, none without words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+", -1), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    low = lambda x: x.bitwiseAND(F.lit(2**63 - 1))
    many = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: low(F.xxhash64(*[F.element_at(w, i + k) for k in range(size)])))
    return let(hashed, lambda w: F.when(F.size(w) >= size, many(w)).when(F.size(w) > 0, F.array(low(F.xxhash64(w)))).otherwise(F.array().cast("array<bigint>")))


def _minima(hashes: Column) -> Column:
    """The least hash of each bin, in order of bins; an empty bin holds the bin's largest value."""
    ends = F.array(*[F.lit((i << REST) | (2**REST - 1)) for i in range(BINS)])
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, REST) != F.shiftright(s[F.greatest(i - 1, F.lit(0))], REST)))
    return let(F.sort_array(F.concat(hashes, ends)), first)


def _densified(minima: Column) -> Column:
    """Every empty bin takes the value of the first full bin in its own order of probes."""
    rest = F.lit(2**REST - 1)
    empty = lambda x: x.bitwiseAND(rest) == rest
    early = F.array(*[F.array(*[F.lit(j) for j in p[:TRIES]]) for p in PROBES])
    whole = F.array(*[F.lit(",".join(map(str, p))) for p in PROBES])

    def fill(m: Column) -> Column:
        full = lambda order: F.try_element_at(F.filter(order, lambda j: ~empty(F.element_at(m, j))), F.lit(1))
        donor = lambda i: F.coalesce(full(early[i]), full(F.split(whole[i], ",").cast("array<int>")))
        return F.transform(m, lambda x, i: F.when(~empty(x), x).otherwise(F.element_at(m, donor(i))))

    return let(minima, fill)


def _packed(values: Column) -> Column:
    """The low LOW_BITS (8) of each bin's value, eight bins to a long."""
    low = lambda v, k: F.shiftleft(v.bitwiseAND(F.lit(2**LOW_BITS - 1)), 8 * k)

    def word(m: Column, i: Column) -> Column:
        out = low(m[i * 8], 0)
        for k in range(1, 8):
            out = out.bitwiseOR(low(m[i * 8 + k], k))
        return out

    return let(values, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lambda i: word(m, i)))


def packed_fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """BINS // 8 longs; an empty array for a text without words."""
    return let(shingle_hashes(text, size), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(_packed(_densified(_minima(h)))))


def as_hex(packed: Column) -> Column:
    """The fingerprint as a string of hex digits: equal for equal shingle sets, empty without words."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints: the share of equal bins, corrected for those that agree by chance in LOW_BITS bits. 1 for two texts without words, 0 for one."""
    def differing(x: Column) -> Column:
        """Number of bytes that aren't 0: all bits of each byte gather in its lowest."""
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW_BITS
    share = (1 - unequal / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add packed (array of long) and fingerprint (hex) to every row. Null text counts as empty; rows of equal text get equal fingerprints; other columns stay, but for clashing ones of these two names."""
    return docs.drop("packed", "fingerprint").withColumn("packed", packed_fingerprint(F.col(text_col))).withColumn("fingerprint", as_hex(F.col("packed")))


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Add next_<c> for each column c: that of the row with the next smaller id, the largest id's for the smallest.

    Ids are ranged on their own in a narrow table, whose ends (a row for each range) come to the driver;
    then one shuffle by range brings the rows together, and only each range's first row is looked up again.
    Rows that share an id follow each other in descending order of the columns; null ids come last.
    """
    ids = in_ranges(docs.select(id_col), [F.col(id_col).desc_nulls_last()], "ids")
    bounds = ids.groupBy("__pid").agg(F.max(id_col).alias("top"), F.min(id_col).alias("low")).orderBy("__pid").collect()
    last = max(0, len(bounds) - 1)
    kind = dict(docs.dtypes)[id_col]
    tops, lows = (F.array(*[F.lit(b[k]) for b in bounds]).cast(f"array<{kind}>") for k in ("top", "low"))
    part = F.when(F.col(id_col).isNull(), F.lit(last)).otherwise(F.least(F.array_size(F.filter(lows, lambda x: x > F.col(id_col))), F.lit(last)))
    rows = docs.withColumn("__part", part)
    keys = [id_col, *columns]
    w = Window.partitionBy("__part").orderBy(*[F.col(c).desc_nulls_last() for c in keys])
    firsts = rows.where(F.col(id_col).eqNullSafe(F.try_element_at(tops, F.col("__part") + 1)))
    firsts = firsts.groupBy("__part").agg(F.max(F.struct(*keys)).alias("__first")).withColumn("__part", F.pmod(F.col("__part") - 1, F.lit(last + 1)))
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"__last": F.lead(F.lit(1)).over(w).isNull()})
    rows = rows.join(firsts, "__part", "left")
    return rows.withColumns({f"next_{c}": F.when(F.col("__last"), F.col("__first")[c]).otherwise(F.col(f"next_{c}")) for c in columns}).drop("__part", "__last", "__first")
