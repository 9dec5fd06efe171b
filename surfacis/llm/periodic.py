"""Periodic runs of words in documents, found by counting matches at every lag, and texts without the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words that a run has at least, and bytes of text that a worker takes at a time (a longer text comes alone).
LEAST, BATCH_BYTES = 12, 4 << 20
#: A word is frequent in a text of n words when its pairs outnumber this many times n log2 n, which its transform costs.
TRANSFORM = 2.0
#: Matches of a lag that the stepped test looks at within one period, and pairs that are counted at a time.
STEPS, PAIRS = 8, 1 << 21


def lag_counts(codes: np.ndarray, starts: np.ndarray, transform: float = TRANSFORM) -> tuple[np.ndarray, np.ndarray]:
    """How often words equal the one q words later, in every text and for each lag q up to half its words.

    codes are the words of all texts, text d from starts[d] to starts[d + 1]. Returns the counts, those of text d from
    base[d] (lag 0, not counted) on, and base. A frequent word's pairs come from the transform of its places (exact after rounding), a rare
    word's from differences of its places; so a word in half of all places costs n log n, not n squared.
    """
    sizes = np.diff(starts)
    base = np.concatenate(([0], np.cumsum(sizes // 2 + 1)))
    counts = np.zeros(base[-1], np.int64)
    if not len(codes):
        return counts, base
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = doc * (int(codes.max()) + 1) + codes
    place = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(key[place]) != 0)))
    often = np.diff(np.concatenate((first, [len(key)])))
    n = sizes[doc[place[first]]]
    heavy = often * (often - 1) / 2 > transform * n * np.log2(n + 1)
    spectra: dict[int, np.ndarray] = {}
    for g in np.flatnonzero(heavy):
        at = place[first[g] : first[g] + often[g]]
        d = int(doc[at[0]])
        there = np.zeros(sizes[d])
        there[at - starts[d]] = 1
        power = np.abs(np.fft.rfft(there, 1 << int(sizes[d] + sizes[d] // 2).bit_length())) ** 2
        spectra[d] = power if d not in spectra else spectra[d] + power
    for d, power in spectra.items():
        half = int(sizes[d]) // 2
        counts[base[d] + 1 : base[d] + half + 1] += np.rint(np.fft.irfft(power)[1 : half + 1]).astype(np.int64)
    after = np.repeat(first + often, often) - np.arange(len(key)) - 1
    one = np.flatnonzero((after > 0) & ~np.repeat(heavy, often))
    k, waiting, n_waiting = 0, [], 0
    while len(one):
        k += 1
        lag, text = place[one + k] - place[one], doc[place[one]]
        near = lag <= sizes[text] // 2
        one = one[near]
        waiting.append((base[text] + lag)[near])
        n_waiting += len(one)
        one = one[after[one] > k]
        if n_waiting > PAIRS or not len(one):
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
            waiting, n_waiting = [], 0
    return counts, base


def _islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches of True that have at least so many."""
    edges = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
    length = np.diff(edges) - 1
    long = length >= least
    return edges[:-1][long] + 1, length[long]


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length and period of every run of one text, by start, then period; counts are its lags' matches (changed here).

    Lags go up, so the smallest period of a stretch comes first: a multiple gives the same stretch again and is passed over. What
    a run adds to the counts of its period's multiples is taken off, as no run of theirs lies there. A lag with fewer matches than a run needs
    isn't looked at; for longer lags, a stretch of equal words in steps has to show before all words are compared.
    """
    found: dict[tuple[int, int], int] = {}
    lags = np.arange(len(counts))
    need = np.maximum(lags, least - lags)
    for q in np.flatnonzero(counts[1:] >= need[1:]) + 1:
        if counts[q] < need[q]:
            continue
        if q >= 2 * STEPS:
            step = q // STEPS
            if not len(_islands(words[: len(words) - q : step] == words[q::step], q // step)[0]):
                continue
        for start, same in zip(*(x.tolist() for x in _islands(words[:-q] == words[q:], need[q]))):
            run = (start, same + int(q))
            if run not in found:
                found[run] = int(q)
                multiples = np.arange(2 * q, min(len(counts), run[1]), q)
                counts[multiples] -= run[1] - multiples
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _found(texts: pa.Array, least: int) -> tuple[list[list[tuple[int, int, int]]], pa.Array, np.ndarray]:
    """Runs of each text, each text's words without repeats joined by one space, and the number of its words."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    values, ends = split.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
    real = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(real)))[ends].astype(np.int64)
    values = values.filter(pa.array(real))
    codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts, base = lag_counts(codes, starts)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    likely = (lag > 0) & (counts >= np.maximum(lag, least - lag))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    kept = np.ones(len(codes), bool)
    for d in np.unique(np.searchsorted(base, np.flatnonzero(likely), "right") - 1):
        runs[d] = runs_of(codes[starts[d] : starts[d + 1]], counts[base[d] : base[d + 1]], least)
        for s, n, q in runs[d]:
            kept[starts[d] + s + q : starts[d] + s + n] = False
    left = np.concatenate(([0], np.cumsum(kept)))[starts]
    words = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), values.filter(pa.array(kept)).cast(pa.large_string()))
    return runs, pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string()), np.diff(starts)


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with text_col replaced by its words without repeats, and with n_words (before) and runs.

    Words are stretches without ASCII white space. A run (start from 0, length, period) is a stretch of consecutive words with smallest period q and at
    least max(least, 2 q) words that no neighbouring word extends; runs stand by start, then period. The words of every run after its
    first q go, the others stay, joined by one space. Null and empty texts have no words, no runs and an empty text. Rows
    are worked out where they stand, each for itself, so repeated rows and ids stay; other columns stay, but n_words and runs
    replace columns of these names. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "runs")]
    fields = [f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // BATCH_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b > a:
                    piece = batch.slice(a, b - a)
                    runs, texts, n_words = _found(piece.column(text_col), least)
                    flat = [r for rows in runs for r in rows]
                    at = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
                    columns = np.array(flat, np.int64).reshape(-1, 3).T
                    listed = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(run)))
                    own = [texts if c == text_col else piece.column(c) for c in kept]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), listed], names=[*kept, "n_words", "runs"])

    schema = ", ".join([*fields, "n_words long", "runs array<struct<start:long,length:long,period:long>>"])
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(work, schema)
