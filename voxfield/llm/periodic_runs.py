"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least ``max(24, 3 q)``
words long, that no neighbouring word extends with period q. All runs of a text are found, exactly.

The texts of a slice stand behind each other as one sequence of word numbers, each followed by a symbol of its own, so
that no match crosses texts. Prefix doubling names every block of 2^k words by its first place in suffix order; the last
names give the suffix array. A wavelet matrix over the suffix array answers range-successor queries: the next occurrence
of a block after a place. Every block at a multiple of its width m = 2^k is looked up in the window behind it: a run of
period q, m <= q < 2 m, holds such a block and its copy q words on (for q < 16 blocks of 8 words do, as a run has 24).
Occurrences at most m / 2 apart are a progression: they lie in a repetition of that difference, and only the distance of
its ends to the ends of the repetition around the block can be a smallest period. Every candidate is extended to both
sides by the names of blocks, and of equal stretches the smallest period stays.

Nothing is shuffled. A task holds about 3 MB of text at a time (a longer text alone) and some 120 bytes for each of its
words.

Defined results: a null text has no words; texts are taken whole; rows are independent, so repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices_of

LEAST = 24
TIMES = 3
#: Blocks of 2 ** 3 words serve all periods below 16.
FIRST_LEVEL = 3
SLICE_BYTES = 3 << 20


def block_names(symbols: np.ndarray) -> list[np.ndarray]:
    """For each k the name of every block of 2 ** k symbols: how many blocks come before the first one like it.

    The last symbol must occur once. The last list has no two equal names.
    """
    counts = np.bincount(symbols)
    name = (np.cumsum(counts) - counts)[symbols]
    members = counts[symbols]
    names, width, n = [name.astype(np.int32)], 1, len(symbols)
    tied = np.flatnonzero(members > 1)
    while len(tied):
        old = name[tied]
        key = old * n + name[tied + width]
        order = np.argsort(key, kind="stable")
        key, old, tied = key[order], old[order], tied[order]
        place = np.arange(len(tied))
        new_group = np.r_[True, key[1:] != key[:-1]]
        old_start = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        name = name.copy()
        name[tied] = old + start - old_start
        names.append(name.astype(np.int32))
        size = np.diff(np.r_[np.flatnonzero(new_group), len(tied)])
        tied = np.sort(tied[np.repeat(size > 1, size)])
        width *= 2
    return names


class WaveletMatrix:
    """Range counting and selection over a permutation of 0 .. n - 1, for many queries at a time."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            zero = (values >> b & 1) == 0
            self.zeros.append(np.r_[0, np.cumsum(zero)].astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value >= ``least`` at the places [low, high) of each query, or 2 ** 62."""
        below = np.zeros(len(low), dtype=np.int64)
        a, b = low.astype(np.int64), high.astype(np.int64)
        for k, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            one = (least >> (self.bits - 1 - k) & 1).astype(bool)
            below += np.where(one, zb - za, 0)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        below = np.where(least >> self.bits > 0, high - low, below)
        found = below < high - low
        a, b, rest = low.astype(np.int64), high.astype(np.int64), np.where(found, below, 0)
        value = np.zeros(len(low), dtype=np.int64)
        for k, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            one = rest >= zb - za
            rest = np.where(one, rest - (zb - za), rest)
            value |= one.astype(np.int64) << (self.bits - 1 - k)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        return np.where(found, value, 1 << 62)


def common_ahead(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j > i on are equal."""
    length = np.zeros(len(i), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        length += (names[k][i + length] == names[k][j + length]).astype(np.int64) << k
    return length


def common_behind(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before i and before j > i are equal."""
    length = np.zeros(len(i), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        at = i - length - (1 << k)
        same = (at >= 0) & (names[k][np.maximum(at, 0)] == names[k][np.maximum(j - length - (1 << k), 0)])
        length += same.astype(np.int64) << k
    return length


def _candidates(names: list[np.ndarray], tree: WaveletMatrix, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) that a block of this level gives."""
    n, m, name = len(names[0]), 1 << level, names[level]
    at = np.arange(0, n - m, m, dtype=np.int64)
    members = np.bincount(name, minlength=n)
    at = at[members[name[at]] > 1]
    after = at + (1 if level == FIRST_LEVEL else m)
    places, periods = [], []

    def add(i: np.ndarray, d: np.ndarray) -> None:
        places.append(i)
        periods.append(d)
    while len(at):
        low = name[at].astype(np.int64)
        high = low + members[low]
        first = tree.successor(low, high, after)
        open_ = first < at + 2 * m
        at, low, high, first = at[open_], low[open_], high[open_], first[open_]
        if not len(at):
            break
        after = first + 1
        if level == FIRST_LEVEL:
            add(at, first - at)
            continue
        second = tree.successor(low, high, after)
        chain = (second < at + 2 * m) & (second - first <= m // 2)
        add(at[~chain], (first - at)[~chain])
        if chain.any():
            s, t, step = at[chain], first[chain], (second - first)[chain]
            end = t + step + common_ahead(names, t, t + step)
            begin_s, begin_t = s - common_behind(names, s, s + step), t - common_behind(names, t, t + step)
            end_s = s + step + common_ahead(names, s, s + step)
            apart = begin_s != begin_t
            add(s[apart], (begin_t - begin_s)[apart])
            add(s[apart], (end - end_s)[apart])
            after[chain] = t + step * ((end - m - t) // step) + 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, d = np.concatenate(places), np.concatenate(periods)
    fits = (d >= (1 if level == FIRST_LEVEL else m)) & (d < 2 * m) & (i + d + m <= n)
    i, d = i[fits], d[fits]
    same = name[i] == name[i + d]
    return i[same], d[same]


def runs(symbols: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs, sorted, in a sequence whose texts end with symbols that occur once.

    ``longest`` is the length of the longest text.
    """
    none = np.zeros((0, 3), dtype=np.int64)
    names = block_names(symbols)
    if len(names) <= FIRST_LEVEL or longest < LEAST:
        return none
    order = np.empty(len(symbols), dtype=np.int64)
    order[names[-1]] = np.arange(len(symbols))
    tree = WaveletMatrix(order)
    found = []
    for level in range(FIRST_LEVEL, len(names)):
        if level > FIRST_LEVEL and TIMES << level > longest:
            break
        i, d = _candidates(names, tree, level)
        start = i - common_behind(names, i, i + d)
        length = i + d + common_ahead(names, i, i + d) - start
        long = length >= np.maximum(LEAST, TIMES * d)
        found.append(np.stack([start, length, d], axis=1)[long])
    got = np.unique(np.concatenate(found), axis=0)
    if not len(got):
        return none
    return got[np.r_[True, (got[1:, :2] != got[:-1, :2]).any(axis=1)]]


def _slice(batch: pa.RecordBatch, edit: Callable | None) -> pa.RecordBatch:
    """(doc_id, n_words, runs, collapsed) of texts (doc_id, text as bytes)."""
    texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
    if edit is not None:
        texts = [edit(i, words) for i, words in zip(batch.column(0).to_pylist(), texts)]
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    parts = [np.fromiter((numbers[w] for w in words), np.int64, len(words)) for words in texts]
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.empty(int(sizes.sum()) + len(sizes), dtype=np.int64)
    for k, part in enumerate(parts):
        symbols[starts[k]:starts[k] + len(part)] = part
    symbols[starts + sizes] = len(numbers) + np.arange(len(sizes))
    found = runs(symbols, int(sizes.max()))
    text_of = np.searchsorted(starts, found[:, 0], side="right") - 1
    # a run keeps its first period; everything after it goes
    change = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(change) == 0
    collapsed = []
    hit = set(text_of.tolist())
    for k, words in enumerate(texts):
        left = compress(words, keep[starts[k]:starts[k] + sizes[k]].tolist()) if k in hit else words
        collapsed.append(b" ".join(left).decode("utf-8", "replace"))
    found[:, 0] -= starts[text_of]
    offsets = np.searchsorted(text_of, np.arange(len(texts) + 1)).astype(np.int32)
    fields = [pa.array(found[:, k]) for k in range(3)]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists, pa.array(collapsed, pa.string())],
                                      names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of (doc_id, text).

    ``runs`` holds (start, length, period) by start, then period, in words. ``collapsed`` is the text's words, joined by
    one space, without those that a run repeats. ``edit`` changes the words of a text (id, words) before the search.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices_of(batch, 1, SLICE_BYTES):
                yield _slice(part, edit)
    schema = (f"doc_id {ids}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
              "collapsed string")
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def strongest(runs_column: str) -> Column:
    """The run with the greatest length / period; ties go to the smaller start, then the smaller period."""
    def better(best: Column, r: Column) -> Column:
        left, right = r["length"] * best["period"], best["length"] * r["period"]
        earlier = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when(best.isNull() | (left > right) | ((left == right) & earlier), r).otherwise(best)
    return F.aggregate(runs_column, F.get(runs_column, F.lit(0)), better)
