"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: lower-case A-Z, words, three-word shingles, XXH64 with seed 42, majority of each bit. Equal fingerprints
are one class from then on; only classes are compared.

Candidates: two fingerprints within ``radius`` bits agree in at least one of ``radius + 1`` bands, so every class is put
under each of its bands. A key with more than ``GROUP`` classes is cut again by bands of the bits that remain (the same
argument holds for them), and what is still larger after ``LEVELS`` cuts is compared in blocks of bounded size, each
block against each. No group is ever dropped or cut short.

Comparison: within a group the fingerprints stand vertically, 64 to a block, one machine word for each bit position.
For many (fingerprint, block) pairs at once, the differing bits of one position are added to carry-save counters (two
bits for a radius of 3, more for a larger one) that start where one bit over the radius overflows them; pairs whose 64
lanes have all overflowed are abandoned.

Only the local spanning edges of a group leave it, so a group of n near copies gives at most n - 1 rows. The classes
are then joined to components by alternating large and small stars, written after every round.

Defined results: a null text is empty; texts without words have fingerprint zero and link like any other; a null id
takes part, but names no component unless all ids of the component are null; rows with equal ids are kept apart by
their texts only; extra columns are ignored (``keep_one`` passes them through).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.store import materialize
from .common import map_batches

RADIUS = 3
SHINGLE = 3
BITS = 64
GROUP = 4096
LEVELS = 3
#: (fingerprint, block) pairs compared at a time.
PAIRS = 1 << 16
SEED = 42
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start:start + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {ids}, fp bigint")


def within(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS):
    """Yield arrays (i, j) of places whose fingerprints lie within ``radius`` bits, for places of the same group.

    ``groups`` are the offsets at which the groups begin, the total last. Every pair comes once, with i < j.
    """
    sizes = np.diff(groups)
    blocks_of = -(-sizes // 64)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)])
    group_of = np.repeat(np.arange(len(sizes)), sizes)
    lane_of = np.arange(len(fps)) - groups[group_of]
    block = first_block[group_of] + lane_of // 64
    width = max(2, radius.bit_length())
    preset = (1 << width) - 1 - radius
    planes = np.zeros((BITS, int(first_block[-1])), dtype=np.uint64)
    real = np.zeros(int(first_block[-1]), dtype=np.uint64)
    lane = (lane_of % 64).astype(np.uint64)
    np.bitwise_or.at(real, block, _ONE << lane)
    for k in range(BITS):
        np.bitwise_or.at(planes[k], block, (fps >> np.uint64(k) & _ONE) << lane)
    base = groups[group_of] // 1  # place of the first member of each place's group
    later = first_block[group_of + 1] - block  # blocks from the own one to the last of the group
    ends = np.cumsum(later)
    start = 0
    while start < len(fps):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        count = later[start:stop]
        query = np.repeat(np.arange(start, stop), count)
        target = block[query] + np.arange(len(query)) - np.repeat(ends[start:stop] - count - before, count)
        own = target == block[query]
        mask = real[target]
        # lanes after the own one; a shift by 64 is undefined, so it is done in two steps
        mask[own] &= (_ALL << lane[query[own]]) << _ONE
        far = np.zeros(len(query), dtype=np.uint64)
        counts = [np.full(len(query), _ALL if preset >> i & 1 else 0, dtype=np.uint64) for i in range(width)]
        value = fps[query]
        for k in range(BITS):
            carry = planes[k][target] ^ (np.uint64(0) - (value >> np.uint64(k) & _ONE))
            for i in range(width):
                counts[i], carry = counts[i] ^ carry, counts[i] & carry
            far |= carry
            if k % 8 == 7 and k > 8:
                alive = (mask & ~far) != 0
                if not alive.all():
                    query, target, value = query[alive], target[alive], value[alive]
                    mask, far, counts = mask[alive], far[alive], [c[alive] for c in counts]
                if not len(query):
                    break
        near = mask & ~far
        for k in range(64):
            hit = np.flatnonzero(near >> np.uint64(k) & _ONE)
            if len(hit):
                i = query[hit]
                yield i, base[i] + (target[hit] - first_block[group_of[i]]) * 64 + k
        start = stop


def spanning(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each place the first place of its local component."""
    label = np.arange(len(fps))
    for i, j in within(fps, groups, radius):
        join_labels(label, i, j)
    return label


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the local components of the places i and j; ``label`` is changed in place."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:  # shorten all paths
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _bands(width: int, radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``radius + 1`` bands that cover ``width`` bits; surplus bands are empty."""
    size = -(-width // (radius + 1))
    return [(min(k * size, width), max(0, min(size, width - k * size))) for k in range(radius + 1)]


def _cut(df: DataFrame, width: int, radius: int) -> tuple[DataFrame, int]:
    """Put each row (key, rest, fp) under every band of ``rest``; the new rest is what the band leaves."""
    bands = _bands(width, radius)
    size = bands[0][1]
    rest = F.col("rest")

    def band(k: int, shift: int, bits: int) -> Column:
        value = F.shiftrightunsigned(rest, shift).bitwiseAND(F.lit((1 << bits) - 1)) if bits else F.lit(0).cast("long")
        low = rest.bitwiseAND(F.lit((1 << shift) - 1)) if shift else F.lit(0).cast("long")
        high = F.shiftrightunsigned(rest, shift + bits) if shift + bits < BITS else F.lit(0).cast("long")
        left = high if not shift else low.bitwiseOR(F.shiftleft(high, shift))
        return F.struct(F.lit(k).alias("band"), value.alias("value"), left.alias("left"))
    got = df.withColumn("_b", F.explode(F.array(*[band(k, s, b) for k, (s, b) in enumerate(bands)])))
    key = F.xxhash64("key", "_b.band", "_b.value") if "key" in df.columns else F.xxhash64("_b.band", "_b.value")
    return got.select(key.alias("key"), F.col("_b.left").alias("rest"), "fp"), width - min(b for _, b in bands if b) \
        if size else width


def edges(classes: DataFrame, radius: int = RADIUS, group: int = GROUP, levels: int = LEVELS) -> DataFrame:
    """Local spanning edges (a, b), a > b in place, of the distinct fingerprints ``fp``.

    Keys are hashes of (band, value); a collision of two keys only adds candidates.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the bands are cut for a radius of 0 to 3")
    rows, width, parts = classes.select(F.col("fp").alias("rest"), "fp"), BITS, []
    for level in range(levels):
        rows, width = _cut(rows, width, radius)
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        sizes = materialize(sizes, "simhash-keys")
        parts.append(rows.join(sizes.filter(F.col("n") <= group), "key").select("key", F.lit(0).alias("part"), "fp"))
        hot = sizes.filter(F.col("n") > group)
        if hot.isEmpty():
            break
        rows = rows.join(hot, "key")
        if level < levels - 1:
            rows = rows.drop("n")
            continue
        half = max(1, group // 2)
        count = F.ceil(F.col("n") / half).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), count)
        spread = rows.withColumns({"_own": own, "_other": F.explode(F.sequence(F.lit(0), count - 1))})
        pair = F.least("_own", "_other") * F.lit(1 << 20) + F.greatest("_own", "_other") + 1
        parts.append(spread.select("key", pair.alias("part"), "fp"))
    together = parts[0]
    for more in parts[1:]:
        together = together.unionByName(more)
    lists = together.groupBy("key", "part").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(0)
        values = column.flatten().to_numpy(zero_copy_only=False)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        label = spanning(values.view(np.uint64), np.concatenate([[0], np.cumsum(sizes)]), radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[label[linked]])], names=["a", "b"])
    return map_batches(lists.select("fps"), run, "a bigint, b bigint", rows=4096).distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the smallest node of the component."""
    work = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .filter("a <> b").distinct(), "links")
    for _ in range(rounds):
        # large star: the larger neighbours of a node move to its smallest one
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        work = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        work = materialize(work, "links")
        # small star: the smaller neighbours of a node and the node itself move to the smallest of them
        least = work.groupBy("a").agg(F.min("b").alias("m"))
        moved = work.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        work = materialize(moved.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        if work.join(work.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and \
                work.groupBy("a").count().filter("count > 1").isEmpty():
            return work.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component is named by its smallest doc_id."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")), "classes")
    roots = components(edges(classes, radius))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    return prints.join(linked.join(named, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component: the one with its smallest doc_id (rows without an id stay).

    An id goes if any of its rows lies in a component with a smaller id. Of several rows with one id the one with the
    smallest text stays, null first.
    """
    return keep_least(docs, near_duplicates(docs, radius, shingle))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """What ``keep_one`` keeps, for components (doc_id, component_id) that were found before."""
    found = found.filter("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("_c")).filter("_c < doc_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])
    repeated = materialize(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64(*docs.columns))
    again = kept.join(repeated, "doc_id", "left_semi").withColumn("_row_in_id", F.row_number().over(first))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(
        again.filter("_row_in_id = 1").select(*docs.columns))
