"""Near copies for the pipeline: SimHash comparison in bounded clusters, decided by the exact Jaccard similarity of
five-word shingles.

Two texts are near copies if the sets of their shingles (lower-case A-Z, words as in ``simhash``; a shorter text is one
shingle) have a Jaccard similarity of at least 0.8. Equal sets are one class from then on; only classes are compared.

1. Keys. At a similarity of 0.8 two SimHash fingerprints differ in 15 % of their bits, so they share no band that is wide
   enough to be rare in a large corpus. Classes meet under bands of ``ROWS`` of their ``LEAST`` least hashes instead: two
   sets agree in one least hash with their similarity as probability. At 0.8 a pair shares none of the ``BANDS`` bands with a
   probability of about 0.006, at 0.85 of 0.0003. Band rows hold (key, class) only; each class is linked to the first one
   of its key, so a key of n classes gives n - 1 rows. What is linked, directly or not, is a cluster.
2. Clusters. Each class of a cluster gives its fingerprint and shingle set once. Inside a cluster fingerprints are compared
   bit-sliced as in ``simhash``: by one word within ``NEAR`` bits, what is left by all words within ``FAR``. Pairs that are
   not connected yet are decided by their sets; only spanning edges leave.
3. Large clusters are cut into parts of at most about ``GROUP`` classes and ``GROUP_BYTES`` of sets. Most parts of a large
   family of near copies hang together after the first round. Classes outside the largest component of their cluster then
   visit all parts, so every pair of a cluster whose classes aren't connected is compared.

Every link is exact; the keys and radii may miss a pair (see the figures in the README). Intermediate tables are removed
before the result is returned.

Defined results: texts without words have the empty set and are copies of each other; for nulls and repeated ids the
rules of ``simhash`` hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.store import materialize, scratch
from . import simhash
from .common import among, map_batches

SHINGLE = 5
WORDS = 8
NEAR, FAR = 26, 150
LEAST, ROWS, BANDS = 128, 8, 48
GROUP, GROUP_BYTES = 4096, 64 << 20
#: Groups of fewer places are decided pair by pair, larger ones by bit maps of the shingles that two of them share.
MAPPED, MAP_BYTES = 48, 256 << 20
_golden = np.uint64(0x9E3779B97F4A7C15)
_seeds = np.arange(1, WORDS + 1, dtype=np.uint64) * _golden
_rank_seeds = np.arange(1001, LEAST + 1001, dtype=np.uint64) * _golden
_bands = np.concatenate([np.random.default_rng(k).permutation(LEAST) for k in range(-(-BANDS * ROWS // LEAST))])[
    :BANDS * ROWS].reshape(BANDS, ROWS)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = set(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, simhash.SEED) for g in grams), np.uint64, len(grams)))


def _mixed(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    z = hashes[:, None] + seeds
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words of bit majorities."""
    ones = np.zeros(WORDS * 64, dtype=np.int64)
    for start in range(0, len(hashes), 255):
        bits = np.unpackbits(_mixed(hashes[start:start + 255], _seeds).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its number and its least hashes. None for an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    least = np.full(LEAST, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 512):  # multiplying by an odd number permutes; its high bits order the hashes
        z = hashes[start:start + 512, None] * (_rank_seeds | np.uint64(1))
        least = np.minimum(least, ((z ^ z >> np.uint64(32)) * _golden).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least[_bands])], dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least 0.8, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, class, bits, keys) of every row."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        classes, prints, keys = [], [], []
        for text in batch.column(2).to_pylist():
            hashes = shingles(text)
            classes.append(xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED))
            prints.append(fingerprint(hashes).tobytes())
            keys.append(band_keys(hashes).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.array(classes, np.uint64).view(np.int64)),
             pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "class", "bits", "keys"])
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), run,
                       f"doc_id {ids}, row bigint, class bigint, bits binary, keys array<bigint>")


class Sets:
    """Shingle sets of the places of several groups, and the exact test of pairs of places of one group."""

    def __init__(self, sets: list[np.ndarray], groups: np.ndarray) -> None:
        self.sets, self.groups = sets, groups
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.group_of = np.repeat(np.arange(len(groups) - 1), np.diff(groups))
        self.maps: dict[int, np.ndarray | None] = {}

    def _map(self, group: int) -> np.ndarray | None:
        """A row of bits for each place of a group: which of the shingles it has that another has, too."""
        if group not in self.maps:
            a, b = self.groups[group], self.groups[group + 1]
            every = np.concatenate(self.sets[a:b])
            _, number, count = np.unique(every, return_inverse=True, return_counts=True)
            dense = np.cumsum(count > 1) - 1
            width = -(-int((count > 1).sum()) // 64)
            if width * 8 * (b - a) > MAP_BYTES:
                self.maps[group] = None
            else:
                place = np.repeat(np.arange(b - a), self.sizes[a:b])
                shared = count[number] > 1
                bits, place = dense[number[shared]], place[shared]
                out = np.zeros((b - a, max(1, width)), dtype=np.uint64)
                np.bitwise_or.at(out, (place, bits // 64), np.uint64(1) << (bits % 64).astype(np.uint64))
                self.maps[group] = out
        return self.maps[group]

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=bool)
        of = self.group_of[i]
        large = np.diff(self.groups)[of] >= MAPPED
        for g in np.unique(of[large]).tolist():
            own = np.flatnonzero(of == g)
            held = self._map(g)
            if held is None:
                large[own] = False
                continue
            first = self.groups[g]
            for k in range(0, len(own), step := max(1, (1 << 22) // held.shape[1])):
                p = own[k:k + step]
                both = np.bitwise_count(held[i[p] - first] & held[j[p] - first]).sum(axis=1, dtype=np.int64)
                out[p] = 5 * both >= 4 * (self.sizes[i[p]] + self.sizes[j[p]] - both)
        for p in np.flatnonzero(~large).tolist():
            out[p] = similar(self.sets[i[p]], self.sets[j[p]])
        return out


def connected(words: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` after all similar pairs within the groups are joined; places of one label are connected already."""
    exact = Sets(sets, groups)
    first = np.ascontiguousarray(words[:, 0])
    for i, j in simhash.within(first, groups, NEAR):
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        close = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= FAR
        i, j = i[close], j[close]
        for k in range(0, len(i), 1 << 12):
            a, b = i[k:k + (1 << 12)], j[k:k + (1 << 12)]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if len(a):
                same = exact.similar(a, b)
                simhash.join_labels(label, a[same], b[same])
    return label


def _compare(table: pa.Table) -> pa.Table:
    """Spanning edges (a, b) of rows (cluster, known, class, bits, set); classes of one ``known`` are connected."""
    cluster, known, node = (table.column(c).to_numpy() for c in ("cluster", "known", "class"))
    order = np.lexsort((node, cluster))
    keep = order[np.r_[True, (node[order][1:] != node[order][:-1]) | (cluster[order][1:] != cluster[order][:-1])]]
    cluster, known, node = cluster[keep], known[keep], node[keep]
    chosen = pa.array(keep)
    words = np.frombuffer(b"".join(table.column("bits").take(chosen).to_pylist()), "<u8").reshape(-1, WORDS)
    sets = [np.frombuffer(s, "<u8") for s in table.column("set").take(chosen).to_pylist()]
    groups = np.r_[np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]]), len(cluster)]
    group_of = np.repeat(np.arange(len(groups) - 1), np.diff(groups))
    by_known = np.lexsort((known, group_of))
    new = np.r_[True, (known[by_known][1:] != known[by_known][:-1]) | (group_of[by_known][1:] != group_of[by_known][:-1])]
    label = np.empty(len(node), dtype=np.int64)
    label[by_known] = np.minimum.reduceat(by_known, np.flatnonzero(new))[np.cumsum(new) - 1]
    label = connected(words, sets, groups, label)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": node[linked], "b": node[label[linked]]})


def clusters(rows: DataFrame) -> DataFrame:
    """(class, cluster) of the classes that share a key with another one, directly or by others.

    Copies may repeat a row (class, keys); only its class counts.
    """
    banded = rows.select("class", F.explode("keys").alias("key"))
    ends = banded.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last"))
    first = ends.filter("first <> last").drop("last")
    first = materialize(first, "near-copy-keys")
    links = among(banded, "key", first).join(first, "key").filter("class <> first")
    roots = simhash.components(links.select(F.col("class").alias("a"), F.col("first").alias("b")))  # a root has no row
    return roots.select(F.col("node").alias("class"), F.col("root").alias("cluster")).unionByName(
        roots.select(F.col("root").alias("class"), F.col("root").alias("cluster")).distinct())


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, cluster, bits, set, weight) of the wanted classes, whose texts ``doc_id`` and ``row`` tell."""
    here = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row"), "text")
    here = among(here, "_row", wanted.select(F.col("row").alias("_row")))
    texts = here.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_row") == F.col("row"))).select(
        "class", "cluster", "bits", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column(3).to_pylist()]
        own = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64).view(np.int64)
        same = pa.array(own == batch.column(0).to_numpy())  # a row hash of two texts leaves the wrong one out
        out = [*batch.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([8 * len(s) + 128 for s in sets])]
        return pa.RecordBatch.from_arrays(out, names=["class", "cluster", "bits", "set", "weight"]).filter(same)
    return map_batches(texts, run, "class bigint, cluster bigint, bits binary, set binary, weight bigint").dropDuplicates(["class"])


def links(docs: DataFrame, rows: DataFrame, classes: DataFrame, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Spanning edges (a, b) of all similar classes (class, doc_id, row, bits); their keys are those of ``rows``."""
    wanted = materialize(classes.join(clusters(rows), "class"), "near-copy-rows")
    members = materialize(_sets(docs, wanted), "near-copy-sets")
    schema, columns = "a bigint, b bigint", ["cluster", "known", "class", "bits", "set"]

    def parts_of(n: str, weight: str):
        return F.greatest(F.ceil(F.col(n) / group), F.ceil(F.col(weight) / group_bytes)).cast("int")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    sizes = materialize(sizes.select("cluster", "w", parts_of("n", "w").alias("parts")), "near-copy-clusters")
    # small clusters share a task's group, large ones are cut into parts
    small = sizes.filter("parts = 1").agg(F.sum("w")).first()[0] or 0
    shelves = F.lit(max(1, -(-2 * small // group_bytes)))
    shelved = members.join(sizes.drop("w"), "cluster").withColumns({
        "known": F.col("class"),
        "shelf": F.when(F.col("parts") == 1, F.pmod(F.xxhash64("cluster", F.lit(2)), shelves)).otherwise(F.col("cluster")),
        "part": F.when(F.col("parts") == 1, -1).otherwise(F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts")))})
    found = materialize(shelved.select("shelf", "part", *columns).groupBy("shelf", "part").applyInArrow(
        lambda table: _compare(table.drop_columns(["shelf", "part"])), schema), "near-copy-links")
    large = sizes.filter("parts > 1").drop("w")
    if large.isEmpty():
        return found
    spread = members.join(large, "cluster").join(simhash.components(found).select(
        F.col("node").alias("class"), "root"), "class", "left").withColumns(
        {"known": F.coalesce("root", "class"), "part": F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts")).cast("int")})
    spread = materialize(spread.drop("root"), "near-copy-parts")
    counted = spread.groupBy("cluster", "known").count()
    main = counted.groupBy("cluster").agg(F.max_by("known", F.struct("count", "known")).alias("main"))
    lone = spread.join(materialize(main, "near-copy-main"), "cluster").filter("known <> main")
    chunks = materialize(lone.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).select(
        "cluster", parts_of("n", "w").alias("chunks")), "near-copy-chunks")
    visits = lone.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(3)), F.col("chunks")).cast("int"))
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hosts = spread.join(chunks, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    together = visits.select("part", "chunk", *columns).unionByName(hosts.select("part", "chunk", *columns))
    more = together.groupBy("cluster", "part", "chunk").applyInArrow(
        lambda table: _compare(table.drop_columns(["part", "chunk"])), schema)
    return found.unionByName(materialize(more, "near-copy-links"))


def near_copies(docs: DataFrame, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, component_id) of every row; the component is named by its smallest doc_id."""
    with scratch(docs.sparkSession):
        rows = materialize(_digests(docs), "near-copy-prints")
        place = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row"))
        classes = materialize(rows.groupBy("class").agg(place.alias("p"), F.first("bits").alias("bits"))
                              .select("class", "p.doc_id", "p.row", "bits"), "near-copy-classes")
        roots = simhash.components(links(docs, rows, classes, group, group_bytes))
        linked = classes.select("class", "doc_id").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "root", F.coalesce("root", "class"))
        named = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        names = linked.join(named, "root").select("class", "component_id")
        return materialize(rows.select("doc_id", "class").join(names, "class").select("doc_id", "component_id"),
                           "near-copy-components", keep=True)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, chosen as ``simhash.keep_one`` does."""
    return simhash.keep_least(docs, near_copies(docs))
