"""The trie of all conversations, built in double arrays.

A conversation is a sequence of turns (role, text). Every distinct sequence of first d turns is a node of depth d; the
conversations that start with it are its members, and a node is named by its smallest member and its depth.

1. A turn becomes two 64-bit hashes. The key of a node is the exclusive or of hashes of (turn, depth) along its path, so
   keys merge like sums and need no order. Conversations with equal keys are one sequence from then on, with a weight;
   the sorted ids that end there are hashed as a stream.
2. Sequences are cut into segments of ``SEGMENT`` turns and range-partitioned by (layer, key at the segment's start,
   turns). A task takes its prefix shard in chunks of about ``CHUNK`` turns, numbers the chunk's distinct turns densely
   and packs BASE and CHECK: the child of state s by turn c is state BASE[s] + c, and CHECK there is s. All segments walk
   the arrays at once, adding up members by state; the sums of subtrees go up along CHECK.
3. A node that other chunks may hold, too, is open: the nodes along a chunk's first and last path (the shared upper
   nodes), all nodes of sequences longer than a segment, and the roots of segments. All other nodes are finished in their
   chunk. Open nodes are merged by key over all chunks. Each then belongs to the smallest path through it, values are
   summed along paths from their ends, and a node's subtree is the sum over the paths through it: no recursion, and as
   many rows as open paths have turns.

Two turns or nodes are taken as equal if 128 bits of XXH64 agree. A task holds one chunk; only the ids of one node's ends
pass through one task, as a stream of strings of up to ``ID_BLOCK`` neighbouring ids, because SHA-256 is sequential.

Defined results: rows without a conv_id belong to no conversation; null roles and texts are empty; turns with equal
numbers stand by role, then by the MD5 of the text; repeated rows are repeated turns; extra columns are ignored; an
empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scan import ordered_row_numbers, running
from ..functions.store import materialize

SEGMENT = 256
CHUNK = 1 << 17
ID_BLOCK = 1024
TRIES = 16
NOTHING = hashlib.sha256(b"").hexdigest()
KEY = ["k1", "k2"]


class DoubleArray:
    """BASE and CHECK over symbols 0 .. V - 1; state 0 is the root, -1 in CHECK marks a free slot."""

    def __init__(self, room: int = 1024) -> None:
        self.base = np.zeros(room, dtype=np.int64)
        self.check = np.full(room, -1, dtype=np.int64)
        self.check[0] = 0
        self.free = self.end = 1

    def _reserve(self, room: int) -> None:
        if room > len(self.check):
            more = max(room, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, dtype=np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, dtype=np.int64)]

    def add(self, state: int, symbols: np.ndarray) -> np.ndarray:
        """Give a state its children (sorted, distinct symbols); returns their states."""
        span = int(symbols[-1] - symbols[0])
        slot = self.free
        for _ in range(TRIES):
            self._reserve(slot + span + 1)
            while self.check[slot] >= 0:
                slot += 1
                self._reserve(slot + span + 1)
            if len(symbols) == 1 or (self.check[slot - symbols[0] + symbols] < 0).all():
                break
            slot += 1
        else:
            slot = self.end
            self._reserve(slot + span + 1)
        base = slot - int(symbols[0])
        self.base[state] = base
        states = base + symbols
        self.check[states] = state
        self.end = max(self.end, int(states[-1]) + 1)
        self._reserve(self.end + 1)
        while self.check[self.free] >= 0:
            self.free += 1
        return states


def dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... of the distinct rows of several columns."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), dtype=np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def pack(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> DoubleArray:
    """The double array of sequences that are sorted by some order of the symbols, given one behind the other."""
    trie = DoubleArray(2 * len(symbols) + 1024)
    state = np.zeros(len(sizes), dtype=np.int64)
    active = np.arange(len(sizes))
    for level in range(int(sizes.max(initial=0))):
        active = active[sizes[active] > level]
        parent, symbol = state[active], symbols[starts[active] + level]
        new = np.r_[True, (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])]
        first = np.flatnonzero(new)
        # children of one parent stand together
        cuts = np.r_[np.flatnonzero(np.r_[True, parent[first][1:] != parent[first][:-1]]), len(first)]
        child = np.empty(len(first), dtype=np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = symbol[first[a:b]]
            order = np.argsort(own)
            child[a + order] = trie.add(int(parent[first[a]]), own[order])
        state[active] = child[np.cumsum(new) - 1]
    return trie


_NODE = ("kind string, b bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, owner bigint, parent_owner bigint, "
         "n bigint, children bigint, leaves bigint, saved bigint, chars bigint, ends string")


def _chunk(rows: pa.Table, segment: int) -> pa.RecordBatch:
    """Nodes and open paths of sorted segments."""
    column = {name: rows.column(name).combine_chunks() for name in rows.column_names}
    layer, s1, s2, conv, weight = (column[c].to_numpy(zero_copy_only=False) for c in ("layer", "s1", "s2", "conv_id", "n"))
    long = column["long"].to_numpy(zero_copy_only=False).astype(bool)
    turns = column["turns"]
    sizes = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    field = dict(zip(("depth", "g1", "g2", "h1", "h2", "chars"),
                     (f.to_numpy(zero_copy_only=False) for f in turns.flatten().flatten())))
    m, at = len(sizes), np.cumsum(sizes) - sizes
    # every sequence begins with the symbol of its segment's root
    root = dense(layer, s1, s2)
    turn = dense(field["g1"], field["g2"]) + int(root.max()) + 1
    symbols = np.empty(len(turn) + m, dtype=np.int64)
    is_root = np.zeros(len(symbols), dtype=bool)
    is_root[at + np.arange(m)] = True
    symbols[is_root], symbols[~is_root] = root, turn
    starts = at + np.arange(m)
    trie = pack(symbols, starts, sizes + 1)

    room = trie.end
    n, chars, depth = (np.zeros(room, dtype=np.int64) for _ in range(3))
    k1, k2 = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)
    none = np.iinfo(np.int64).max
    owner = np.full(room, none)
    open_ = np.zeros(room, dtype=bool)
    open_[0] = True
    follow = long.copy()
    follow[[0, -1]] = True
    levels, paths, state, active = [], [], np.zeros(m, dtype=np.int64), np.arange(m)
    for level in range(int(sizes.max()) + 1):
        active = active[sizes[active] >= level]
        before = state[active]
        now = trie.base[before] + symbols[starts[active] + level]
        if (trie.check[now] != before).any():
            raise AssertionError("a sequence leaves the double array")
        state[active] = now
        if level:
            place = at[active] + level - 1
            np.add.at(n, now, weight[active])
            np.minimum.at(owner, now, conv[active])
            k1[now], k2[now] = k1[before] ^ field["h1"][place], k2[before] ^ field["h2"][place]
            depth[now], chars[now] = field["depth"][place], field["chars"][place]
        else:
            k1[now], k2[now], depth[now] = s1[active], s2[active], layer[active] * segment
            open_[now] = True
        open_[now[follow[active]]] = True
        levels.append(np.unique(now))
        seen = follow[active] & ((level > 0) | (layer[active] == 0))
        paths.append((conv[active][seen], now[seen]))
    ends = np.full(room, None, dtype=object)
    # of the sequences with one path at most one ends there; the others go on in the next layer
    stops = column["ends"].is_valid().to_numpy(zero_copy_only=False)
    ends[state[stops]] = np.array(column["ends"].to_pylist(), dtype=object)[stops]

    children, leaves, saved = (np.zeros(room, dtype=np.int64) for _ in range(3))
    for nodes in levels[:0:-1]:
        closed = nodes[~open_[nodes]]
        leaves[closed] += children[closed] == 0
        saved[closed] += (n[closed] - 1) * chars[closed]
        up = trie.check[closed]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[closed])
        np.add.at(saved, up, saved[closed])
    nodes = np.concatenate(levels)
    up = trie.check[nodes]
    roots = np.zeros(room, dtype=bool)
    roots[levels[0]] = True
    kind = np.where(open_[nodes], "open", np.where(open_[up], "below", "closed")).astype(object)
    b, followed = (np.concatenate(x) for x in zip(*paths))
    more = len(b)

    def both(values: np.ndarray, path_values: np.ndarray | None = None, null: np.ndarray | None = None) -> pa.Array:
        tail = np.zeros(more, dtype=np.int64) if path_values is None else path_values
        mask = np.r_[np.zeros(len(nodes), dtype=bool) if null is None else null, np.full(more, path_values is None)]
        return pa.array(np.r_[values, tail], pa.int64(), mask=mask)
    at_root = roots[nodes]
    return pa.RecordBatch.from_arrays([
        pa.array(np.r_[kind, np.full(more, "path", dtype=object)], pa.string()),
        both(np.zeros(len(nodes), dtype=np.int64), b, np.ones(len(nodes), dtype=bool)),
        both(depth[nodes], depth[followed]), both(k1[nodes], k1[followed]), both(k2[nodes], k2[followed]),
        both(k1[up], null=at_root), both(k2[up], null=at_root), both(owner[nodes], null=at_root),
        both(owner[up], null=at_root | open_[up]), both(n[nodes]), both(children[nodes]), both(leaves[nodes]),
        both(saved[nodes]), both(chars[nodes], null=at_root),
        pa.array(np.r_[ends[nodes], np.full(more, None, dtype=object)], pa.string())],
        schema=_arrow_schema())


def _pieces(batches, chunk: int):
    """Tables of about ``chunk`` turns."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for k, turns in enumerate(batch.column("turns").value_lengths().to_pylist()):
            size += turns
            if size >= chunk:
                yield pa.Table.from_batches([*held, batch.slice(start, k + 1 - start)])
                held, size, start = [], 0, k + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _arrow_schema() -> pa.Schema:
    return pa.schema([(name, pa.string() if kind == "string" else pa.int64())
                      for name, kind in (f.split() for f in _NODE.split(", "))])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, g1, g2, chars) of every turn: its place from 1 on in its conversation, its hashes, its length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("tie"),
        F.xxhash64(role, text).alias("g1"), F.xxhash64(F.lit(1), text, role).alias("g2"),
        F.length(text).cast("long").alias("chars"))
    return ordered_row_numbers(turns, ["conv_id"], ["turn", "role", "tie"], "place").select(
        "conv_id", F.col("place").cast("long").alias("place"), "g1", "g2", "chars")


def share_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each conversation c took its first h = crc32(c) % ``most`` turns from the conversation
    c - c % ``every`` (all if that has fewer, none if there is none); its own turns after its first h follow."""
    own = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "trie-sizes")
    convs = own.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"),
                       (F.col("conv_id") - F.col("conv_id") % every).alias("giver"))
    convs = convs.join(own.select(F.col("conv_id").alias("giver"), F.col("size").alias("given")), "giver", "left").select(
        "conv_id", "h", "giver", F.least("h", F.coalesce("given", F.lit(0))).alias("given"))
    convs = materialize(convs, "trie-conversations")
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "giver")
    heads = heads.join(convs.filter("given > 0"), "giver").filter("place <= given")
    tails = turns.join(convs, "conv_id").filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("given"))
    columns = ["conv_id", "place", "g1", "g2", "chars"]
    return convs.select("conv_id"), heads.select(columns).unionByName(tails.select(columns))


def _ends(members: DataFrame) -> DataFrame:
    """(len, k1, k2, ends): the digest of the ascending, comma-joined ids of each sequence's conversations."""
    key = ["len", *KEY]
    blocks = members.groupBy(*key, F.floor(F.col("conv_id") / ID_BLOCK).alias("part")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    blocks = blocks.repartition(*key).sortWithinPartitions(*key, "part")

    def run(batches):
        last, digest = None, None
        for batch in batches:
            done = []
            for *group, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if group == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        done.append((*last, digest.hexdigest()))
                    last, digest = group, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield _end_rows(done)
        if last is not None:
            yield _end_rows([(*last, digest.hexdigest())])
    return blocks.select(*key, "ids").mapInArrow(run, "len bigint, k1 bigint, k2 bigint, ends string")


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["len", *KEY, "ends"])


def nodes(conversations: DataFrame, turns: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``conversations`` (conv_id) lists all, also those without turns; ``turns`` are (conv_id, place, g1, g2, chars).
    """
    h1, h2 = F.xxhash64("g1", "g2", "place"), F.xxhash64("g2", "g1", "place", F.lit(1))
    turns = materialize(turns.withColumns({"h1": h1, "h2": h2}), "trie-turns")
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), F.bit_xor("h1").alias("k1"), F.bit_xor("h2").alias("k2"))
    members = conversations.join(whole, "conv_id", "left").na.fill(0, ["len", *KEY])
    members = materialize(members, "trie-members")
    sequences = members.groupBy("len", *KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    sequences = materialize(sequences.join(_ends(members), ["len", *KEY]), "trie-sequences")

    place = F.struct("place", "g1", "g2", "h1", "h2", "chars")
    segments = turns.join(sequences.select("conv_id"), "conv_id", "left_semi").groupBy(
        "conv_id", F.floor((F.col("place") - 1) / segment).alias("layer")).agg(
        F.sort_array(F.collect_list(place)).alias("turns"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    segments = segments.join(sequences.select("conv_id", "len", "n", "ends"), "conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.select(
        "layer", *(F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(s) for x, s in (("x1", "s1"), ("x2", "s2"))),
        F.transform("turns", lambda t: F.struct(t["g1"], t["g2"])).alias("path"), "conv_id", "n",
        (F.col("len") > segment).alias("long"), F.when((F.col("layer") + 1) * segment >= F.col("len"), F.col("ends")).alias("ends"),
        "turns")
    segments = materialize(segments, "trie-segments")
    order = ["layer", "s1", "s2", "path", "conv_id"]

    def run(batches):
        for piece in _pieces(batches, chunk):
            yield _chunk(piece, segment)
    shards = segments.repartitionByRange(*order).sortWithinPartitions(*order).drop("path")
    built = materialize(shards.mapInArrow(run, _NODE), "trie-nodes")

    # the root has all conversations; it is open in every chunk
    top = members.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("depth"), "owner", "n")
    top = top.join(sequences.filter("len = 0").select("k1", "k2", "ends"), KEY, "left")
    parts = built.filter("kind = 'open'").unionByName(top, allowMissingColumns=True)
    merged = parts.groupBy(*KEY).agg(
        F.min("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("owner").alias("owner"),
        F.sum("n").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("children", "leaves", "saved")),
        F.max("chars").alias("chars"), F.max("ends").alias("ends"))
    merged = materialize(merged, "trie-open")
    grown = merged.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("_more"))
    merged = merged.join(grown, KEY, "left").withColumn("children", F.col("children") + F.coalesce("_more", F.lit(0)))
    merged = merged.withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("long")).withColumn(
        "saved", F.col("saved") + F.coalesce((F.col("n") - 1) * F.col("chars"), F.lit(0)))
    paths = built.filter("kind = 'path'").select("b", "depth", *KEY)
    belongs = paths.groupBy(*KEY).agg(F.min("b").alias("_least"))
    along = paths.join(belongs, KEY).join(merged.select(*KEY, "leaves", "saved"), KEY).select(
        "b", *KEY, (-F.col("depth")).alias("_from_end"),
        *(F.when(F.col("b") == F.col("_least"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("leaves", "saved")))
    along = materialize(along, "trie-paths")
    for c in ("leaves", "saved"):
        along = running(along, ["b"], "_from_end", c, F.sum, f"all_{c}")
    below = along.groupBy(*KEY).agg(F.sum("all_leaves").alias("all_leaves"), F.sum("all_saved").alias("all_saved"))
    merged = merged.join(below, KEY, "left").withColumns({c: F.coalesce(f"all_{c}", c) for c in ("leaves", "saved")})
    merged = materialize(merged.select(*KEY, "p1", "p2", "depth", "owner", "n", "children", "leaves", "saved", "ends"), "trie-merged")
    names = merged.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_owner"))
    rest = ["depth", "owner", "n", "children", "leaves", "saved", "ends"]
    hung = built.filter("kind = 'below'").select("p1", "p2", *rest).join(names, ["p1", "p2"])
    every = built.filter("kind = 'closed'").select(*rest, "parent_owner").unionByName(hung.select(*rest, "parent_owner"))
    every = every.unionByName(merged.join(names, ["p1", "p2"], "left").select(*rest, "parent_owner"))
    return every.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
