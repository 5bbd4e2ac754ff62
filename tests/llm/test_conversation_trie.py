import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tools.check import difference
from voxfield.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn int, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (held[0], len(path), members[path[:-1]][0] if path else None, len(held), children[path], leaves[path], saved[path],
         hashlib.sha256(",".join(str(c) for c in held if len(convs[c]) == len(path)).encode()).hexdigest())
        for path, held in members.items())


def conversations(rng, n=400, longest=14):
    """Shared first turns, copies, conversations that are prefixes of others, and some long ones."""
    rows, kept = [], []
    for c in rng.sample(range(2000), n):
        turns = []
        if kept and rng.random() < .6:
            turns = list(rng.choice(kept))
            turns = turns[:rng.randint(0, len(turns))]
        while len(turns) < rng.randint(1, longest):
            turns.append((rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bb", "c" * rng.randint(1, 30)])))
        kept.append(turns)
        rows += [(c, k if rng.random() < .98 else None, r, x) for k, (r, x) in enumerate(turns)]
    return rows


def got(frame, segment=conversation_trie.SEGMENT, chunk=conversation_trie.CHUNK):
    turns = conversation_trie.numbered(frame)
    df = conversation_trie.nodes(*conversation_trie.share_heads(turns), segment, chunk)
    assert df.columns == NAMES
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,segment,chunk", [(1, 4, 60), (2, 5, 1)])
def test_equals_brute_force(spark, seed, segment, chunk):
    rows = conversations(random.Random(seed))
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), segment, chunk) == plain_nodes(rows)


def test_hot_conversations(spark):
    rng = random.Random(5)
    rows = [(c, k, "user", f"t{k}" if k < 4 or c < 400 else f"{c} {k}") for c in range(600) for k in range(8)]
    rows += [(7001, k, "user", str(rng.random())) for k in range(1500)]
    assert got(spark.createDataFrame(rows, SCHEMA), 64, 500) == plain_nodes(rows)


def test_double_array():
    rng = np.random.default_rng(1)
    seqs = sorted({tuple(rng.integers(0, 50, rng.integers(1, 8)).tolist()) for _ in range(800)})
    sizes = np.array([len(s) for s in seqs])
    flat = np.array([x for s in seqs for x in s])
    trie = conversation_trie.pack(flat, np.cumsum(sizes) - sizes, sizes)
    states = {(): 0}
    for s in seqs:
        for d in range(1, len(s) + 1):
            at = int(trie.base[states[s[:d - 1]]]) + s[d - 1]
            assert trie.check[at] == states[s[:d - 1]] and states.setdefault(s[:d], at) == at
    assert len(set(states.values())) == len(states) == (trie.check >= 0).sum()


def test_odd_tables(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, None, None), (5, 2, "user", "x" * 300_000), (-7, 0, "a", "b"),
            (5, 1, "", "Ünï½ 日本")]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = plain_nodes([r for r in rows if r[0] != -7] + [(-7, 0, "a", "b")])
    for c in ("k1", "n", "b", "kind", "depth", "path", "place", "_block"):
        frame = frame.selectExpr("*", f"'clash' AS {c}")
    assert got(frame.filter("conv_id is null or conv_id > 0")) == plain_nodes([r for r in rows if r[0] != -7])
    assert len(got(frame)) == len(want)
    assert got(frame.limit(0)) == []


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/{sf}/conversations.parquet')")
    name = "op13_conversation_trie"
    assert difference(queries.QUERIES[name](spark, f"/root/testdata/{sf}"), queries.ORACLES[name], con)[0] == ""
