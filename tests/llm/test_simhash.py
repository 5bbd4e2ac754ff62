import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxfield.llm import simhash

from .helpers import documents, empty, odd


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    """Smallest id reachable over fingerprints within the radius, by brute force."""
    rows = [(i, f & (1 << 64) - 1) for i, f in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= radius:
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((str(rows[k][0]), rows[k][1], least.get(root(k))) for k in range(len(rows)))


def found(df):
    return sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, r["component_id"])
                  for r in df.select("doc_id", "fp", "component_id").collect())


def test_fingerprint():
    for text in [None, "", "one", "one TWO", "one two three", "É a B c É a B c", " x\x0by\tz \n", "a b c d " * 500]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    sizes = rng.integers(1, 200, 12)
    groups = np.concatenate([[0], np.cumsum(sizes)])
    fps = rng.integers(0, 2 ** 63, 4).astype(np.uint64)[rng.integers(0, 4, groups[-1])]
    for _ in range(4):
        fps ^= (np.uint64(1) << rng.integers(0, 64, groups[-1]).astype(np.uint64)) * (rng.random(groups[-1]) < 0.5)
    got = [p for i, j in simhash.within(fps, groups, radius) for p in zip(i.tolist(), j.tolist())]
    want = {(int(a + i), int(a + j)) for a, b in zip(groups, groups[1:]) for i in range(b - a) for j in range(i + 1, b - a)
            if int(fps[a + i] ^ fps[a + j]).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("group, levels", [(4096, 3), (8, 3), (8, 1)])
def test_components_equal_brute_force(spark, group, levels):
    """Also with keys that are cut again, and with groups compared in blocks."""
    rng = random.Random(group + levels)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = set()
    for _ in range(160):
        fp = rng.choice(seeds)
        for _ in range(rng.randint(0, 6)):
            fp ^= 1 << rng.randint(0, 63)
        fps.add(fp)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = list(enumerate(signed))
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(
        simhash.edges(frame, group=group, levels=levels)).collect()}
    least = {}
    for i, f in rows:
        least[roots.get(f, f)] = min(least.get(roots.get(f, f), i), i)
    got = sorted((str(i), f & (1 << 64) - 1, least[roots.get(f, f)]) for i, f in rows)
    assert got == plain_components(rows)


def test_near_duplicates_whole(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=300)
        texts += [" ".join(base)] * 3
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(300)] = "changed"
            texts.append(" ".join(copy))
    docs = documents(spark, texts)
    rows = [(k, simhash.fingerprint(t)) for k, t in enumerate(texts)]
    assert found(simhash.near_duplicates(docs)) == plain_components(rows)
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {c for _, _, c in plain_components(rows)}


def test_odd_tables(spark):
    docs = odd(spark)
    rows = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert found(simhash.near_duplicates(docs)) == plain_components(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(
        {c for i, _, c in plain_components(rows) if i != "None"}) and ids.count(None) == 2
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


def test_repeated_ids_keep_the_smallest_text(spark):
    docs = documents(spark, ["b b b b", "a a a a", "c d e f"], ids=[1, 1, 2])
    assert sorted(tuple(r) for r in simhash.keep_one(docs).select("doc_id", "text").collect()) == [
        (1, "a a a a"), (2, "c d e f")]


def test_components_of_a_path(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r["node"], r["root"]) for r in simhash.components(links).collect()} == {(k, 0) for k in range(1, 41)}
