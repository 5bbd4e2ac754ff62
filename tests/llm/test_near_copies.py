import random

import numpy as np

import corpus_pipeline
from voxfield.functions.store import materialize
from voxfield.llm import near_copies, simhash

from .helpers import documents, empty, odd


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_components(texts):
    """The smallest place reachable over pairs of Jaccard similarity 0.8 or more, and how many such pairs there are."""
    sets, label, n = [plain_set(t) for t in texts], list(range(len(texts))), 0
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                n += 1
                low, high = sorted((label[a], label[b]))
                label = [low if k == high else k for k in label]
    return label, n


def corpus(rng, families=30):
    """Copies with changed words in one or several places, and with appended words; up to 30 % of the shingles differ."""
    words = [f"w{k}" for k in range(2000)]
    texts = []
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(60, 400))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy + rng.choices(words, k=rng.randint(0, len(base) // 20))))
    return texts


def test_wide_counters():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2 ** 63, 150).astype(np.uint64)
    for radius in (4, 7, 22, 30):
        got = {p for i, j in simhash.within(fps, np.array([0, 150]), radius) for p in zip(i.tolist(), j.tolist())}
        assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_stage_equals_brute_force(spark):
    texts = corpus(random.Random(1))
    label, n = plain_components(texts)
    assert n > 100 and len(set(label)) < len(texts)
    docs = documents(spark, texts)
    for group in (near_copies.GROUP, 8):
        assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, group).collect()} == dict(enumerate(label))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_keys_are_not_stored_again_with_the_classes(spark, monkeypatch):
    stored = {}

    def noted(df, name, **options):
        stored[name] = df.columns
        return materialize(df, name, **options)
    monkeypatch.setattr(near_copies, "materialize", noted)
    texts = corpus(random.Random(2), families=3)
    label, _ = plain_components(texts + texts[:9])
    got = near_copies.near_copies(documents(spark, texts + texts[:9]))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(label))
    assert [n for n, columns in stored.items() if "keys" in columns] == ["near-copy-prints"]


def test_odd_tables(spark):
    docs = odd(spark)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()].count(None) == 2
    assert near_copies.keep_one(empty(spark)).count() == 0
