import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxfield.llm import lattice_lm
from voxfield.llm.common import bucket

from .helpers import documents, empty, odd


def plain_log(own, logs, word):
    """Marginal probability of a word by a table over plain probabilities."""
    raw = b" " + word
    reach = [1.0] + [0.0] * len(raw)
    for a in range(len(raw)):
        node = 1
        for b in range(a, len(raw)):
            node = own.next[node * 256 + raw[b]]
            if not node:
                break
            if own.piece[node] >= 0:
                reach[b + 1] += reach[a] * math.exp(logs[own.piece[node]])
    return math.log(reach[-1])


def test_forward_equals_plain_sum():
    own = lattice_lm.pieces(None)
    rng = random.Random(1)
    words = ["".join(rng.choices("aeinrst", k=rng.randint(1, 14))).encode() for _ in range(100)]
    words += ["été".encode(), "日本".encode(), b"\x00", b"a" * 40]
    got = lattice_lm.word_logs(own, own.scores, words)
    assert np.allclose(got, [plain_log(own, own.scores, w) for w in words], atol=1e-9)
    assert np.isfinite(lattice_lm.word_logs(own, own.scores, [b"x" * 5_000])).all()


@pytest.mark.parametrize("tile", [16, 100, 1 << 14])
def test_long_words_equal_short_ones(tile):
    own, rng = lattice_lm.pieces(None), random.Random(5)
    word = "".join(rng.choices(["th", "er", "ing", "an", "q", "é", "日"], k=200)).encode()
    long = lattice_lm.LongWord(own, own.scores, word, tile)
    letters = next(iter(lattice_lm.lattices([word])))[1]
    arcs = []
    reach = lattice_lm.forward(own, own.scores, letters, arcs)
    assert np.allclose(long.forward(), reach[:, 0], atol=1e-8) and math.isclose(long.backward()[0], reach[-1, 0], abs_tol=1e-7)
    monkey, lattice_lm.LONG = lattice_lm.LONG, 10 ** 9
    want = lattice_lm.expected(own, own.scores, [word], np.array([3.0]))
    lattice_lm.LONG = monkey
    assert np.allclose(long.expected(len(own.scores)) * 3, want, atol=1e-6)
    assert np.allclose(lattice_lm.expected(own, own.scores, [b"short", word], np.array([0.0, 3.0])), want, atol=1e-6)


def test_a_word_of_200000_letters_is_fast(spark):
    docs = documents(spark, ["some words " * 30, "abcdefghij" * 20_000, "some " + "x" * 100_000 + " more"])
    start = time.time()
    rows = lattice_lm.score(docs, F.lit(True)).collect()
    assert len(rows) == 3 and all(math.isfinite(r["score"]) for r in rows) and time.time() - start < 60


def test_expectation_raises_the_likelihood():
    own, rng = lattice_lm.pieces(None), random.Random(2)
    words = ["".join(rng.choices(["th", "er", "ing", "an"], k=rng.randint(1, 4))).encode() for _ in range(80)]
    counts, logs, before = np.ones(80), own.scores, -math.inf
    for _ in range(4):
        now = lattice_lm.word_logs(own, logs, words).sum()
        assert now > before - 1e-6
        before = now
        uses = lattice_lm.expected(own, logs, words, counts)
        assert math.isclose((uses * 1.0).sum(), uses.sum()) and uses.sum() >= 80  # a piece a word at least
        logs = np.log((uses + 1e-12) / (uses + 1e-12).sum())


def test_words_are_split_at_blanks_only():
    texts = [" A\x1cB  c\n\x0bd\x85e É ", None, "", "x", "\t"]
    flat, sizes = lattice_lm.words_of(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert [w.encode() for w in flat.to_pylist()] == [w for own in want for w in own]
    assert sizes.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("block_chars", [400, 16_000_000])
def test_scores_equal_brute_force(spark, block_chars):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", "There", "ing,", "x9", "été"], k=rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "neverseen word"]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in lattice_lm.score(docs, bucket("doc_id", 10) > 0, block_chars=block_chars).collect()}
    words = {k: (t or "").encode().lower().split() for k, t in enumerate(texts)}
    learn = [k for k in words if zlib.crc32(str(k).encode()) % 10]
    counts = {}
    for k in learn:
        for w in words[k]:
            counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()) + len(learn), len(counts) + 1
    own = lattice_lm.pieces(None)
    prior, logs, end = np.exp(own.scores), own.scores, None
    known = sorted(counts)
    for _ in range(lattice_lm.ROUNDS):
        uses = lattice_lm.expected(own, logs, known, np.array([float(counts[w]) for w in known]))
        everything = uses.sum() + lattice_lm.PRIOR + len(learn)
        logs, end = np.log((uses + lattice_lm.PRIOR * prior) / everything), math.log(len(learn) / everything)
    for k, own_words in words.items():
        r = rows[k]
        c = [counts.get(w, 0) for w in own_words] + [len(learn)]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(c), sum(n > 0 for n in c), total)
        assert math.isclose(r["base_score"], sum(math.log10((n + 0.1) / (total + 0.1 * (kinds + 1))) for n in c),
                            rel_tol=1e-9)
        model = (sum(plain_log(own, logs, w) for w in own_words) + end) / math.log(10)
        assert math.isclose(r["score"], model, rel_tol=1e-9)


def test_odd_tables(spark):
    docs = odd(spark)
    rows = lattice_lm.score(docs, bucket("doc_id", 10) > 0).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lattice_lm.score(empty(spark), bucket("doc_id", 10) > 0).count() == 0
    untrained = lattice_lm.score(docs, F.lit(False)).collect()
    assert len(untrained) == docs.count() and all(r["n_known"] == r["train_tokens"] == 0 for r in untrained)
