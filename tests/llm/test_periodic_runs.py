import hashlib
import random
import zlib

import numpy as np
import pytest

from voxfield.llm import periodic_runs, queries

from .helpers import documents, empty, odd


def plain_runs(words):
    """All runs by comparing words at every distance."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequence(rng):
    """Words with repeated blocks, repeats of repeats and breaks."""
    words = []
    for _ in range(rng.randint(1, 6)):
        block = [rng.choice("ab") if rng.random() < .5 else f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 40))]
        if rng.random() < .4:
            block = (block[:rng.randint(1, 5)] * 9)[:rng.randint(3, 40)] + block[:rng.randint(0, 3)]
        words += (block * rng.randint(1, 9))[:rng.randint(1, 400)]
        if rng.random() < .5:
            words[rng.randrange(len(words))] = "x"
    return words


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    texts = [sequence(rng) for _ in range(40)] + [list(fibonacci(600)), ["a"] * 200, [], ["a", "b"] * 12, ["a", "b"] * 11]
    numbers, symbols, starts = {}, [], []
    for k, words in enumerate(texts):
        starts.append(len(symbols))
        symbols += [numbers.setdefault(w, len(numbers)) for w in words] + [10 ** 6 + k]
    symbols = np.unique(np.array(symbols), return_inverse=True)[1]
    got = periodic_runs.runs(symbols, max(map(len, texts)))
    want = [(s + a, b, q) for s, words in zip(starts, texts) for a, b, q in plain_runs(words)]
    assert [tuple(r) for r in got.tolist()] == want and len(want) > 20


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_successor():
    rng = np.random.default_rng(0)
    for n in (1, 2, 100, 257):
        values = rng.permutation(n)
        tree = periodic_runs.WaveletMatrix(values)
        low = rng.integers(0, n, 300)
        high = low + rng.integers(0, n - low + 1)
        least = rng.integers(0, n + 40, 300)
        want = [min((v for v in values[a:b].tolist() if v >= x), default=1 << 62) for a, b, x in zip(low, high, least)]
        assert tree.successor(low, high, least).tolist() == want


def test_query_equals_brute_force(spark, sf_dir, tmp_path):
    rng = random.Random(9)
    texts = [None, "", "one", " \t", "é" * 3] + [" ".join(sequence(rng)) for _ in range(150)] + ["lorem ipsum " * 4000]
    docs = documents(spark, texts + texts[:9], ids=[*range(len(texts)), *range(9)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_whole_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    short = [r for r in docs if len(r["text"] or "") < 6000]
    assert len(got) == len(docs) and len(short) > 100
    for r in short:
        assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])


def test_odd_tables(spark):
    rows = periodic_runs.find_runs(odd(spark)).collect()
    assert len(rows) == odd(spark).count() and sum(len(r["runs"]) for r in rows) == 1
    assert periodic_runs.find_runs(empty(spark)).count() == 0
