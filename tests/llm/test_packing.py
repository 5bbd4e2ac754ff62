import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from voxfield.llm import packing, tokens

from .helpers import documents, empty, odd


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def check_layout(placed, capacity):
    """placed: (sequence, offset, length); gapless from 0, within capacity. Returns the rooms left."""
    sequences = defaultdict(list)
    for sequence, offset, length in placed:
        sequences[sequence].append((offset, length))
    rooms = []
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
        rooms.append(capacity - at)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        moves = packing.plan(Counter(lengths), capacity)
        placed = []
        for length, n in Counter(lengths).items():
            own = [m for m in moves if m[0] == length]
            for rank in range(n):
                _, low, first, each, offset = [m for m in own if m[1] <= rank][-1]
                placed.append((first + (rank - low) // each, offset + (rank - low) % each * length, length))
        assert check_layout(placed, capacity) == plain_best_fit(lengths, capacity)


def test_moves_do_not_grow_with_the_pieces():
    histogram = {n: 3 + n % 7 for n in range(1, 300)}
    few = len(packing.plan(histogram, 512))
    many = len(packing.plan({n: c * 100_000 for n, c in histogram.items()}, 512))
    assert many < 4 * few + 1000


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.cut(16, 8) == [(0, 8), (8, 8)]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_documents_are_whole(spark, capacity):
    texts = [None, "", "a b", "hello world " * 40, " lead", "two  spaces", "x\ny z\n", "é" * 50, "<|endoftext|> as text",
             "日本", "the cat " * 3000]
    rows = packing.pack_documents(documents(spark, texts), capacity).collect()
    whole = tokens.encoder().whole
    for k, text in enumerate(texts):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids), capacity)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    rooms = check_layout([(r["sequence_id"], r["offset"], r["length"]) for r in rows], capacity)
    assert rooms == plain_best_fit([r["length"] for r in rows], capacity)


def test_blocks_give_the_same_sequences(spark):
    rows = [(k, 0, 0, 1 + k * 7 % 20, k) for k in range(500)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(parts, 20, block_rows=50).collect()
    assert len(got) == 500
    rooms = check_layout([(r["sequence_id"], r["offset"], r["length"]) for r in got], 20)
    assert rooms == plain_best_fit([r[3] for r in rows], 20)


def test_odd_tables(spark):
    rows = packing.pack_documents(odd(spark)).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) - 2  # id 5 and the null id come twice
    check_layout([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_encoder_equals_the_tokenizer():
    coder = tokens.encoder()
    rng = random.Random(3)
    bits = ["a", "the", "don't", " ", "  ", "\n", " \n", "9", "x9_", "É", "½", ".", "!!", "日", "\t", "\x85", "\xa0", "ª", "'S"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(600)]
    flat, bounds = coder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert flat[bounds[k]:bounds[k + 1]].tolist() == coder.whole.encode(text, add_special_tokens=False).ids
    assert coder.counts(texts) == np.diff(bounds).tolist()
