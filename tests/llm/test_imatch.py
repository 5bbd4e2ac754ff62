import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from voxfield.llm import imatch, queries

from .helpers import documents, empty, odd


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def word_hash(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), 42))


def array_hash(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return signed(h)


def plain_terms(text):
    return {word_hash(w) for w in re.findall(r"[^\W_]+", text.lower())}


def plain_mark(text, band):
    every = plain_terms(text)
    kept = sorted(every & band)
    kept = kept if len(kept) >= max(imatch.LEAST, imatch.LEAST_SHARE * len(every)) else sorted(every)
    parts, now = [], kept
    for s in range(imatch.SCALES):
        n = imatch.PARTS if s else imatch.FIRST_PARTS
        now = now if not s else [t for t in now if not t & (3 << 2 * (s - 1))]
        for j in range(n):
            own = [t for t in now if ((t & (1 << 64) - 1) >> (imatch.PART_BITS + 5 * s)) & (n - 1) == j]
            parts.append(array_hash(own) & 0xFFFF if own else None)
    return array_hash(kept), parts


def plain_written(mark):
    return f"{mark[0] & (1 << 64) - 1:016x}" + "".join("----" if p is None else f"{p:04x}" for p in mark[1])


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    held = [x == y for x, y in zip(a[1], b[1]) if x is not None or y is not None]
    return sum(held) / max(1, len(held))


def plain_rows(rows):
    texts = [t or "" for _, t in rows]
    n = Counter(t for x in texts for t in plain_terms(x))
    least = max(imatch.RARE * len(rows), sum(n.values()) / imatch.MOST_TERMS)
    band = {t for t, c in n.items() if least <= c <= imatch.COMMON * len(rows)}
    first = {}
    for i, t in rows:
        first[i] = min([t or "", *([first[i]] if i in first else [])], key=word_hash)
    order = sorted(first, key=lambda i: (i is not None, i or 0))
    after = {i: first[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    out = []
    for i, t in rows:
        t = t or ""
        k = len(t) // 2
        edited = t[:len(t) - k] + after[i][:k]
        marks = [plain_mark(x, band) for x in (t, edited, after[i])]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_written(marks[0]), plain_written(marks[1]),
                    plain_likeness(marks[0], marks[1]), plain_likeness(marks[0], marks[2])))
    return sorted(out, key=str)


def result(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    df = queries.QUERIES["op12_imatch"](spark, str(path))
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(spark, docs, tmp_path) == plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("repeated", [False, True])
def test_odd_tables(spark, tmp_path, repeated):
    docs = odd(spark) if repeated else odd(spark).dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(spark, docs, tmp_path) == plain_rows(rows)


def test_small_tables(spark, tmp_path):
    assert result(spark, empty(spark), tmp_path / "none") == []
    one = documents(spark, ["a single text"])
    assert result(spark, one, tmp_path / "one") == plain_rows([(0, "a single text")])


def test_lexicon_is_bounded(spark):
    docs = documents(spark, [" ".join(f"w{k % 40}x{j}" for j in range(50)) for k in range(400)])
    sizes = [imatch.lexicon(docs, most_terms=n).select(F.size(F.flatten("buckets"))).first()[0] for n in (1 << 19, 1500)]
    assert sizes[0] == 2000 and sizes[1] <= 1500


def test_no_python_in_the_plan(spark, sf_dir):
    df = queries.QUERIES["op12_imatch"](spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_near_copies_and_others(spark, sf_dir):
    """An edit of one word leaves most subsets alone; the half-replaced text is nearer than the next document."""
    df = queries.QUERIES["op12_imatch"](spark, sf_dir).filter("n_chars > 400")
    near, total = df.filter("near_edited > near_next").count(), df.count()
    assert near > .95 * total
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = docs.filter("n_chars > 2000").select("text", F.concat("text", F.lit(" onemoreword")).alias("changed"))
    band = imatch.lexicon(docs)
    both = imatch.with_prints(imatch.with_prints(long, "text", band, "mark"), "changed", band, "other")
    assert both.select(F.min(imatch.likeness(F.col("mark"), F.col("other")))).first()[0] > .8
