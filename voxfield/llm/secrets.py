"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least ``LEAST`` key characters, or a quoted or assigned value of at least ``LEAST_VALUE``
characters with any punctuation but quotes and blanks (an unquoted one ends at a comma, semicolon or bracket); runs within
such a value are no candidates of their own. Its features are its length and character classes, how
likely its character transitions are in ordinary words, how much of it dictionary words cover, the share of findings
among labelled candidates of its path, and the log-odds of the words beside it. The forest (bootstrap, random feature
subsets, Gini splits, NumPy) is trained on labelled findings, at most ``MOST_FINDINGS`` of each label; the
words are counted over all documents in Spark, the transitions reduced to one table there, and the dictionary sent as a
Bloom filter of ``FILTER_BITS`` bits a word (under 0.1 % of other strings pass). The dictionary holds the words that stand
twice and make up at least 1 / ``MOST_WORDS`` of all words; there can't be more than ``MOST_WORDS`` of those, so the filter
has 16 MB at most.

Labelled findings are a table (doc_id, start, stop, label). Where no reviewer has made one, ``labelled_findings`` marks
the clear cases in the documents that are learned from (all but one in ``HOLD_OUT``, by a hash of the id; what is found in
the others is the forest's word alone): a published key format or a mixed run that is assigned to a name for a credential is one, a run of
letters or of digits alone is none unless it is assigned to such a name, and all other candidates stay unlabelled.

Defined results: a null or empty text has no candidates; a null path counts as an unknown one; equal rows give equal
findings; without findings of both labels nothing is a secret; extra columns are ignored by ``findings`` and passed
through by ``redact``, which changes ``text`` (and ``n_chars``, where there is one) only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.store import materialize
from .common import bucket, map_batches, plain_words, send, uniform

LEAST = 16
LEAST_VALUE = 8
NEAR = 48
MOST_FINDINGS = 3000
HOLD_OUT = 5
MOST_WORDS = 1 << 23
FILTER_BITS = 16
FILTER_HASHES = 6
WORD_LETTERS = (4, 14)
TREES = 40
DEPTH = 8
MASK = "[secret]"
_run = re.compile(r"[A-Za-z0-9+/_\-]{%d,}" % LEAST)
_value = re.compile(r"""([\"'`])(?P<quoted>[^\s\"'`]{%d,})(?=\1)|[=:]\s{0,4}(?!//)(?P<plain>[^\s\"'`,;<>(){}\[\]]{%d,})"""
                    % (LEAST_VALUE, LEAST_VALUE))
_word = re.compile(r"[^\W\d_]+")
_assigned = re.compile(r"(?i)(token|secret|passwo?r?d|credential|api[_ -]?key|access[_ -]?key|auth)\W{0,12}[=:]\W{0,12}$")
#: Published key formats: cloud access keys, code-hosting, chat, payment and map tokens.
_formats = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|"
                      r"[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}")
#: What names a digest, a revision or encoded data; identifiers in their usual spelling.
_harmless = re.compile(r"(?i)(commit|revision|checksum|digest|\bsha\d*|\bmd5|base64)\W{0,4}$")
_uuid = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_classes = (str.isdigit, str.islower, str.isupper)


@dataclass
class Candidate:
    start: int
    stop: int
    value: str
    before: str
    after: str


def candidates(text: str | None) -> list[Candidate]:
    """Quoted or assigned values, and runs of key characters without surrounding ``-`` and ``_``, in code points."""
    text, places = text or "", []
    for m in _value.finditer(text):
        start, stop = m.span(m.lastgroup)
        if m.lastgroup == "plain":
            stop = start + len(m.group("plain").rstrip(".:?"))
        if stop - start >= LEAST_VALUE and any(ch.isalnum() for ch in text[start:stop]):
            places.append((start, stop))
    values, at = len(places), 0
    for m in _run.finditer(text):
        value = m.group().strip("-_")
        start = m.start() + m.group().index(value)
        while at < values and places[at][1] <= start:
            at += 1
        if len(value) >= LEAST and not (at < values and places[at][0] < start + len(value)):
            places.append((start, start + len(value)))
    return [Candidate(a, b, text[a:b], text[max(0, a - NEAR):a], text[b:b + NEAR]) for a, b in sorted(places)]


def clear_label(c: Candidate) -> int | None:
    """1 or 0 where the case is clear, otherwise None."""
    if _formats.fullmatch(c.value):
        return 1
    if c.value.isalpha() or c.value.isdigit():
        return None if _assigned.search(c.before) else 0
    if _harmless.search(c.before) or _uuid.fullmatch(c.value) and not _assigned.search(c.before):
        return 0
    digits = sum(ch.isdigit() for ch in c.value)
    return 1 if _assigned.search(c.before) and digits >= 3 and len(set(c.value)) >= 8 else None


def neighbours(c: Candidate) -> list[str]:
    """The three words before (marked) and the one after."""
    before = [w.lower() for w in _word.findall(c.before)][-3:]
    after = [w.lower() for w in _word.findall(c.after)][:1]
    return ["<" + w for w in before] + [">" + w for w in after]


def _places(word: str, size: int) -> list[int]:
    """The bits of a word in a filter of ``size`` bits."""
    h = xxhash.xxh3_128_intdigest(word.encode("utf-8", "replace"))
    first, step = h & (1 << 64) - 1, h >> 64 | 1
    return [(first + k * step) % size for k in range(FILTER_HASHES)]


class WordFilter:
    """A Bloom filter of the dictionary: every word of it passes, hardly any other string."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def __contains__(self, word: str) -> bool:
        return word.isalpha() and all(int(self.cells[p >> 6]) >> (p & 63) & 1 for p in _places(word, 64 * len(self.cells)))


@dataclass
class Context:
    """What the features are measured against."""
    words: frozenset | WordFilter = frozenset()
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((38, 38)))
    neighbour_odds: dict = field(default_factory=dict)
    path_rates: dict = field(default_factory=dict)
    base_rate: float = 0.0


def _codes(text: str) -> np.ndarray:
    """a-z, digits, others; the alphabet of the transitions."""
    raw = np.frombuffer(text.lower().encode("ascii", "replace"), np.uint8).astype(np.int64)
    return np.where((raw >= 97) & (raw <= 122), raw - 97, np.where((raw >= 48) & (raw <= 57), raw - 22, 36))


def features(c: Candidate, path: str | None, context: Context) -> list[float]:
    value, n = c.value, len(c.value)
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    shares = [sum(map(test, value)) / n for test in _classes]
    kinds = [0 if ch.isdigit() else 1 if ch.isupper() else 2 if ch.islower() else 3 for ch in value]
    codes = _codes(value)
    likely = float(context.transitions[codes[:-1], codes[1:]].mean())
    lower, at, covered = value.lower(), 0, 0
    while at < n - 3:
        size = next((k for k in range(min(14, n - at), 3, -1) if lower[at:at + k] in context.words), 0)
        covered += size
        at += size or 1
    odds = [context.neighbour_odds.get(w, 0.0) for w in neighbours(c)]
    return [n, entropy, len(counts) / n, *shares, sum(a != b for a, b in zip(kinds, kinds[1:])) / n, likely, covered / n,
            context.path_rates.get(path, context.base_rate), max(odds, default=0.0), sum(odds),
            float(c.before.rstrip(" \"'`").endswith(("=", ":"))), float(c.before.endswith(("\"", "'", "`"))),
            float(all(ch in "0123456789abcdefABCDEF" for ch in value))]


class Forest:
    """Bagged binary trees on threshold splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            picked = rng.integers(0, len(x), len(x))
            nodes: list[list] = []
            self._grow(x[picked], y[picked], depth, rng, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))

    def _grow(self, x, y, depth, rng, nodes) -> int:
        """Append a node (feature, threshold, left, right, share of ones) and what is below it."""
        here = len(nodes)
        nodes.append([-1, 0.0, here, here, float(y.mean())])
        if depth == 0 or len(y) < 4 or y.min() == y.max():
            return here
        best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
            values = np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 17)))
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= cut
                k = int(left.sum())
                if 0 < k < len(y):
                    a, b = y[left].mean(), y[~left].mean()
                    cost = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
                    if cost < best[0]:
                        best = (cost, f, cut)
        if best[1] is not None:
            left = x[:, best[1]] <= best[2]
            a = self._grow(x[left], y[left], depth - 1, rng, nodes)
            b = self._grow(x[~left], y[~left], depth - 1, rng, nodes)
            nodes[here][:4] = [int(best[1]), float(best[2]), a, b]
        return here

    def predict(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


@dataclass
class Model:
    context: Context
    forest: Forest | None

    def scores(self, found: list[Candidate], path: str | None) -> np.ndarray:
        if self.forest is None or not found:
            return np.zeros(len(found))
        return self.forest.predict(np.array([features(c, path, self.context) for c in found]))


def fit(found: list[tuple[Candidate, str | None, int]], texts: list[str | None], seed: int = 11) -> Model:
    """Train on (candidate, path, label) and the texts of ordinary words."""
    counts = {w.decode("utf-8", "replace"): n for w, n in Counter(w for t in texts for w in plain_words(t)).items()}
    words = frozenset(w for w, n in counts.items() if n > 1 and w.isalpha() and len(w) > 3)
    return learn(found, words, _transitions((w, n) for w, n in counts.items() if w.isalpha()), seed)


def _transitions(counts) -> np.ndarray:
    """How often each pair of codes occurs in counted words."""
    pairs = np.zeros((38, 38))
    for w, n in counts:
        codes = _codes(w)
        np.add.at(pairs, (codes[:-1], codes[1:]), n)
    return pairs


def learn(found: list[tuple[Candidate, str | None, int]], words, pairs: np.ndarray, seed: int = 11) -> Model:
    """Train on (candidate, path, label), the dictionary and the counted transitions."""
    pairs = pairs + 0.5
    context = Context(words, np.log2(pairs / pairs.sum(axis=1, keepdims=True)))
    y = np.array([label for _, _, label in found], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(context, None)
    context.base_rate = float(y.mean())
    near, paths = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for c, path, label in found:
        near[label].update(set(neighbours(c)))
        paths[label][path] += 1
    ones, zeros = y.sum(), len(y) - y.sum()
    context.neighbour_odds = {w: math.log((near[1][w] + 1) / (ones + 2)) - math.log((near[0][w] + 1) / (zeros + 2))
                              for w in near[0].keys() | near[1].keys() if near[0][w] + near[1][w] >= 5}
    context.path_rates = {p: (paths[1][p] + 10 * context.base_rate) / (paths[0][p] + paths[1][p] + 10)
                          for p in paths[0].keys() | paths[1].keys() if p is not None}
    return Model(context, Forest(np.array([features(c, p, context) for c, p, _ in found]), y, seed=seed))


_SCHEMA = "start int, stop int, value string, before string, after string, label int"


def _extract(docs: DataFrame, path: str | None) -> DataFrame:
    """All candidates with what surrounds them and their clear label."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, rows = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            for c in candidates(text):
                of.append(k)
                rows.append((c.start, c.stop, c.value, c.before, c.after, clear_label(c)))
        picked = pa.array(of, pa.int64())
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
        columns = zip(*rows) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(picked), batch.column(2).take(picked),
             *(pa.array(c, t) for c, t in zip(columns, kinds))],
            names=["doc_id", "path", "start", "stop", "value", "before", "after", "label"])
    source = F.col(path).cast("string") if path else F.lit(None).cast("string")
    return map_batches(docs.select("doc_id", "text", source.alias("path")), run, f"doc_id {ids}, path string, {_SCHEMA}")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word of letters stands in all documents."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = Counter(w for t in batch.column(0).to_pylist() for w in plain_words(t))
        words = [(w.decode("utf-8", "replace"), n) for w, n in counts.items()]
        words = [(w, n) for w, n in words if w.isalpha()]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()),
                                           pa.array([n for _, n in words], pa.int64())], names=["word", "n"])
    return map_batches(docs.select("text"), run, "word string, n bigint", rows=2048).groupBy("word").agg(F.sum("n").alias("n"))


def ordinary_words(docs: DataFrame) -> tuple[WordFilter, np.ndarray]:
    """The dictionary (words that occur twice) and the transitions of all documents."""
    counts = materialize(word_counts(docs), "word-counts")

    def reduce(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = _transitions(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())).ravel()
        some = np.flatnonzero(pairs)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(pairs[some].astype(np.int64))], names=["pair", "n"])
    pairs = np.zeros(38 * 38)
    for r in map_batches(counts, reduce, "pair bigint, n bigint", rows=8192).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    least = max(2.0, (counts.agg(F.sum("n")).first()[0] or 0) / MOST_WORDS)
    listed = counts.filter((F.col("n") >= least) & F.length("word").between(*WORD_LETTERS)).select("word")
    size = -(-max(1, listed.count()) * FILTER_BITS // 64)

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.array([p for w in batch.column(0).to_pylist() for p in _places(w, 64 * size)], dtype=np.uint64)
        bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits)], names=["cell", "bits"])
    cells = np.zeros(size, dtype=np.int64)
    marked = map_batches(listed, mark, "cell bigint, bits bigint", rows=8192).groupBy("cell").agg(F.expr("bit_or(bits)").alias("bits"))
    for part in marked.toArrow().to_batches():
        cells[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return WordFilter(cells.view(np.uint64)), pairs.reshape(38, 38)


def held_out() -> Column:
    """Whether a document's clear cases aren't learned from."""
    return bucket("doc_id", HOLD_OUT) == 0


def labelled_findings(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """(doc_id, start, stop, label) of the candidates whose case is clear."""
    return _extract(docs, path).filter("label is not null").select("doc_id", "start", "stop", "label")


def train(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source",
          most: int = MOST_FINDINGS, seed: int = 11) -> tuple[Model, DataFrame]:
    """The model, and the stored candidates of all documents. Without ``labelled`` the clear cases are learned from, but for
    those of held-out documents."""
    path = path if path in docs.columns else None
    found = materialize(_extract(docs, path), "candidates")
    known = found.filter(F.col("label").isNotNull() & ~held_out())
    if labelled is not None:
        marks = labelled.groupBy("doc_id", "start", "stop").agg(F.max("label").cast("int").alias("label"))
        known = found.drop("label").join(marks, ["doc_id", "start", "stop"])
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rate = F.lit(0.0)
    for label, n in totals.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, most / n))).otherwise(rate)
    rows = known.filter(uniform("doc_id", "start", "value", seed=seed) < rate).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["start"], r["value"], str(r["path"])))
    return learn([(Candidate(*r[2:7]), r["path"], r["label"]) for r in rows], *ordinary_words(docs), seed), found


def findings(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source",
             threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, stop, score, value_sha256, held_out) of the candidates that the forest keeps; places in code points.
    ``held_out`` tells findings in documents whose clear cases weren't learned from."""
    model, found = train(docs, labelled, path)
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(1, 7))))
        if model.forest is None or not rows:
            scores = np.zeros(len(rows))
        else:
            scores = model.forest.predict(np.array([features(Candidate(*r[1:]), r[0], model.context) for r in rows]))
        keep = np.flatnonzero(scores >= threshold)
        picked = pa.array(keep)
        hashes = [hashlib.sha256(rows[k][3].encode()).hexdigest() for k in keep]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(picked), batch.column(2).take(picked), batch.column(3).take(picked),
             pa.array(scores[keep]), pa.array(hashes, pa.string())],
            names=["doc_id", "start", "stop", "score", "value_sha256"])
    kept = map_batches(found.drop("label"), run, f"doc_id {ids}, start int, stop int, score double, value_sha256 string",
                       rows=4096, sent=send(docs.sparkSession, model))
    return kept.withColumn("held_out", held_out())


def redact(docs: DataFrame, model: Model, path: str | None = "source", threshold: float = 0.5,
           mask: str = MASK) -> DataFrame:
    """All documents, with every secret in ``text`` replaced by ``mask``."""
    names = docs.columns
    at, source = names.index("text"), names.index(path) if path in names else None
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        paths = batch.column(source).to_pylist() if source is not None else [None] * len(texts)
        sizes = batch.column(size).to_pylist() if size is not None else None
        for k, text in enumerate(texts):
            found = candidates(text)
            hit = [c for c, s in zip(found, model.scores(found, paths[k])) if s >= threshold]
            if hit:
                ends = [0, *(c.stop for c in hit)]
                texts[k] = "".join(text[a:c.start] + mask for a, c in zip(ends, hit)) + text[ends[-1]:]
                if sizes is not None:
                    sizes[k] = len(texts[k])
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if sizes is not None:
            columns[size] = pa.array(sizes, batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, names=names)
    return map_batches(docs, run, docs.schema, sent=send(docs.sparkSession, model))
