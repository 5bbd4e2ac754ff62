"""Toxicity: a convolutional text classifier trained in NumPy, with thresholds calibrated by language.

A word is the sum of two hashed embeddings, one of the word and one of its first bytes. Filters of several widths slide
over the words, the largest response of each filter in the document is kept, and a logistic layer scores those.
Training reads every labelled row: the rows are dealt into shards, every shard takes a pass from the same weights, and
their means are the weights of the next pass (an embedding's mean is over the shards that met it). Scoring reads every
whole text, in parallel, with the small model as a broadcast.

Thresholds: a language is guessed from the text's letters alone (a naive Bayes model over letter counts, learned from
the ``lang`` of all labelled rows). For each language the logit with the least cost of errors on the quarter of the rows
that is kept out of training is moved to score 0.5; these logits are counted in steps of 1/1024.

Defined results: a null or empty text is scored like a text without words; a label that is null is not learned from;
without usable labels of both kinds every score is next to 0; repeated rows get equal scores; extra columns are ignored by
``score`` and passed through by ``keep_clean``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.store import materialize, scratch
from .common import among, map_batches, plain_words, received, send, uniform, worker_cache

WORD_BUCKETS = 1 << 15
START_BUCKETS = 1 << 13
START_BYTES = 6
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
#: What a task trains on at once, in rows and in words; all rows are in some shard.
SHARD_ROWS = 8_192
SHARD_WORDS = 4_000_000
#: Passes over the training rows: as many as give this many rows in all, within the two bounds.
ROWS_SEEN = 60_000
EPOCHS = (6, 24)
BATCH = 32
#: Share of words that a pass hides, so that no single word decides.
HIDDEN = 0.1
FOLD = 0.25
#: A missed toxic text counts as so many wrongly rejected ones when a threshold is chosen.
MISS_COST = 3.0
LEAST_CALIBRATION = 8
#: Logits of the calibration rows are counted in steps of one part in so many, up to a bound.
LOGIT_STEPS, LOGIT_BOUND = 1 << 10, 64
CACHE = 300_000
PAD = WORD_BUCKETS + START_BUCKETS
#: Embeddings of which the changes travel in one row.
RANGE = 1 << 12


class _Ids(dict):
    """Word to its two buckets, packed in one number."""

    def __missing__(self, word: bytes) -> int:
        start = WORD_BUCKETS + zlib.crc32(word[:START_BYTES]) % START_BUCKETS
        self[word] = got = zlib.crc32(word) % WORD_BUCKETS | start << 20
        return got


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, start buckets, and where each text begins; every text gets padding so that all widths fit."""
    ids = worker_cache().setdefault("toxicity", _Ids())
    pad = [PAD | PAD << 20] * (max(WIDTHS) - 1)
    flat, begins = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for k, text in enumerate(texts):
        words = plain_words(text)
        flat += pad
        flat += map(ids.__getitem__, words) if words else pad[:1]
        begins[k + 1] = len(flat)
    if len(ids) > CACHE:
        ids.clear()
    packed = np.array(flat, dtype=np.int64)
    return packed & 0xFFFFF, packed >> 20, begins


def letters(texts: list[str | None]) -> np.ndarray:
    """Counts of the Latin-1 letters of each text."""
    out = np.zeros((len(texts), 256), dtype=np.float32)
    for k, text in enumerate(texts):
        if text:
            out[k] = np.bincount(np.frombuffer(text.lower().encode("latin-1", "ignore"), np.uint8), minlength=256)
    out[:, [c for c in range(256) if not chr(c).isalpha()]] = 0
    return out


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    letter_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 256), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def pooled(self, words, starts, begins):
        """For each text the largest response of each filter, and where it is."""
        vectors = self.embedding[words] + self.embedding[starts]
        values, places = [], []
        for width, weights, shift in zip(WIDTHS, self.filters, self.shift):
            n = len(vectors) - width + 1
            response = vectors[:n] @ weights[:DIM]
            for k in range(1, width):
                response += vectors[k:k + n] @ weights[k * DIM:(k + 1) * DIM]
            if width > 1:  # windows over the end of a text don't count
                for k in range(1, width):
                    ends = begins[1:] - k
                    response[ends[ends < n]] = -np.inf
            best = np.maximum.reduceat(response, begins[:-1], axis=0)
            values.append(np.maximum(best + shift, 0))
            places.append((response, best))
        return vectors, np.concatenate(values, axis=1), places

    def logits(self, texts: list[str | None]) -> np.ndarray:
        _, pooled, _ = self.pooled(*encode(texts))
        return pooled @ self.out + self.bias

    def language(self, texts: list[str | None]) -> np.ndarray:
        """Index of the guessed language; -1 without languages or letters."""
        return self.guess(letters(texts))

    def guess(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.languages):
            return np.full(len(counts), -1)
        return np.where(counts.sum(axis=1) > 0, (counts @ self.letter_logs.T).argmax(axis=1), -1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        moved = self.logits(texts) - self.thresholds[self.language(texts)]
        return 1 / (1 + np.exp(-np.clip(moved, -50, 50)))


def fit(texts: list[str | None], toxic: np.ndarray, languages: list[str | None], weight: np.ndarray,
        seed: int = 7) -> Model:
    """Train and calibrate on texts at hand. ``weight`` is how many rows of the whole table a row stands for."""
    rng = np.random.default_rng(seed)
    n, toxic = len(texts), np.asarray(toxic, dtype=np.float64)
    known = sorted({x for x in languages if x is not None})
    held = rng.random(n) < FOLD
    if min(toxic[~held].sum(), (1 - toxic[~held]).sum()) < 1:
        held[:] = False
    model = _train([texts[k] for k in np.flatnonzero(~held)], toxic[~held], rng)
    if n == 0 or toxic.min() == toxic.max():
        return model
    if known:
        counts = letters(texts)
        _learn_letters(model, {name: counts[[x == name for x in languages]].sum(axis=0) for name in known})
    check = np.flatnonzero(held) if held.any() else np.arange(n)
    logits = _in_parts(model.logits, [texts[k] for k in check])
    guessed = _in_parts(model.language, [texts[k] for k in check])
    _calibrate(model, logits, guessed, toxic[check], weight[check], np.ones(len(check)))
    return model


def _learn_letters(model: Model, sums: dict[str, np.ndarray]) -> None:
    model.languages = sorted(sums)
    if sums:
        found = np.stack([sums[name] for name in model.languages]) + 0.5
        model.letter_logs = np.log(found / found.sum(axis=1, keepdims=True)).astype(np.float32)


def _calibrate(model: Model, logits, guessed, toxic, weight, rows) -> None:
    """Thresholds from logits, each of which ``rows`` rows have."""
    general = _threshold(logits, toxic, weight)
    model.thresholds = np.full(len(model.languages) + 1, general)  # the last one is for texts without a language
    for k in range(len(model.languages)):
        own = guessed == k
        if min((toxic * rows)[own].sum(), ((1 - toxic) * rows)[own].sum()) >= LEAST_CALIBRATION:
            model.thresholds[k] = _threshold(logits[own], toxic[own], weight[own])


def _in_parts(fn, texts):
    return np.concatenate([fn(texts[k:k + 256]) for k in range(0, len(texts), 256)]) if texts else np.zeros(0)


def _threshold(logits, toxic, weight) -> float:
    """The middle of the gap with the fewest weighted errors; a tie goes to the widest gap."""
    order = np.argsort(logits)
    x, y = logits[order], toxic[order]
    w = weight[order] * np.where(y > 0, MISS_COST, 1)
    errors = np.concatenate([[0], np.cumsum(w * y)]) + np.concatenate([np.cumsum((w * (1 - y))[::-1])[::-1], [0]])
    padded = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    gaps = np.diff(padded)
    best = np.lexsort((-gaps, np.where(gaps > 0, errors, np.inf)))[0]
    return float(padded[best] + gaps[best] / 2)


class State:
    """A model in training, with the moments of its gradients."""

    def __init__(self, rng) -> None:
        self.model = model = Model(
            rng.normal(0, 0.1, (PAD + 1, DIM)).astype(np.float32),
            [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
        model.embedding[PAD] = 0
        self.first, self.second = [np.zeros_like(p) for p in self.flat()], [np.zeros_like(p) for p in self.flat()]
        self.grown = np.full(PAD + 1, 1e-6, dtype=np.float32)
        self.bias_grown, self.step = 1e-6, 0

    def flat(self) -> list[np.ndarray]:
        return [self.model.out, *self.model.filters, *self.model.shift]

    def dense(self) -> np.ndarray:
        """Everything but the embeddings, in one vector."""
        return np.concatenate([*[p.ravel() for p in (*self.flat(), *self.first, *self.second)],
                               [self.model.bias, self.bias_grown, self.step]]).astype(np.float64)

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for p in (*self.flat(), *self.first, *self.second):
            p[...] = values[at:at + p.size].reshape(p.shape)
            at += p.size
        self.model.bias, self.bias_grown, self.step = float(values[at]), float(values[at + 1]), float(values[at + 2])

    def learn(self, coded, toxic, share: float, passes: range, epochs: int, rng) -> None:
        """The given passes of ``epochs`` over coded texts; ``share`` of the texts of all shards is toxic."""
        model, flat = self.model, self.flat()
        row_weight = np.where(toxic > 0, 0.5 / share, 0.5 / (1 - share))
        for epoch in passes:
            rate = 0.02 * (1 - epoch / epochs) + 0.002
            order = rng.permutation(len(coded))
            for at in range(0, len(order), BATCH):
                picked = order[at:at + BATCH]
                words = np.concatenate([coded[k][0] for k in picked]).astype(np.int64)
                starts = np.concatenate([coded[k][1] for k in picked]).astype(np.int64)
                begins = np.concatenate([[0], np.cumsum([len(coded[k][0]) for k in picked])])
                hidden = rng.random(len(words)) < HIDDEN
                words[hidden], starts[hidden] = PAD, PAD
                vectors, pooled, places = model.pooled(words, starts, begins)
                p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30)))
                wrong = ((p - toxic[picked]) * row_weight[picked] / len(picked)).astype(np.float32)
                back = wrong[:, None] * model.out[None, :] * (pooled > 0)
                grads = [pooled.T @ wrong + 1e-4 * model.out]
                filter_grads, shift_grads, touched, moves = [], [], [], []
                for k, (width, weights) in enumerate(zip(WIDTHS, model.filters)):
                    own = back[:, k * FILTERS:(k + 1) * FILTERS]
                    response, best = places[k]
                    n = len(response)
                    grad = np.zeros_like(weights)
                    doc = np.repeat(np.arange(len(picked)), np.diff(begins))[:n]
                    row, col = np.nonzero(response == best[doc])
                    rows, cols = doc[row], col
                    _, keep = np.unique(rows * FILTERS + cols, return_index=True)  # the first of equal places
                    row, rows, cols = row[keep], rows[keep], cols[keep]
                    g = own[rows, cols]
                    some = g != 0
                    row, cols, g = row[some], cols[some], g[some]
                    for offset in range(width):
                        part = weights[offset * DIM:(offset + 1) * DIM]
                        np.add.at(grad[offset * DIM:(offset + 1) * DIM].T, cols, g[:, None] * vectors[row + offset])
                        touched.append(row + offset)
                        moves.append(g[:, None] * part[:, cols].T)
                    filter_grads.append(grad + 1e-4 * weights)
                    shift_grads.append(own.sum(axis=0))
                grads += filter_grads + shift_grads
                self.step += 1
                for p_, g_, a, b in zip(flat, grads, self.first, self.second):
                    a += 0.1 * (g_ - a)
                    b += 0.01 * (g_ * g_ - b)
                    p_ -= rate * 0.5 * (a / (1 - 0.9 ** self.step)) / (np.sqrt(b / (1 - 0.99 ** self.step)) + 1e-7)
                self.bias_grown += float(wrong.sum()) ** 2
                model.bias -= rate * float(wrong.sum()) / self.bias_grown ** 0.5
                at_words, moved = np.concatenate(touched), np.concatenate(moves)
                ids = np.concatenate([words[at_words], starts[at_words]])
                both = np.concatenate([moved, moved])
                real = ids != PAD
                ids, both = ids[real], both[real]
                if len(ids):
                    unique, back_to = np.unique(ids, return_inverse=True)
                    sums = np.zeros((len(unique), DIM), dtype=np.float32)
                    np.add.at(sums, back_to, both)
                    self.grown[unique] += (sums ** 2).mean(axis=1)
                    model.embedding[unique] -= 3 * rate * sums / np.sqrt(self.grown[unique])[:, None]


def _nothing(state: State) -> Model:
    """Nothing to learn: every score is next to 0."""
    state.model.out[:] = 0
    state.model.bias = -50.0
    return state.model


def _epochs(rows: int) -> int:
    return int(np.clip(ROWS_SEEN / rows, *EPOCHS))


def _train(texts, toxic, rng) -> Model:
    state = State(rng)
    if min(toxic.sum(), (1 - toxic).sum()) < 1:
        return _nothing(state)
    epochs = _epochs(len(texts))
    state.learn([encode([text])[:2] for text in texts], toxic, toxic.mean(), range(epochs), epochs, rng)
    return state.model


def _labelled(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """Every row of ``docs`` with a label, coded: place, held, toxic, lang, words (two 16-bit buckets each), letters."""
    marked = materialize(labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")), "labels")
    rows = among(docs.select("doc_id", "text", "lang"), "doc_id", marked).select(
        "doc_id", "text", "lang", uniform("doc_id", "text", seed=seed).alias("place"),
        (uniform("doc_id", "text", seed=seed + 1) < FOLD).alias("held"))
    kept = ["doc_id", "lang", "place", "held"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        words, starts, begins = encode(texts)
        code = np.stack([words, starts], axis=1).astype("<u2")
        coded = [code[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])]
        counts = [row.tobytes() for row in letters(texts).astype("<u4")]
        return pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(coded, pa.binary()), pa.array(counts, pa.binary())],
                                          names=[*kept, "words", "letters"])
    ids = docs.schema["doc_id"].dataType.simpleString()
    coded = map_batches(rows, run, f"doc_id {ids}, lang string, place double, held boolean, words binary, letters binary")
    return coded.join(marked.hint("merge"), "doc_id").drop("doc_id")


def _decode(code: bytes) -> np.ndarray:
    """Word buckets and start buckets."""
    return np.frombuffer(code, "<u2").reshape(-1, 2).T


def _pieces(batches):
    """(shard, labels, coded texts) of rows that come in the order of their shards, cut at ``SHARD_ROWS`` and ``SHARD_WORDS``."""
    shard, toxic, coded, size = None, [], [], 0
    for batch in batches:
        for own, label, code in zip(*(batch[c].to_pylist() for c in ("shard", "toxic", "words"))):
            if coded and (own != shard or len(coded) >= SHARD_ROWS or size + len(code) // 4 > SHARD_WORDS):
                yield shard, np.array(toxic, dtype=np.float64), coded
                toxic, coded, size = [], [], 0
            shard = own
            toxic.append(label)
            coded.append(_decode(code))
            size += len(code) // 4
    if coded:
        yield shard, np.array(toxic, dtype=np.float64), coded


def _summed(batches):
    """The vectors of each part of a task, added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch["part"].to_pylist(), batch["data"].to_pylist()):
            values = np.frombuffer(data)
            sums[part] = sums[part] + values if part in sums else values
    yield _part_rows(sums)


def _part_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                      names=["part", "data"])


def _pass(shards: DataFrame, state: State, share: float, passes: range, epochs: int, seed: int) -> None:
    """Every shard learns from the same state, which then becomes the mean of theirs.

    The sums are made by Spark, part by part; what the driver gets has the size of the model. A number is averaged over
    the rows of the shards, an embedding over the shards that changed it.
    """
    sent = send(shards.sparkSession, state)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for piece, (shard, toxic, coded) in enumerate(_pieces(batches)):
            old, new = received(sent), received(sent)
            new.learn(coded, toxic, share, passes, epochs, np.random.default_rng([seed, shard, piece, passes.start]))
            moved = np.column_stack([new.model.embedding - old.model.embedding, new.grown - old.grown, new.grown != old.grown])
            parts = {k: moved[k * RANGE:(k + 1) * RANGE].astype(np.float64).ravel() for k in range(-(-len(moved) // RANGE))}
            parts[-1] = np.append(new.dense(), 1.0) * len(coded)
            for part, values in parts.items():
                sums[part] = sums[part] + values if part in sums else values
        if sums:
            yield _part_rows(sums)
    schema = "part int, data binary"
    parts = shards.select("shard", "toxic", "words").mapInArrow(run, schema).repartition("part").mapInArrow(_summed, schema)
    for part, data in parts.collect():
        values = np.frombuffer(data)
        if part < 0:
            state.set_dense(values[:-1] / values[-1])
        else:
            moved = values.reshape(-1, DIM + 2)
            moved = moved[:, :-1] / np.maximum(moved[:, -1:], 1)
            state.model.embedding[part * RANGE:(part + 1) * RANGE] += moved[:, :DIM].astype(np.float32)
            state.grown[part * RANGE:(part + 1) * RANGE] += moved[:, DIM].astype(np.float32)
    sent.unpersist()


def _letter_sums(rows: DataFrame) -> dict[str, np.ndarray]:
    """Letter counts of all rows by language."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, counts in zip(batch["lang"].to_pylist(), batch["letters"].to_pylist()):
                sums.setdefault(lang, np.zeros(256, np.int64))
                sums[lang] += np.frombuffer(counts, "<u4")
        for lang, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * 256), pa.array(np.arange(256, dtype="int32")), pa.array(counts)],
                                             names=["lang", "letter", "n"])
    found = rows.filter("lang is not null").select("lang", "letters").mapInArrow(run, "lang string, letter int, n bigint").groupBy(
        "lang", "letter").agg(F.sum("n").alias("n")).collect()
    out: dict[str, np.ndarray] = {}
    for lang, letter, n in found:
        out.setdefault(lang, np.zeros(256))[letter] = n
    return out


def _check_counts(rows: DataFrame, model: Model) -> list:
    """(language, logit, toxic, n): how many of the rows have this guessed language, stepped logit and label."""
    def run(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
        coded = [_decode(code) for code in batch["words"].to_pylist()]
        begins = np.concatenate([[0], np.cumsum([len(c[0]) for c in coded])])
        _, pooled, _ = model.pooled(*(np.concatenate([c[k] for c in coded]).astype(np.int64) for k in (0, 1)), begins)
        logits = np.clip(np.rint((pooled @ model.out + model.bias) * LOGIT_STEPS), -LOGIT_BOUND * LOGIT_STEPS, LOGIT_BOUND * LOGIT_STEPS)
        counts = np.stack([np.frombuffer(c, "<u4") for c in batch["letters"].to_pylist()]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array(model.guess(counts).astype(np.int32)), pa.array(logits.astype(np.int32)), batch["toxic"]],
                                          names=["language", "logit", "toxic"])
    sent = send(rows.sparkSession, model)
    each = map_batches(rows.select("toxic", "words", "letters"), run, "language int, logit int, toxic int", sent=sent)
    return each.groupBy("language", "logit", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """Learn from every row of ``docs`` (doc_id, text, lang) with a label in ``labels`` (doc_id, toxic).

    Rows without a label are dropped before the join by a filter of the labelled ids. A quarter of the rows, chosen by a
    hash, is for the thresholds, unless the others lack a label; all rows give letter counts.
    """
    state = State(np.random.default_rng(seed))
    with scratch(docs.sparkSession):
        rows = materialize(_labelled(docs, labels, seed), "labelled")
        found = {(r["toxic"], r["held"]): r for r in rows.groupBy("toxic", "held").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("words") / 4).alias("words")).collect()}
        total = lambda column, toxic=(0, 1), held=(False, True): sum(
            found[k][column] for k in found if k[0] in toxic and k[1] in held)
        if not total("n", [0]) or not total("n", [1]):
            return _nothing(state)
        folds = [False] if total("n", [0], [False]) and total("n", [1], [False]) else [False, True]
        n, share = total("n", held=folds), total("n", [1], folds) / total("n", held=folds)
        count = int(max(-(-n // SHARD_ROWS), -(-total("words", held=folds) // SHARD_WORDS)))
        shards = rows.filter(F.col("held").isin(folds)).select(
            F.floor(F.col("place") * count).cast("int").alias("shard"), "place", "toxic", "words")
        shards = materialize(shards.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "place", "words", "toxic"), "shards")
        epochs = _epochs(n)
        for first in range(0, epochs, epochs if count == 1 else 1):
            _pass(shards, state, share, range(first, epochs if count == 1 else first + 1), epochs, seed)
        model = state.model
        _learn_letters(model, _letter_sums(rows))
        check = rows if len(folds) > 1 else rows.filter("held")
        if total("n", held=[True]) == 0:
            check = rows
        counts = np.array([tuple(r) for r in _check_counts(check, model)], dtype=np.float64)
        language, logit, toxic, n = counts.T
        _calibrate(model, logit / LOGIT_STEPS, language, toxic, n, n)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    sent = send(docs.sparkSession, model)
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
        scores = model.scores(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
            names=["doc_id", "score", "predicted"])
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {ids}, score double, predicted int", sent=sent)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
        return batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < 0.5))
    return map_batches(docs, run, docs.schema, sent=send(docs.sparkSession, model))
