"""Subword-lattice language model: the marginal probability of a text over all segmentations into known pieces.

The pieces are those of an existing vocabulary; its order of merges gives the first scores, and expectation
maximisation over the lattices of all training words turns them into log probabilities. A text is its words, each led
by a space, and one end. Segmentations never cross words, so the probability of a text is the product over its words,
and the log-space forward recursion runs once for every distinct word of the corpus, many words of one length at a time;
a long word is computed alone, in tiles of positions.
Every single byte is a piece, so every text has a probability.

Corpus counts: documents are spread over blocks of bounded size by a hash. A block counts its distinct words; the
(block, word) rows are summed by word, scored, and joined back to the blocks, where the documents read them. So what is
shuffled grows with the vocabulary of the blocks, not with the tokens, and a frequent word is one row of each block.

Defined results: a null or empty text is one end token; without training documents the pieces keep the scores of the
vocabulary and every count is 0; a document without an id is not learned from; repeated rows count again and get a row
each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.store import materialize
from .common import received, send, slices, worker_cache
from .tokens import public_path

VOCABULARY = "piece_bpe_32k.model"
#: Characters of the documents of one block.
BLOCK_CHARS = 16_000_000
ROUNDS = 4
#: How many expected pieces the scores of the vocabulary count for.
PRIOR = 2000.0
SMOOTHING = 0.1
#: Lattice positions computed at a time.
BATCH_CELLS = 400_000
#: Words of more bytes are computed alone, tile by tile.
LONG = 400


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in a row, A-Z lower-cased, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(real)])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.filter(pa.array(real)), np.diff(ends[offsets])


@dataclass
class Pieces:
    """A trie over the bytes of the pieces; node 0 is nowhere, node 1 the root."""
    next: np.ndarray
    piece: np.ndarray  # number of the piece that ends at a node, -1 for none
    scores: np.ndarray  # natural log of the vocabulary's scores as probabilities
    longest: int

    @staticmethod
    def load(path: str) -> "Pieces":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spellings: list[bytes] = [bytes([b]) for b in range(256)]
        ranks = [1.0 * model.get_piece_size()] * 256
        for n in range(model.get_piece_size()):
            if not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n) or model.is_byte(n)):
                spelling = model.id_to_piece(n).replace("▁", " ").encode()
                if not any(65 <= b <= 90 for b in spelling) and b" " not in spelling[1:]:
                    spellings.append(spelling)
                    ranks.append(1.0 - model.get_score(n))  # merges are scored 0, -1, -2, ...
        rows: list[dict[int, int]] = [{}, {}]
        ends: dict[int, list[int]] = {}
        for n, spelling in enumerate(spellings):
            at = 1
            for b in spelling:
                if b not in rows[at]:
                    rows[at][b] = len(rows)
                    rows.append({})
                at = rows[at][b]
            ends.setdefault(at, []).append(n)
        following = np.zeros((len(rows), 256), dtype=np.int32)
        for at, row in enumerate(rows):
            if row:
                following[at, list(row)] = list(row.values())
        # a byte and a piece of the same spelling are one piece with both shares
        weight = 1 / np.array(ranks)
        order = list(ends.items())
        piece = np.full(len(rows), -1, dtype=np.int32)
        piece[[at for at, _ in order]] = np.arange(len(order))
        share = np.array([weight[own].sum() for _, own in order])
        return Pieces(following.ravel(), piece, np.log(share / share.sum()), max(map(len, spellings)))


def pieces(path: str | None) -> Pieces:
    cache = worker_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = Pieces.load(path or public_path(VOCABULARY))
    return cache["pieces", path]


class LongWord:
    """Forward and backward recursions of one long word, tile by tile of its positions.

    ``weights[i, d]`` is the probability of the piece of d + 1 bytes that ends at position i (0: there is none); no piece is
    longer than the trie is deep, so a tile needs the few positions before it only. Values are kept in range by powers that
    are taken out and counted as logs.
    """

    def __init__(self, own: Pieces, logs: np.ndarray, word: bytes, tile: int = 1 << 14) -> None:
        self.own, self.probability, self.tile = own, np.exp(logs), tile
        self.letters = np.frombuffer(b" " + word, dtype=np.uint8).astype(np.int32)
        self.length = len(self.letters)

    def arcs(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and weights by end position start + 1 .. stop and length, (positions, longest); piece -1 for none."""
        own, depth = self.own, self.own.longest
        first = max(0, start - depth + 1)
        begins = np.arange(first, stop)
        node = np.ones(len(begins), dtype=np.int32)
        pieces_at = np.full((stop - start, depth), -1, dtype=np.int32)
        for d in range(depth):
            inside = begins + d < stop
            begins, node = begins[inside], node[inside]
            node = own.next[node * 256 + self.letters[begins + d]]
            alive = node > 0
            begins, node = begins[alive], node[alive]
            if not len(begins):
                break
            ends = begins + d  # the piece ends after this letter
            here = ends >= start
            pieces_at[ends[here] - start, d] = own.piece[node[here]]
        return pieces_at, np.where(pieces_at >= 0, self.probability[pieces_at], 0.0)

    def forward(self) -> np.ndarray:
        """Log probabilities of reaching every position."""
        depth, out = self.own.longest, np.empty(self.length + 1)
        out[0], taken = 0.0, 0.0
        before = np.zeros(depth)
        before[-1] = 1.0
        for start in range(0, self.length, self.tile):
            stop = min(self.length, start + self.tile)
            weights = np.ascontiguousarray(self.arcs(start, stop)[1][:, ::-1])
            row = np.concatenate([before, np.empty(stop - start)])
            for k in range(stop - start):
                row[depth + k] = value = weights[k] @ row[k:depth + k]
                if value < 1e-100:
                    row[k + 1:depth + k + 1] /= value
                    taken += math.log(value)
                    value = 1.0
                out[start + k + 1] = math.log(value) + taken
            before = row[-depth:]
        return out

    def backward(self) -> np.ndarray:
        """Log probabilities of reaching the end from every position."""
        depth, out = self.own.longest, np.empty(self.length + 1)
        out[-1], taken = 0.0, 0.0
        after = np.zeros(depth)
        after[0] = 1.0
        for stop in range(self.length, 0, -self.tile):
            start = max(0, stop - self.tile)
            # by begin position: the piece of d + 1 bytes from b ends at b + d + 1
            far = min(self.length, stop + depth)
            ends = self.arcs(start, far)[1]
            weights = np.zeros((stop - start, depth))
            for d in range(depth):
                n = max(0, min(stop, far - d) - start)
                weights[:n, d] = ends[d:d + n, d]
            row = np.concatenate([np.empty(stop - start), after])
            for k in range(stop - start - 1, -1, -1):
                row[k] = value = weights[k] @ row[k + 1:k + 1 + depth]
                if value < 1e-100:
                    row[k:k + depth] /= value
                    taken += math.log(value)
                    value = 1.0
                out[start + k] = math.log(value) + taken
            after = row[:depth].copy()
        return out

    def expected(self, size: int) -> np.ndarray:
        """Expected uses of every piece."""
        reach, rest = self.forward(), self.backward()
        total, out = reach[-1], np.zeros(size)
        for start in range(0, self.length, self.tile):
            stop = min(self.length, start + self.tile)
            found, weights = self.arcs(start, stop)
            at, d = np.nonzero(found >= 0)
            ends = start + at + 1
            share = weights[at, d] * np.exp(reach[ends - d - 1] + rest[ends] - total)
            out += np.bincount(found[at, d], weights=share, minlength=size)
        return out


def lattices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes) of words of one length, led by a space, in batches of bounded size."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order])) + 1
    for own in np.split(order, bounds) if len(order) else []:
        size = int(sizes[own[0]])
        step = max(1, BATCH_CELLS // (size + 2))
        for k in range(0, len(own), step):
            places = own[k:k + step]
            raw = np.frombuffer(b"".join(words[p] for p in places), dtype=np.uint8).reshape(len(places), size)
            yield places, np.concatenate([np.full((len(places), 1), 32, np.uint8), raw], axis=1).T.astype(np.int32)


def forward(own: Pieces, logs: np.ndarray, letters: np.ndarray, arcs: list | None = None) -> np.ndarray:
    """Log probabilities of reaching every position, (length + 1, words). ``arcs`` gets all arcs of the lattice."""
    length, count = letters.shape
    reach = np.full((length + 1, count), -np.inf)
    reach[0] = 0
    for start in range(length):
        active, node = np.arange(count), np.ones(count, dtype=np.int32)
        for stop in range(start, min(length, start + own.longest)):
            node = own.next[node * 256 + letters[stop, active]]
            alive = node > 0
            if not alive.all():
                active, node = active[alive], node[alive]
                if not len(active):
                    break
            piece = own.piece[node]
            ends = piece >= 0
            at, piece = (active, piece) if ends.all() else (active[ends], piece[ends])
            if len(at):
                reach[stop + 1, at] = np.logaddexp(reach[stop + 1, at], reach[start, at] + logs[piece])
                if arcs is not None:
                    arcs.append((start, stop + 1, at, piece))
    return reach


def expected(own: Pieces, logs: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the lattices of words that occur ``counts`` times."""
    out = np.zeros(len(logs))
    long = [k for k, w in enumerate(words) if len(w) > LONG]
    for k in long:
        out += LongWord(own, logs, words[k]).expected(len(logs)) * counts[k]
    if long:
        counts = np.delete(counts, long)
        words = [w for w in words if len(w) <= LONG]
    for places, letters in lattices(words):
        arcs: list = []
        reach = forward(own, logs, letters, arcs)
        back = np.full(reach.shape, -np.inf)
        back[-1] = 0
        for start, stop, at, piece in reversed(arcs):
            back[start, at] = np.logaddexp(back[start, at], back[stop, at] + logs[piece])
        weight = counts[places]
        for start, stop, at, piece in arcs:
            share = np.exp(reach[start, at] + logs[piece] + back[stop, at] - reach[-1, at]) * weight[at]
            out += np.bincount(piece, weights=share, minlength=len(logs))
    return out


def word_logs(own: Pieces, logs: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.zeros(len(words))
    short = []
    for k, w in enumerate(words):
        if len(w) > LONG:
            out[k] = LongWord(own, logs, w).forward()[-1]
        else:
            short.append(k)
    for places, letters in lattices([words[k] for k in short]):
        out[np.array(short)[places]] = forward(own, logs, letters)[-1]
    return out


def _by_slices(fn: Callable, path: str | None, sent):
    """Run ``fn(batch, pieces, logs)`` over slices of a table of words."""
    def run(batches):
        own, logs = pieces(path), received(sent)
        for part in slices(batches, 50_000):
            yield fn(part, own, logs)
    return run


def _words(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(0).cast(pa.binary()).to_pylist()


def _expectation(batch: pa.RecordBatch, own: Pieces, logs: np.ndarray) -> pa.RecordBatch:
    sums = expected(own, logs, _words(batch), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
    used = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["piece", "n"])


def _score(batch: pa.RecordBatch, own: Pieces, logs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_logs(own, logs, _words(batch)))],
                                      names=["word", "c", "log_p"])


def _count_block(table: pa.Table) -> pa.Table:
    """The distinct words of one block with their count in its training documents."""
    flat, sizes = words_of(table["text"].combine_chunks())
    coded = flat.dictionary_encode()
    learn = np.repeat(table["learn"].to_numpy().astype(float), sizes)
    counts = np.bincount(coded.indices.to_numpy(), weights=learn, minlength=len(coded.dictionary))
    block = table["block"][0] if table.num_rows else 0
    return pa.table({"block": pa.repeat(block, len(counts)), "word": coded.dictionary.cast(pa.string()),
                     "n": pa.array(counts.astype(np.int64))})


def score(docs: DataFrame, learn: Column, vocabulary: str | None = None, rounds: int = ROUNDS,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``learn`` marks the training documents. ``base_score`` is the additively smoothed unigram model over words,
    ``score`` the lattice model; both are log10 of the probability of the whole text.
    """
    spark = docs.sparkSession
    ids = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size, training = texts.agg(F.sum(F.length("text")), F.count_if("learn")).first()
    blocks = max(1, -(-(size or 0) // block_chars))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    counted = materialize(texts.select("block", "text", "learn").groupBy("block").applyInArrow(
        _count_block, "block bigint, word string, n bigint"), "block-words")
    corpus = materialize(counted.groupBy("word").agg(F.sum("n").alias("c")), "words")
    tokens, distinct = corpus.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, kinds = (tokens or 0) + training, distinct + (training > 0)

    own = pieces(vocabulary)
    prior = np.exp(own.scores)
    logs, end_log = own.scores, math.log(0.5)
    for _ in range(rounds if training else 0):
        sums = corpus.filter("c > 0").mapInArrow(_by_slices(_expectation, vocabulary, send(spark, logs)),
                                                 "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        uses = np.zeros(len(logs))
        for row in sums.collect():  # at most one row for each piece of the vocabulary
            uses[row["piece"]] = row["n"]
        everything = uses.sum() + PRIOR + training
        logs, end_log = np.log((uses + PRIOR * prior) / everything), math.log(training / everything)
    scored = corpus.mapInArrow(_by_slices(_score, vocabulary, send(spark, logs)), "word string, c bigint, log_p double")
    known = counted.select("block", "word").join(scored, "word").select("block", "word", "c", "log_p")
    floor = math.log10(total + SMOOTHING * (kinds + 1)) if total else math.log10(SMOOTHING)
    end_base = math.log10(training + SMOOTHING) - floor

    def read_block(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, sizes = words_of(left["text"].combine_chunks())
        coded = flat.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=right["word"].combine_chunks()).to_numpy(zero_copy_only=False)
        place = found.astype(np.int64)[coded.indices.to_numpy()]
        count = right["c"].to_numpy()[place]
        begins = np.concatenate([[0], np.cumsum(sizes)])

        def per_text(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(sizes), dtype=values.dtype)
            some = sizes > 0
            if some.any():
                out[some] = np.add.reduceat(values, begins[:-1][some])
            return out
        base = per_text(np.log10(count + SMOOTHING) - floor) + end_base
        model = (per_text(right["log_p"].to_numpy()[place]) + end_log) / math.log(10)
        return pa.table({"doc_id": left["doc_id"], "n_tokens": pa.array(sizes + 1, pa.int64()),
                         "n_known": pa.array(per_text((count > 0).astype(np.int64)) + (training > 0), pa.int64()),
                         "train_tokens": pa.array(np.full(len(sizes), total), pa.int64()),
                         "base_score": pa.array(base), "score": pa.array(model)})
    return texts.select("block", "doc_id", "text").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        read_block, f"doc_id {ids}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
