"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased words without ASCII punctuation, joined by single spaces. A test item of m characters
has a budget of k = ``rate`` * m edits. It is cut into k + 1 pieces; a passage within k edits holds at least one piece
unchanged, so an automaton over all pieces finds every candidate in one pass over the text. Around each hit the whole
item is verified with Myers' bit-parallel edit distance (all rows of the dynamic programme in one long integer).

The items are the query set: they are read in blocks of bounded size and sent to the tasks, and the documents are read
once for each block. Nothing is collected but a block of items.

Defined results: a null or empty text holds no item; an item without words matches nothing; repeated items and repeated
documents give a row each; an item of fewer than 1 / ``rate`` characters must occur unchanged; extra columns are ignored
by ``matches`` and passed through by ``keep_clean``.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import plain_words, received, send, slices

ERROR_RATE = 0.06
#: Characters of test items that one pass over the documents looks for.
BLOCK_CHARS = 8_000_000


def plain(text: str | None) -> str:
    return b" ".join(plain_words(text)).decode("utf-8", "replace")


def budget(length: int, rate: float) -> int:
    return int(rate * length)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``errors + 1`` pieces of nearly equal length."""
    cuts = [k * len(item) // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """One item for Myers' algorithm; the best match of it anywhere in a text."""

    def __init__(self, item: str):
        self.size = len(item)
        self.equal: dict[str, int] = defaultdict(int)
        for k, c in enumerate(item):
            self.equal[c] |= 1 << k
        self.equal = dict(self.equal)

    def best(self, text: str, start: int, stop: int, most: int) -> tuple[int, int] | None:
        """(distance, end) of the closest substring of text[start:stop], the first end of several; None over ``most``."""
        mask, last = (1 << self.size) - 1, 1 << self.size - 1
        plus, minus, score = mask, 0, self.size
        found, equal = (most + 1, -1), self.equal
        for place in range(start, stop):
            match = equal.get(text[place], 0)
            vertical = match | minus
            across = (((match & plus) + plus) ^ plus) | match
            h_plus = (minus | ~(across | plus)) & mask
            h_minus = plus & across
            if h_plus & last:
                score += 1
            elif h_minus & last:
                score -= 1
            h_plus = h_plus << 1 & mask  # row 0 is free: the match may begin anywhere
            h_minus = h_minus << 1 & mask
            plus = (h_minus | ~(vertical | h_plus)) & mask
            minus = h_plus & vertical
            if score < found[0]:
                found = score, place + 1
        return found if found[0] <= most else None


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.texts = [(key, text) for key, text in ((key, plain(raw)) for key, raw in items) if text]
        self.automaton = ahocorasick.Automaton()
        holders: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text) in enumerate(self.texts):
            for offset, piece in pieces(text, budget(len(text), rate)):
                holders[piece].append((number, offset))
        for piece, held in holders.items():
            self.automaton.add_word(piece, (len(piece), held))
        self.automaton.make_automaton()
        self.rate = rate
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}

    def find(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item key, distance, start, end, budget) of the closest match of each item found."""
        if not self.texts or not text:
            return []
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for end, (size, held) in self.automaton.iter(text):
            for number, offset in held:
                length = len(self.texts[number][1])
                slack = budget(length, self.rate)
                begin = end + 1 - size - offset
                low, high = max(0, begin - slack), min(len(text), begin + length + slack)
                own = windows[number]
                if own and low <= own[-1][1] and low >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        out = []
        for number, places in windows.items():
            key, item = self.texts[number]
            most, best = budget(len(item), self.rate), None
            if number not in self.patterns:
                self.patterns[number] = Pattern(item), Pattern(item[::-1])
            forward, backward = self.patterns[number]
            for low, high in sorted(map(tuple, places)):
                got = forward.best(text, low, high, most if best is None else best[0] - 1)
                if got is not None:
                    best = got
                if best is not None and best[0] == 0:
                    break
            if best is not None:
                distance, end = best
                reach = text[max(0, end - len(item) - distance):end][::-1]
                start = end - backward.best(reach, 0, len(reach), distance)[1]
                out.append((key, distance, start, end, most))
        return out


def _blocks(benchmark: DataFrame, block_chars: int):
    """The items in lists of bounded size."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_chars))
    for k in range(count):
        part = benchmark.select("item_id", "text").filter("text is not null")
        if count > 1:
            part = part.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (str(x[0]), x[1]))


def _with_matcher(df: DataFrame, fn, schema, block: list, rate: float) -> DataFrame:
    """``fn(batch, matcher)`` over all batches; every task builds the automaton of the block that was sent."""
    sent = send(df.sparkSession, block)

    def run(batches):
        matcher = Matcher(received(sent), rate)
        for part in slices(batches):
            yield fn(part, matcher)
    return df.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE,
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, allowed, start, stop): each item found in a document, at its closest match.

    ``start`` and ``stop`` count characters of the plain text.
    """
    ids, items = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {ids}, item_id {items}, distance int, allowed int, start int, stop int"
    found = None
    for block in _blocks(benchmark, block_chars):
        def run(batch: pa.RecordBatch, matcher: Matcher) -> pa.RecordBatch:
            rows, of = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                got = matcher.find(plain(text))
                rows += got
                of += [k] * len(got)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array([r[0] for r in rows], _arrow(items)),
                 *(pa.array(v, pa.int32()) for v in ([r[1] for r in rows], [r[4] for r in rows],
                                                     [r[2] for r in rows], [r[3] for r in rows]))],
                names=["doc_id", "item_id", "distance", "allowed", "start", "stop"])
        part = _with_matcher(docs.select("doc_id", "text"), run, schema, block, rate)
        found = part if found is None else found.unionByName(part)
    return found


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark, block_chars):
        def run(batch: pa.RecordBatch, matcher: Matcher) -> pa.RecordBatch:
            return batch.filter(pa.array([not matcher.find(plain(t)) for t in batch.column(at).to_pylist()], pa.bool_()))
        docs = _with_matcher(docs, run, docs.schema, block, rate)
    return docs
