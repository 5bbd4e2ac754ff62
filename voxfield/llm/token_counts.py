"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

The leaves of a document's tree are segments of about ``SEGMENT`` chunks. A segment begins at a space that stands alone
between two other characters; a pre-token begins there whatever else the text holds, so segments are encoded apart
from each other and their counts add up to the count of the whole text. ``build`` keeps each tree as two short arrays
(characters and tokens of the leaves), ``recount`` applies edits: it walks down to the touched leaves, encodes only from
the last sound boundary before the edit to the next old boundary that is still sound after it, and updates the sums on
the path. When a leaf has grown to several segments it is cut again.

Edits are rows (doc_id, seq, start, stop, replacement): the characters [start, stop) of the text as it is when the edit's
turn comes, in the order of ``seq``.

Defined results: a null or empty text has no tokens; places outside the text are moved to its ends and a stop before
its start counts as the start; a null replacement is empty; edits of unknown documents are ignored; rows that repeat an
id all get its edits; equal edits with one ``seq`` are applied once; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.store import materialize
from .common import among, slices_of
from .tokens import Encoder, encoder

SEGMENT = 64
_boundary = re.compile(r"(?<=\S) (?=\S)")
_edit = "array<struct<seq: bigint, start: bigint, stop: bigint, replacement: string>>"


def segments(text: str, size: int = SEGMENT) -> list[int]:
    """Where the segments of a text begin (0 first); none for an empty text."""
    if not text:
        return []
    return [0, *(m.start() for k, m in enumerate(_boundary.finditer(text), 1) if k % size == 0)]


def sound(text: str, place: int) -> bool:
    """Whether a pre-token begins at ``place`` whatever else the text holds."""
    return place in (0, len(text)) or (0 < place < len(text) - 1 and text[place] == " "
                                       and not text[place - 1].isspace() and not text[place + 1].isspace())


class SumTree:
    """Sums of (characters, tokens) over the leaves; the leaves of one document stay in order."""

    def __init__(self, characters: list[int], tokens: list[int]):
        self.width = 1
        while self.width < max(1, len(characters)):
            self.width *= 2
        self.leaves = len(characters)
        self.sums = [[0] * (2 * self.width) for _ in range(2)]
        for sums, values in zip(self.sums, (characters, tokens)):
            sums[self.width:self.width + len(values)] = values
            for node in range(self.width - 1, 0, -1):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, first character) of the leaf that holds a character; the last leaf for the end of the text."""
        node, before, characters = 1, 0, self.sums[0]
        while node < self.width:
            node *= 2
            if place >= before + characters[node] and self._any(node + 1):
                before += characters[node]
                node += 1
        return node - self.width, before

    def _any(self, node: int) -> bool:
        """Whether a node has real leaves below it."""
        while node < self.width:
            node *= 2
        return node - self.width < self.leaves

    def leaf(self, k: int) -> tuple[int, int]:
        return self.sums[0][self.width + k], self.sums[1][self.width + k]

    def put(self, k: int, characters: int, tokens: int) -> None:
        """Change one leaf and the sums above it."""
        node = self.width + k
        change = characters - self.sums[0][node], tokens - self.sums[1][node]
        while node:
            self.sums[0][node] += change[0]
            self.sums[1][node] += change[1]
            node //= 2

    def values(self) -> tuple[list[int], list[int]]:
        return tuple(s[self.width:self.width + self.leaves] for s in self.sums)

    @property
    def tokens(self) -> int:
        return self.sums[1][1]


class Document:
    """A text with its tree."""

    def __init__(self, text: str, characters: list[int], tokens: list[int]):
        self.text, self.tree, self.encoded = text, SumTree(characters, tokens), 0

    def edit(self, start: int, stop: int, replacement: str, coder: Encoder) -> None:
        """Replace text[start:stop] and encode again what that touches."""
        start = min(max(0, start), len(self.text))
        stop = min(max(start, stop), len(self.text))
        old_size = len(self.text)
        self.text = text = self.text[:start] + replacement + self.text[stop:]
        change = len(replacement) - (stop - start)
        if not self.tree.leaves:
            self.tree = SumTree([0], [0])
        first, low = self.tree.find(start)
        while first and (start < low + 2 or not sound(text, low)):  # the characters beside a boundary decide on it
            first -= 1
            low -= self.tree.leaf(first)[0]
        last, high = self.tree.find(max(start, stop - 1)) if old_size else (0, 0)
        high += self.tree.leaf(last)[0]
        while high < old_size and (high < stop or not sound(text, high + change)):
            last += 1
            high += self.tree.leaf(last)[0]
        region = text[low:high + change]
        cuts = [low + s for s in segments(region)] + [low + len(region)]
        counts = count_each([text[a:b] for a, b in zip(cuts, cuts[1:])], coder)
        self.encoded += sum(counts)
        sizes = [b - a for a, b in zip(cuts, cuts[1:])]
        touched = last - first + 1
        if len(sizes) <= touched:
            for k in range(touched):
                self.tree.put(first + k, *((sizes[k], counts[k]) if k < len(sizes) else (0, 0)))
        else:  # more segments than leaves: the tree is laid out again, nothing else is encoded
            characters, tokens = self.tree.values()
            self.tree = SumTree(characters[:first] + sizes + characters[last + 1:],
                                tokens[:first] + counts + tokens[last + 1:])


def count_each(texts: list[str], coder: Encoder) -> list[int]:
    """Tokens of each text."""
    return coder.counts(texts)


def leaves(texts: list[str | None], coder: Encoder) -> list[tuple[list[int], list[int]]]:
    """(characters, tokens) of the leaves of each text. A leaf begins with its space, which the first one lacks."""
    cuts = [segments(t or "") for t in texts]
    flat = [t[a:b] for t, own in zip(texts, cuts) for a, b in zip(own, [*own[1:], len(t or "")])]
    counted = count_each(flat, coder)
    out, at = [], 0
    for own in cuts:
        n = len(own)
        out.append(([len(x) for x in flat[at:at + n]], counted[at:at + n]))
        at += n
    return out


def build(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, row, n_tokens, leaf_chars, leaf_tokens): the tree of every document; ``row`` is a hash of its text."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices_of(batch, 2):
                trees = leaves(part.column(2).to_pylist(), coder)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([sum(t) for _, t in trees], pa.int64()),
                     pa.array([c for c, _ in trees], pa.list_(pa.int32())),
                     pa.array([t for _, t in trees], pa.list_(pa.int32()))],
                    names=["doc_id", "row", "n_tokens", "leaf_chars", "leaf_tokens"])
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(
        run, f"doc_id {ids}, row bigint, n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>")


def recount(docs: DataFrame, edits: DataFrame, vocabulary: str | None = None, trees: DataFrame | None = None,
            texts: bool = True) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_encoded, text): every document after its edits.

    ``trees`` is a stored table that ``build`` made of ``docs``. Only documents with edits are read again: they meet their
    tree and their edits (in one array, ordered by ``seq``), and what the edits touch is encoded; ``n_encoded`` counts
    those tokens. All other documents keep their stored count. Without ``texts`` there is no ``text`` in the result.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    trees = materialize(build(docs, vocabulary), "token-trees") if trees is None else trees
    one = F.struct(*(F.col(c).cast("bigint").alias(c) for c in ("seq", "start", "stop")), F.col("replacement"))
    lists = edits.filter("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(one)).cast(_edit).alias("_edits"))
    lists = materialize(lists, "edits")
    edited = among(docs.select("doc_id", "text"), "doc_id", lists).withColumn("row", F.xxhash64("text")).join(lists, "doc_id")
    joined = edited.join(among(trees, "doc_id", lists).dropDuplicates(["doc_id", "row"]), ["doc_id", "row"]).select(
        "doc_id", "text", "_edits", "leaf_chars", "leaf_tokens")

    def run(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices_of(batch, 1):
                rows = []
                for text, own, characters, tokens in zip(*(part.column(k).to_pylist() for k in range(1, 5))):
                    document = Document(text or "", characters, tokens)
                    for e in own:
                        document.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "", coder)
                    rows.append((sum(tokens), len(own), document.tree.tokens, document.encoded, document.text))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                    names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded", "text"])
    changed = joined.mapInArrow(
        run, f"doc_id {ids}, n_tokens bigint, n_edits int, n_tokens_after bigint, n_encoded bigint, text string")
    counted = trees.select("doc_id", "row", "n_tokens").join(lists.select("doc_id"), "doc_id", "left_anti")
    if texts:
        others = docs.select("doc_id", "text").join(lists.select("doc_id"), "doc_id", "left_anti").select(
            F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row"), "text")
        counted = others.join(counted.dropDuplicates(["doc_id", "row"]), F.col("_id").eqNullSafe(F.col("doc_id"))
                              & (F.col("_row") == F.col("row"))).select("doc_id", "n_tokens", "text")
    else:
        changed = changed.drop("text")
    same = counted.select("doc_id", "n_tokens", F.lit(0).alias("n_edits"), F.col("n_tokens").alias("n_tokens_after"),
                          F.lit(0).cast("bigint").alias("n_encoded"), *(["text"] if texts else []))
    return changed.unionByName(same)


def line_edits(text: str | None) -> list[tuple[int, int]]:
    """[start, stop) of every line that repeats an earlier one with its line break, last first."""
    seen, at, out = set(), 0, []
    for line in (text or "").split("\n"):
        if line.strip() and line in seen:
            out.append((at - 1, at + len(line)))
        seen.add(line)
        at += len(line) + 1
    return out[::-1]


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Edits that take every repeated line out of the documents."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices_of(batch, 1):
                rows = [(k, n, a, b) for k, text in enumerate(part.column(1).to_pylist())
                        for n, (a, b) in enumerate(line_edits(text))]
                columns = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(columns[0], pa.int64())),
                     *(pa.array(c, pa.int64()) for c in columns[1:]), pa.nulls(len(rows), pa.string())],
                    names=["doc_id", "seq", "start", "stop", "replacement"])
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {ids}, seq bigint, start bigint, stop bigint, replacement string")
