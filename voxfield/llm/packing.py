"""Best-fit packing of token pieces into sequences of fixed length.

Best-fit decreasing over all pieces of the table: a piece goes to the open sequence with the least room that still
takes it, found in a segment tree over remaining capacities. Pieces of one length are alike, so the tree works on counts
of pieces by length and of sequences by remaining capacity: its input is a histogram of at most ``capacity`` rows
however many documents there are, and its answer is a short list of moves, each a run of pieces of one length that go
``each`` to a sequence into a run of consecutive sequence numbers. Placing every single piece is then arithmetic on its
rank among the pieces of its length, done in parallel.

Defined results: a null or empty text is one piece of the end id alone; documents longer than the capacity are cut into
pieces of the capacity, the first of which takes the remainder; rows with equal ids are packed one by one; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.store import materialize
from .common import slices_of
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
#: Bytes of text encoded at a time.
BATCH_BYTES = 12 << 20
#: Rows of one block in which pieces are numbered.
BLOCK_ROWS = 50_000


class CapacityTree:
    """Segment tree over remaining capacities 0 to ``capacity``; each leaf holds runs of sequence numbers."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if count:
            self.runs.setdefault(room, []).append((first, count))
            self._change(room, count)

    def _change(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` that any sequence has."""
        node = need + self.width
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Take up to ``most`` sequences of one run away from ``room``: (first number, count)."""
        first, count = self.runs[room].pop()
        if count > most:
            self.runs[room].append((first + most, count - most))
            count = most
        self._change(room, -count)
        return first, count


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, first sequence, pieces in a sequence, offset) of best-fit decreasing.

    A move holds for the ranks up to the next move of that length: rank r of it lies in sequence
    first + (r - first rank) // each, at offset + (r - first rank) % each * length.
    """
    tree, moves, opened = CapacityTree(capacity), [], 0
    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = opened, -(-left // each)
                opened += count
            else:
                each = room // length
                first, count = tree.take(room, -(-left // each))
            placed = min(left, count * each)
            moves.append((length, rank, first, each, capacity - room))
            full, rest = divmod(placed, each)
            tree.add(room - each * length, first, full)
            if rest:
                tree.add(room - rest * length, first + full, 1)
            rank, left = rank + placed, left - placed
    return moves


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first one takes the remainder."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, ended by ``end_id``."""
    ids_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices_of(batch, 1, BATCH_BYTES):
                flat, bounds = coder.encode(part.column(1))
                raw, at = memoryview(flat.astype("<u4").tobytes()), (4 * bounds).tolist()
                row, piece, start, length, crc = [], [], [], [], []
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    cuts = cut((b - a) // 4 + 1, capacity)
                    for n, (s, size) in enumerate(cuts):
                        stop = a + 4 * (s + size)
                        value = zlib.crc32(raw[a + 4 * s:min(b, stop)])
                        row.append(k)
                        piece.append(n)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(end, value) if stop > b else value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(v, pa.int64()) for v in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {ids_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(parts: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add sequence_id and offset to stored pieces; ``length`` must lie in 1 to ``capacity``."""
    spark = parts.sparkSession
    sizes = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in sizes}
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    blocks = max(1, -(-sum(histogram.values()) // block_rows))
    # pieces of a length are numbered within blocks, then the blocks of a length one after the other
    marked = parts.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    of_block = marked.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    begins = of_block.select("length", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = marked.withColumn("_rank", place - 1).join(begins, ["length", "_block"]).withColumn(
        "_rank", F.col("_rank") + F.col("_before"))
    by_length: dict[int, list] = {}
    for length, rank, first, each, offset in plan(histogram, capacity):
        by_length.setdefault(length, []).append((rank, first, each, offset))
    sent = spark.sparkContext.broadcast(by_length)
    names = [f.name for f in parts.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)

    def run(batches):
        moves = sent.value
        starts = {n: [m[0] for m in own] for n, own in moves.items()}
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column(names.index("length")).to_pylist(), batch.column(len(names)).to_pylist()):
                low, first, each, at = moves[length][bisect_right(starts[length], rank) - 1]
                by, within = divmod(rank - low, each)
                sequence.append(first + by)
                offset.append(at + within * length)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*names, "sequence_id", "offset"])
    return ranked.select(*names, "_rank").mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Cut, number and pack all documents."""
    return pack(materialize(pieces(docs, capacity, vocabulary), "pieces"), capacity)
