"""Helpers shared by the text operators: input tables, Arrow batches, stable hashes and bounded samples."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.store import materialize

SLICE_ROWS = 256
SLICE_BYTES = 32 << 20
#: Every ASCII byte that is neither a letter nor a digit becomes a space.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8, without ASCII punctuation; none for a null text."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split() if text else []


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by rows and by bytes, so that the Python objects of few texts exist at a time."""
    for batch in batches:
        texts = [k for k, kind in enumerate(batch.schema.types) if pa.types.is_string(kind) or pa.types.is_binary(kind)]
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if part.nbytes > most_bytes and texts:
                widest = max(texts, key=lambda k: part.column(k).nbytes)
                yield from slices_of(part, widest, most_bytes)
            else:
                yield part


def slices_of(batch: pa.RecordBatch, column: int, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch where its texts reach ``most_bytes``; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and total + size > most_bytes:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def send(spark: SparkSession, value: object):
    """Broadcast a model of bounded size. Its classes travel with it, so executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent) -> object:
    return pickle.loads(sent.value)


def worker_cache() -> dict:
    """A dict that lives as long as the Python process; functions that travel by value have module globals of their
    own in every task."""
    return sys.__dict__.setdefault("_voxfield_llm", {})


def map_batches(df: DataFrame, fn: Callable[..., pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS,
                sent=None) -> DataFrame:
    """Apply ``fn`` to slices of Arrow batches within each task, with what was sent as second argument."""
    def run(batches):
        more = () if sent is None else (received(sent),)
        for part in slices(batches, rows):
            out = fn(part, *more)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


#: Bits of the filter of ``among``: 64 of each cell.
MOST_CELLS = 1 << 20


def among(df: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """``df`` without most rows whose key isn't in ``others`` (a stored table), before anything is shuffled.

    Keys set bits in a table of at most ``MOST_CELLS`` * 64 bits (8 MB), which a scalar subquery carries into the scan. The
    join that follows decides; with more keys than bits this leaves all rows and costs a lookup.
    """
    cells = 1 << min(MOST_CELLS.bit_length() - 1, max(4, (others.count() // 4).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(64 * cells))
    bits = others.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    filled = others.sparkSession.range(cells).join(bits, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b")).alias("c"))
    table = filled.agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["b"]).alias("bits"))
    cell = F.get(F.col("_bits"), F.shiftright(place, 6).cast("int"))
    hit = F.getbit(cell, place.bitwiseAND(F.lit(63)).cast("int")) == 1
    return df.withColumn("_bits", materialize(table, "key-bits").scalar()).filter(hit).drop("_bits")


def bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def uniform(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the row's values only."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def sample_by_chars(df: DataFrame, groups: str, text: str, key: str, most_chars: int, seed: int = 0) -> DataFrame:
    """A sample of about ``most_chars`` characters from each value of ``groups``.

    Small groups are taken whole. Rows are chosen by a hash of ``key``, so the sample doesn't depend on partitions.
    """
    sizes = df.groupBy(groups).agg(F.sum(F.length(text)).alias("n")).collect()
    rate = F.lit(0.0)
    for row in sizes:
        if row[groups] is not None and row["n"]:
            rate = F.when(F.col(groups) == row[groups], F.lit(min(1.0, most_chars / row["n"]))).otherwise(rate)
    return df.filter(uniform(key, seed=seed) < rate)
