"""Ordered prefix operations (row numbers, running sums and maxima) without one task per group.

Rows of a group are cut into blocks that follow the order. Per-block totals are small and are scanned per group;
the rows are scanned inside their block only, so a group holding a third of all rows still spreads over all blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import lookup_join
from .store import materialize

BLOCK = "_block"
PLACE_BITS = 33  # bits of a row's place inside its partition in Spark's monotonic ids
BLOCK_ROWS = 1_000_000


def _before(block_totals: DataFrame, keys: list[str], value: Column, fn, alias: str) -> DataFrame:
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return block_totals.withColumn(alias, fn(value).over(earlier))


def row_numbers(df: DataFrame, keys: list[str], order: list, out: str, block: Column | None = None) -> DataFrame:
    """1-based position of every row in its group; ``df`` carries ``_block`` or ``block`` computes it."""
    rows = df if block is None else df.withColumn(BLOCK, block)
    totals = rows.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(totals, keys, F.col("_n"), F.sum, "_offset").drop("_n")
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    return (rows.join(offsets, [*keys, BLOCK])
            .withColumn(out, F.row_number().over(inside) + F.coalesce("_offset", F.lit(0)))
            .drop(BLOCK, "_offset"))


def ordered_row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Row numbers for any sortable order with one shuffle: range-partition, sort, number inside the partition.

    The rows are stored with their place before it is used, as a recomputed range partitioning may choose other
    limits. What remains is a small table: where each group starts in each partition and how many rows came before. The
    columns of ``drop`` are only for the order and aren't stored.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = materialize(placed.withColumn("_place", F.monotonically_increasing_id()).drop(*drop), "ordered")
    rows = rows.withColumn(BLOCK, F.shiftright("_place", PLACE_BITS))
    totals = rows.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start"))
    starts = materialize(_before(totals, keys, F.col("_n"), F.sum, "_offset").drop("_n"), "starts")
    number = F.col("_place") - F.col("_start") + 1 + F.coalesce("_offset", F.lit(0))
    return lookup_join(rows, starts, [*keys, BLOCK]).withColumn(out, number).drop(BLOCK, "_place", "_start", "_offset")


def running(df: DataFrame, keys: list[str], order: str, value: str, fn, out: str,
            include_current: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running ``fn`` (sum, max, min) of ``value`` by an integer order column.

    Blocks span ``block_rows`` order numbers, so a window never holds more rows than that when the order is unique.
    """
    combine = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: F.greatest, F.min: F.least}[fn]
    rows = df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(block_rows)))
    totals = rows.groupBy(*keys, BLOCK).agg(fn(value).alias("_total"))
    offsets = _before(totals, keys, F.col("_total"), fn, "_earlier").drop("_total")
    inside = (Window.partitionBy(*keys, BLOCK).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1))
    return (rows.join(offsets, [*keys, BLOCK])
            .withColumn(out, combine(F.col("_earlier"), fn(value).over(inside)))
            .drop(BLOCK, "_earlier"))


def moving_average(df: DataFrame, keys: list[str], position: str, value: str, window: int, out: str,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trailing mean over ``window`` rows by a dense 1-based position; short at the head.

    Each block also receives the last ``window - 1`` rows of the block before it, which are dropped afterwards.
    """
    span = max(block_rows, window)
    home = F.floor((F.col(position) - 1) / F.lit(span))
    reach = F.floor((F.col(position) + F.lit(window - 2)) / F.lit(span))
    rows = (df.withColumn("_home", home)
            .withColumn(BLOCK, F.explode(F.sequence(F.col("_home"), reach))))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(position).rowsBetween(-(window - 1), 0)
    return (rows.withColumn(out, F.avg(value).over(inside))
            .filter(F.col("_home") == F.col(BLOCK)).drop("_home", BLOCK))
