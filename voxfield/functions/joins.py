"""Joins against per-key side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .store import materialize


def lookup_join(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", stored: bool = False) -> DataFrame:
    """Attach a per-key side table to a large table (inner, left, left_semi or left_anti).

    The side is written first, unless it is ``stored`` already, so that it runs once and Spark knows its bytes: it is
    broadcast below ``spark.sql.autoBroadcastJoinThreshold`` and joined by sort and merge above, where adaptive
    execution splits hot keys.
    """
    return big.join(side if stored else materialize(side, "side"), on, how)
