"""Plain projections of the driver tables into the engine's input tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..functions.kernels import sphere_bin
from ..functions.scan import ordered_row_numbers
from ..functions.store import materialize
from ..operators.survey import build_map

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

_stored: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Spread a small table over all cores before costly per-row work; a large scan already has enough tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored_once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived input written once per session and data folder, as the stages of the pipeline hand over files."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = materialize(build(), name)
    return _stored[key]


def variant_of_line() -> Column:
    return F.concat("l_returnflag", "l_linestatus")


def joint_limits(bound: float, dof: int) -> Column:
    one = F.struct(F.lit(-bound).alias("lo"), F.lit(bound).alias("hi"))
    return F.array(*[one] * dof)


#: What samples are derived from.
LINE_COLUMNS = [*LINE_ORDER, "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_samples(spread(table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)))


def line_samples(lineitem: DataFrame) -> DataFrame:
    """Line items as samples: position, joint vector, clearance, singular values and orientation."""
    return _samples(lineitem.withColumn("variant_id", variant_of_line()), LINE_ORDER)


def _samples(lines: DataFrame, keep: list[str]) -> DataFrame:
    a, b, c = F.col("l_partkey") % 7 - 3, F.col("l_suppkey") % 7 - 3, F.col("l_partkey") % 5 - 2
    lines = lines.withColumn("_norm", F.sqrt((a * a + b * b + c * c + 1).cast("double")))
    return lines.select(
        "variant_id", F.col("l_returnflag").alias("family"), *keep,
        F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"),
        F.round(F.col("l_tax") * 100).alias("z"),
        F.array(F.col("l_discount") * 10 - 0.5, F.col("l_tax") * 10 - 0.4).alias("q"),
        ((F.col("l_partkey") % 100 - 10) / 500.0).alias("clearance"),
        F.array(F.col("l_quantity") / 50, F.lit(1.0)).alias("sigmas"),
        (F.col("l_extendedprice") / (F.col("l_extendedprice") + 30000)).alias("g_man"),
        (a / F.col("_norm")).alias("qx"), (b / F.col("_norm")).alias("qy"),
        (c / F.col("_norm")).alias("qz"), (1 / F.col("_norm")).alias("qw"))


def with_indicators(samples: DataFrame) -> DataFrame:
    direction = G.approach_vector(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    return samples.select(
        "*", G.limit_margin(F.col("q"), joint_limits(0.6, 2)).alias("g_lim"),
        G.clearance_score(F.col("clearance")).alias("g_self"),
        G.isotropy(F.col("sigmas")).alias("g_iso"), G.smallest_singular(F.col("sigmas")).alias("g_sigma"),
        sphere_bin(*direction).alias("sphere_bin"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indicators(raw_samples(spark, sf_dir))


def ordered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their position in the variant's stream.

    Only the columns of the line items are ordered and stored, once; readers derive the sample columns that they use.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "ordered-samples")
    if key not in _stored:
        lines = table(spark, sf_dir, "lineitem").select(variant_of_line().alias("variant_id"), *[c for c in LINE_COLUMNS if c != "l_linestatus"])
        numbered = ordered_row_numbers(lines, ["variant_id"], LINE_ORDER, "sample_id", drop=("l_orderkey", "l_linenumber"))
        _stored[key] = with_indicators(_samples(numbered, ["sample_id"]))
    return _stored[key]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished map of the line-item samples."""
    def build():
        raw = raw_samples(spark, sf_dir)
        families = raw.select("variant_id", "family").distinct()
        return build_map(raw, 1.0, score=with_indicators, families=families)
    return stored_once(spark, sf_dir, "cells", build)


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an ordered sample stream per type, one cell per user."""
    def build():
        events = table(spark, sf_dir, "events").select(
            F.col("event_type").alias("variant_id"), F.col("user_id").alias("cell_idx"), "ts", "event_id",
            (F.col("value") / (F.col("value") + 50)).alias("g_man"), (F.col("value") > 20).alias("passed"))
        return ordered_row_numbers(events, ["variant_id"], ["ts", "event_id"], "sample_id").drop("ts", "event_id")
    return stored_once(spark, sf_dir, "ordered-events", build)
