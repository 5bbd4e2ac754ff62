"""Voxel grids: bounds, construction, point-to-cell mapping, inference from centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import finite
from ..functions.joins import lookup_join

AXES = ("x", "y", "z")


def scout_bounds(samples: DataFrame, margin: float = 1.1) -> DataFrame:
    """Per variant: box of the finite positions, widened about its centre; ``status`` tells empty variants."""
    ok = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    ends = samples.groupBy("variant_id").agg(
        F.count_if(ok).alias("n_valid"),
        *[fn(F.when(ok, F.col(a))).alias(f"{n}_{a}") for a in AXES for n, fn in (("lo", F.min), ("hi", F.max))])
    return ends.select(
        "variant_id", "n_valid",
        F.when(F.col("n_valid") > 0, F.lit("ok")).otherwise(F.lit("no valid samples")).alias("status"),
        *[((F.col(f"lo_{a}") + F.col(f"hi_{a}")) * 0.5 - (F.col(f"hi_{a}") - F.col(f"lo_{a}")) * 0.5 * margin)
          .alias(f"bmin_{a}") for a in AXES],
        *[((F.col(f"lo_{a}") + F.col(f"hi_{a}")) * 0.5 + (F.col(f"hi_{a}") - F.col(f"lo_{a}")) * 0.5 * margin)
          .alias(f"bmax_{a}") for a in AXES])


def manual_bounds(variants: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """The given box for every variant."""
    return variants.select(
        "variant_id", F.lit("ok").alias("status"),
        *[F.lit(float(v)).alias(f"bmin_{a}") for a, v in zip(AXES, low)],
        *[F.lit(float(v)).alias(f"bmax_{a}") for a, v in zip(AXES, high)])


def build_grid(bounds: DataFrame, resolution: float | tuple) -> DataFrame:
    """Whole cells per axis covering the box, re-centred on it."""
    res = (resolution,) * 3 if isinstance(resolution, (int, float)) else tuple(resolution)
    df = bounds.filter(F.col("status") == "ok")
    for a, r in zip(AXES, res):
        span = F.round((F.col(f"bmax_{a}") - F.col(f"bmin_{a}")) / F.lit(float(r)), 9)
        df = df.withColumn(f"n{a}", F.greatest(F.lit(1), F.ceil(span).cast("int")))
    for a, r in zip(AXES, res):
        mid = (F.col(f"bmin_{a}") + F.col(f"bmax_{a}")) / 2
        half = F.col(f"n{a}") * F.lit(float(r)) / 2
        df = (df.withColumn("_mid", mid).withColumn(f"bmin_{a}", F.col("_mid") - half)
              .withColumn(f"bmax_{a}", F.col("_mid") + half).drop("_mid"))
    return df.select(
        "variant_id", *[f"bmin_{a}" for a in AXES], *[f"bmax_{a}" for a in AXES],
        *[F.lit(float(r)).alias(f"res_{a}") for a, r in zip(AXES, res)], "nx", "ny", "nz",
        (F.col("nx").cast("bigint") * F.col("ny") * F.col("nz")).alias("n_cells"))


def flat_index(ix: Column, iy: Column, iz: Column) -> Column:
    return ix.cast("bigint") * F.col("ny") * F.col("nz") + iy.cast("bigint") * F.col("nz") + iz


def grid_planes(grids: DataFrame) -> DataFrame:
    """Every grid once for each of its x planes, dealt out by plane."""
    parts = int(grids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (grids.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
            .repartition(parts, "variant_id", "ix"))


def cell_centres() -> list[Column]:
    return [(F.col(f"bmin_{a}") + (F.col(f"i{a}") + 0.5) * F.col(f"res_{a}")).alias(f"c{a}") for a in AXES]


def cell_places() -> dict[str, Column]:
    """ix, iy and iz of ``cell_idx`` in its grid."""
    return {"ix": F.expr("cast(cell_idx div (ny * nz) as int)"), "iy": F.expr("cast(cell_idx div nz % ny as int)"),
            "iz": F.expr("cast(cell_idx % nz as int)")}


def untouched_cells(grids: DataFrame, touched: DataFrame) -> DataFrame:
    """The cells that ``touched`` (variant_id, ix, cell_idx) doesn't list, with the columns of their grid.

    A plane takes the numbers of its touched cells along, so no cell is shuffled.
    """
    taken = touched.groupBy("variant_id", "ix").agg(F.collect_list("cell_idx").alias("_taken"))
    planes, plane = grid_planes(grids).join(taken, ["variant_id", "ix"], "left"), F.col("ny").cast("bigint") * F.col("nz")
    every = F.sequence(F.col("ix") * plane, (F.col("ix") + 1) * plane - 1)
    free = F.array_except(every, F.coalesce("_taken", F.array().cast("array<bigint>")))
    return planes.withColumn("cell_idx", F.explode(free)).drop("_taken").withColumns(cell_places())


def grid_cells(grids: DataFrame) -> DataFrame:
    """Every cell of every grid with its centre, x-major."""
    planes = grid_planes(grids)
    cells = (planes.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
             .withColumn("iz", F.explode(F.sequence(F.lit(0), F.col("nz") - 1))))
    return cells.select(
        "variant_id", flat_index(F.col("ix"), F.col("iy"), F.col("iz")).alias("cell_idx"), "ix", "iy", "iz",
        *cell_centres(), *[f"res_{a}" for a in AXES])


def assign_cells(samples: DataFrame, grids: DataFrame, keep_outside: bool = False) -> DataFrame:
    """Attach ``cell_idx``; points outside the grid are dropped, or kept with null."""
    grid_columns = ["variant_id", *[f"bmin_{a}" for a in AXES], *[f"res_{a}" for a in AXES], "nx", "ny", "nz"]
    joined = lookup_join(samples, grids.select(*grid_columns), ["variant_id"], "left" if keep_outside else "inner")
    ok = F.lit(True)
    for a in AXES:
        joined = joined.withColumn(f"_i{a}", F.floor((F.col(a) - F.col(f"bmin_{a}")) / F.col(f"res_{a}")))
        ok = ok & finite(F.col(a)) & (F.col(f"_i{a}") >= 0) & (F.col(f"_i{a}") < F.col(f"n{a}"))
    out = joined.withColumn("cell_idx", F.when(ok, flat_index(F.col("_ix"), F.col("_iy"), F.col("_iz"))))
    out = out.drop(*[c for c in grid_columns if c != "variant_id"], "_ix", "_iy", "_iz")
    return out if keep_outside else out.filter(F.col("cell_idx").isNotNull())


def infer_grid(cells: DataFrame, decimals: int = 6) -> DataFrame:
    """Bounds, resolution and shape of each variant from its cell centres, with ``status`` instead of an error."""
    counts = cells.groupBy("variant_id").agg(F.count(F.lit(1)).alias("num_cells"))
    points = (cells.select("variant_id", F.explode(F.array(*[
                  F.struct(F.lit(a).alias("axis"), F.round(F.col(f"c{a}"), decimals).alias("v")) for a in AXES
              ])).alias("e")).select("variant_id", "e.axis", "e.v").distinct())
    step = F.col("v") - F.lag("v").over(Window.partitionBy("variant_id", "axis").orderBy("v"))
    axes = (points.withColumn("d", step).groupBy("variant_id").pivot("axis", list(AXES))
            .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                 F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(0.0)).alias("res")))
    out = axes.join(counts, "variant_id")
    full = F.col("x_n") * F.col("y_n") * F.col("z_n") == F.col("num_cells")
    sized = (F.col("x_res") > 0) & (F.col("y_res") > 0) & (F.col("z_res") > 0)
    return out.select(
        "variant_id", "num_cells",
        F.when(~full, F.lit("centres are not a full grid")).when(~sized, F.lit("invalid resolution"))
        .otherwise(F.lit("ok")).alias("status"),
        *[(F.col(f"{a}_lo") - F.col(f"{a}_res") / 2).alias(f"bmin_{a}") for a in AXES],
        *[(F.col(f"{a}_hi") + F.col(f"{a}_res") / 2).alias(f"bmax_{a}") for a in AXES],
        *[F.col(f"{a}_res").alias(f"res_{a}") for a in AXES],
        *[F.col(f"{a}_n").alias(f"n{a}") for a in AXES])


def box_of_centres(cells: DataFrame) -> DataFrame:
    """Axis-aligned box of the cell centres: ends, spans and volume."""
    ends = cells.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[fn(f"c{a}").alias(f"aabb_{n}_{a}") for n, fn in (("min", F.min), ("max", F.max)) for a in AXES])
    for a in AXES:
        ends = ends.withColumn(f"span_{a}", F.col(f"aabb_max_{a}") - F.col(f"aabb_min_{a}"))
    return ends.withColumn("aabb_volume", F.col("span_x") * F.col("span_y") * F.col("span_z"))
