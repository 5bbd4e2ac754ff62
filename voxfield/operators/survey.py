"""The survey: per-cell aggregates of samples and the finished indicator map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import SPHERE_BINS, clip
from ..functions.kernels import squared_distance_pass
from ..functions.joins import lookup_join
from ..functions.store import materialize
from .grid import assign_cells, build_grid, cell_centres, cell_places, scout_bounds, untouched_cells

CELL = ["variant_id", "cell_idx"]


def reachable(in_cell: Column, g_lim: Column, clearance_ok: Column, pose_ok: Column) -> Column:
    """Per-sample reachability: inside a cell, off the joint limits, clear of itself, with a pose."""
    return in_cell & (g_lim > 0) & clearance_ok & pose_ok


def survey_cells(samples: DataFrame, sphere_bin: str | None = "sphere_bin", payload: list[str] | None = None) -> DataFrame:
    """One row per touched cell from samples carrying ``cell_idx`` and the per-sample indicators.

    Every aggregate is a sum, a maximum or a bit mask over fixed-width buffers, so it is combined before the
    shuffle and a hot cell costs no more than any other. ``payload`` adds these columns of the cell's representative
    (``_best``, null where nothing passed), found in the same reading of the samples.
    """
    passed = F.col("g_self") > 0
    best = [best_of(payload, passed)[0].alias("_best")] if payload else []
    rot = [F.bit_or(F.when(passed, F.expr(f"shiftleft(1L, {sphere_bin})"))).alias("rot_mask")] if sphere_bin else []
    return samples.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(passed).alias("passes"),
        F.avg(F.when(passed, F.col("g_self"))).alias("avg_g_self"),
        F.avg(F.when(passed, F.col("g_lim"))).alias("avg_g_lim"),
        *[F.max(F.when(passed, F.col(c))).alias(f"max_{c}") for c in ("g_man", "g_iso", "g_sigma")],
        *rot, *best)


def pass_rate(passes: Column, attempts: Column) -> Column:
    return clip(passes / F.greatest(attempts, F.lit(1)), 0.0, 1.0)


def rotation_coverage(mask: Column, bins: int = SPHERE_BINS) -> Column:
    """Share of direction bins set in a 64-bit mask."""
    return F.coalesce(F.bit_count(mask), F.lit(0)) / F.lit(float(bins))


def log_density(cells: DataFrame, count: str, out: str) -> DataFrame:
    """log1p(count) over the variant's largest log1p(count); left as it is when that is about zero."""
    peaks = cells.groupBy("variant_id").agg(F.max(F.log1p(F.col(count))).alias("_peak"))
    return (lookup_join(cells, peaks, ["variant_id"])
            .withColumn(out, F.when(F.col("_peak") > 1e-6, F.log1p(F.col(count)) / F.col("_peak"))
                        .otherwise(F.log1p(F.col(count))))
            .drop("_peak"))


def redundancy(cells: DataFrame, count: str, out: str) -> DataFrame:
    """log1p(count) / log1p(largest count of the variant), 0 when nothing was counted."""
    peaks = cells.groupBy("variant_id").agg(F.max(count).alias("_peak"))
    score = F.when(F.col("_peak") > 0, clip(F.log1p(F.col(count)) / F.log1p(F.col("_peak")), 0.0, 1.0))
    return (lookup_join(cells, peaks, ["variant_id"]).withColumn(out, F.coalesce(score, F.lit(0.0))).drop("_peak"))


def best_of(payload: list[str], passed: Column, w_man: float = 1.0, w_self: float = 1.0) -> tuple[Column, Column]:
    """The ``payload`` of the passing sample with the largest weighted utility, the earliest of equal ones; the utility."""
    utility = F.lit(w_man) * F.col("g_man") + F.lit(w_self) * F.col("g_self")
    return F.max_by(F.struct(*payload), F.when(passed, F.struct(utility, -F.col("sample_id")))), F.max(F.when(passed, utility))


def representatives(samples: DataFrame, payload: list[str], w_man: float = 1.0, w_self: float = 1.0) -> DataFrame:
    """Per cell the passing sample with the largest weighted utility; the earliest sample wins a tie."""
    best, utility = best_of(payload, F.col("g_self") > 0, w_man, w_self)
    return (samples.filter(F.col("g_self") > 0).groupBy(*CELL)
            .agg(best.alias("_b"), utility.alias("utility")).select(*CELL, "utility", "_b.*"))


def along_lines(field: DataFrame, axis: str, value: str, work, keep: list[str]) -> DataFrame:
    """Replace ``value`` along every grid line of ``axis`` by ``work(line)``.

    Rows carry variant_id, ix, iy, iz; lines are grouped by the other two indices, so a task holds single lines,
    whose length is a side of the grid. ``keep`` names per-variant columns passed through.
    """
    others = [f"i{o}" for o in ("x", "y", "z") if o != axis]
    line = F.array_sort(F.collect_list(F.struct(F.col(f"i{axis}").alias("i"), F.col(value).alias("v"))))
    lines = field.groupBy("variant_id", *others).agg(line.alias("_line"), *[F.first(c).alias(c) for c in keep])
    lines = lines.select("variant_id", *others, *keep, F.transform("_line", lambda s: s["i"]).alias("_i"),
                         work(F.transform("_line", lambda s: s["v"])).alias("_v"))
    return (lines.select("variant_id", *others, *keep, F.explode_outer(F.arrays_zip("_i", "_v")).alias("_c"))
            .select("variant_id", *others, F.col("_c._i").alias(f"i{axis}"), *keep, F.col("_c._v").alias(value)))


def boundary_distance(cells: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """Exact distance of every valid cell to the nearest invalid cell of its grid, over the map's maximum.

    ``cells`` is dense (ix, iy, iz, res_*, valid). Three passes, each grouped by grid lines, whose length is a side
    of the grid. A map without invalid cells gets 0.

    With ``sides`` (variant_id, nx, ny, nz, res_*, copies), a stored table with a row for each grid, ``cells`` may be the
    valid ones only (variant_id, ix, iy, iz, valid): what the grid has besides is invalid, lies at 0 and need not
    travel. Every cell then stands for ``copies`` equal rows.
    """
    keep = ["res_x", "res_y", "res_z"]
    if sides is not None:
        cells = lookup_join(cells, sides, ["variant_id"], stored=True).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        keep = [*keep, "nx", "ny", "nz", "copies"]
    field = cells.select("variant_id", "ix", "iy", "iz", *keep,
                         F.when(F.col("valid"), F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("d2"))
    for axis in ("z", "y", "x"):
        places = () if sides is None else (F.transform("_line", lambda s: s["i"]), F.col(f"n{axis}"), F.col("copies"))
        field = along_lines(field, axis, "d2", lambda line: squared_distance_pass(line, F.col(f"res_{axis}"), *places), keep)
    distance = F.when(F.col("d2") < float("inf"), F.sqrt("d2")).otherwise(F.lit(0.0))
    field = materialize(field.select("variant_id", "ix", "iy", "iz", distance.alias("distance")), "boundary")
    peaks = field.groupBy("variant_id").agg(F.max("distance").alias("_peak"))
    return (lookup_join(field, peaks, ["variant_id"])
            .withColumn("g_margin", F.when(F.col("_peak") > 1e-6, F.col("distance") / F.col("_peak"))
                        .otherwise(F.col("distance"))).drop("_peak"))


def build_map(samples: DataFrame, resolution: float | tuple, margin: float = 1.1, grids: DataFrame | None = None,
              score: Callable[[DataFrame], DataFrame] | None = None, families: DataFrame | None = None) -> DataFrame:
    """Samples to the dense indicator map, one row per cell of every grid.

    ``samples``: variant_id, x, y, z, g_self, g_lim, g_man, g_iso, g_sigma, sphere_bin; ``score`` adds indicators that
    are not there yet, after points outside the grid are gone. Samples that ``assign_cells`` has placed keep their
    ``cell_idx``. With the columns sample_id and q the map has ``q_star``, the joint vector of each cell's representative
    (null where nothing passed); ``families`` (variant_id, family) adds the family, one row of a cell for each of several.

    The samples are read once, and only touched cells are written, joined and measured. All others are zero and are laid
    out from the grids when the map is read.
    """
    if grids is None:
        grids = materialize(build_grid(scout_bounds(samples, margin), resolution), "grids")
    placed = samples if "cell_idx" in samples.columns else assign_cells(samples, grids)
    placed = score(placed) if score else placed
    has_q = {"sample_id", "q"} <= set(samples.columns)
    boxes = materialize(_boxes(grids, families), "boxes")
    sides = boxes if families is None else materialize(boxes.join(families.select("variant_id", "family"), "variant_id", "left"), "sides")
    touched = lookup_join(survey_cells(placed, payload=["q"] if has_q else None), boxes.select("variant_id", "ny", "nz"), ["variant_id"])
    touched = touched.withColumns(cell_places()).drop("ny", "nz")
    touched = materialize(touched.withColumn("q_star", F.col("_best.q")).drop("_best") if has_q else touched, "touched")
    valid = touched.filter("passes > 0").select("variant_id", "ix", "iy", "iz", F.lit(True).alias("valid"))
    edge = boundary_distance(valid, boxes).groupBy("variant_id", "ix", "iy", "iz").agg(F.collect_list("g_margin").alias("_margins"))
    cells = log_density(touched, "passes", "_red").join(edge, ["variant_id", "ix", "iy", "iz"], "left")
    cells = lookup_join(cells, sides, ["variant_id"], stored=True)
    margins = F.coalesce(F.col("_margins"), F.array_repeat(F.lit(0.0), F.col("copies")))
    cells = cells.withColumn("g_margin", F.explode(F.flatten(F.array_repeat(margins, F.col("grids")))))
    rest = sides.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("grids") * F.col("copies")))).drop("_c")
    dense = cells.unionByName(untouched_cells(rest, touched), allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return dense.select(
        "variant_id", "ix", "iy", "iz", "cell_idx", *cell_centres(), "res_x", "res_y", "res_z",
        F.when(F.col("passes") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("g_ws"),
        zero("_red").alias("g_red"),
        zero("avg_g_self").alias("g_self"),
        F.coalesce(pass_rate(F.col("passes"), F.col("attempts")), F.lit(0.0)).alias("g_selfpass"),
        zero("avg_g_lim").alias("g_lim"),
        rotation_coverage(F.col("rot_mask")).alias("g_rot"),
        *[zero(f"max_{c}").alias(c) for c in ("g_man", "g_iso", "g_sigma")],
        F.coalesce(F.col("attempts"), F.lit(0)).alias("attempts"),
        F.coalesce(F.col("passes"), F.lit(0)).alias("sample_counts"),
        *(["q_star"] if has_q else []), *(["family"] if families is not None else []),
        zero("g_margin").alias("g_margin"))


def _boxes(grids: DataFrame, families: DataFrame | None) -> DataFrame:
    """The grid of every variant once; ``grids`` and ``copies``: how often it is listed, and how many rows a cell gets by that
    and by several families."""
    rows = grids.filter("variant_id is not null").groupBy("variant_id").agg(
        *[F.first(c).alias(c) for c in grids.columns if c != "variant_id"], F.count(F.lit(1)).cast("int").alias("grids"))
    if families is None:
        return rows.withColumn("copies", F.col("grids"))
    counted = families.groupBy("variant_id").agg(F.count(F.lit(1)).cast("int").alias("_families"))
    return rows.join(counted, "variant_id", "left").withColumn(
        "copies", F.col("grids") * F.coalesce("_families", F.lit(1))).drop("_families")
