"""Grid, survey and convergence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G, kernels as K
from ..functions.store import materialize
from ..operators import convergence as C, grid as V, survey as S
from ..schemas import LABELS
from . import bindings as B, sql as Q
from .pipelines import rounds
from .registry import query, r6, rounded

BOUND_COLUMNS = [f"{n}_{a}" for n in ("bmin", "bmax") for a in V.AXES]


def grids(spark, sf_dir):
    return B.stored_once(spark, sf_dir, "grids",
                         lambda: V.build_grid(V.scout_bounds(B.raw_samples(spark, sf_dir)), 1.0))


@query("c3_scouting_bounds", Q.with_(",".join([Q.SAMPLES, Q.BOUNDS]), f"""
SELECT variant_id, n_valid, 'ok' AS status, {', '.join(Q.r6(f'b0_{a}', f'bmin_{a}') for a in 'xyz')},
  {', '.join(Q.r6(f'b1_{a}', f'bmax_{a}') for a in 'xyz')} FROM bounds"""))
def scouting_bounds(spark, sf_dir):
    return rounded(V.scout_bounds(B.raw_samples(spark, sf_dir)), *BOUND_COLUMNS)


@query("c4_grid", Q.with_(Q.TO_GRIDS, f"""
SELECT variant_id, nx, ny, nz, n_cells, 1.0::DOUBLE AS res_x, 1.0::DOUBLE AS res_y, 1.0::DOUBLE AS res_z,
  {', '.join(Q.r6(c) for c in BOUND_COLUMNS)} FROM grids"""))
def grid(spark, sf_dir):
    out = V.build_grid(V.scout_bounds(B.raw_samples(spark, sf_dir)), 1.0)
    return rounded(out, *BOUND_COLUMNS).withColumns({c: F.col(c).cast("bigint") for c in ("nx", "ny", "nz")})


@query("c4_manual_bounds", Q.with_(Q.SAMPLES, """
SELECT *, nx * ny * nz AS n_cells, 50 / 2.0::DOUBLE - nx * 5 / 2.0::DOUBLE AS bmin_x, 50 / 2.0::DOUBLE + nx * 5 / 2.0::DOUBLE AS bmax_x
FROM (SELECT DISTINCT variant_id, ceil(50 / 5.0)::BIGINT AS nx, ceil(11 / 2.0)::BIGINT AS ny, ceil(4 / 4.0)::BIGINT AS nz FROM samples)"""))
def manual_grid(spark, sf_dir):
    """One given box for every variant, re-centred on whole cells."""
    variants = B.raw_samples(spark, sf_dir).select("variant_id").distinct()
    out = V.build_grid(V.manual_bounds(variants, (0, 0, 0), (50, 11, 4)), (5.0, 2.0, 4.0))
    return out.select("variant_id", *[F.col(c).cast("bigint").alias(c) for c in ("nx", "ny", "nz")], "n_cells", "bmin_x", "bmax_x")


@query("c4_grid_cells", Q.with_(",".join([Q.TO_GRIDS, Q.DENSE.split("filled AS")[0].rstrip().rstrip(",")]), f"""
SELECT variant_id, cell_idx, ix, iy, iz, {', '.join(Q.r6(c) for c in ('cx', 'cy', 'cz'))} FROM dense"""))
def grid_cells(spark, sf_dir):
    out = rounded(V.grid_cells(grids(spark, sf_dir)), "cx", "cy", "cz")
    return out.select("variant_id", "cell_idx", *[F.col(c).cast("bigint").alias(c) for c in ("ix", "iy", "iz")],
                      "cx", "cy", "cz")


@query("c4_manual_grid", Q.with_(Q.SAMPLES, """
SELECT variant_id, floor((x + 1.5) / 5)::BIGINT * 45 + floor(y / 2)::BIGINT * 9 + floor((z + 0.125) / 0.5)::BIGINT AS cell_idx,
  count(*) AS n FROM samples
WHERE x + 1.5 < 55 AND y < 10 AND z + 0.125 < 4.5 GROUP BY ALL"""))
def manual_grid(spark, sf_dir):
    rows = B.raw_samples(spark, sf_dir)
    box = V.manual_bounds(rows.select("variant_id").distinct(), (0.0, 0.0, 0.0), (52.0, 10.0, 4.25))
    placed = V.assign_cells(rows, V.build_grid(box, (5.0, 2.0, 0.5)))
    return placed.groupBy("variant_id", "cell_idx").agg(F.count(F.lit(1)).alias("n"))


@query("c5_point_to_cell", Q.with_(Q.TO_IN_CELL, """
SELECT variant_id, cell_idx, count(*) AS n, sum(x)::DOUBLE AS sum_x FROM in_cell GROUP BY variant_id, cell_idx"""))
def point_to_cell(spark, sf_dir):
    placed = V.assign_cells(B.raw_samples(spark, sf_dir), grids(spark, sf_dir))
    return placed.groupBy("variant_id", "cell_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"))


@query("c6_grid_inference", Q.with_(Q.TO_GRIDS, f"""
SELECT variant_id, n_cells AS num_cells, 'ok' AS status, nx, ny, nz, 1.0::DOUBLE AS res_x, 1.0::DOUBLE AS res_y,
  1.0::DOUBLE AS res_z, {', '.join(Q.r6(c) for c in BOUND_COLUMNS)} FROM grids"""))
def grid_inference(spark, sf_dir):
    return rounded(V.infer_grid(B.cells(spark, sf_dir)), *BOUND_COLUMNS, "res_x", "res_y", "res_z")


BOX = [f"aabb_{n}_{a}" for n in ("min", "max") for a in V.AXES] + [f"span_{a}" for a in V.AXES] + ["aabb_volume"]
BOX_SQL = """SELECT variant_id, count(*) AS n_cells,
  {ends}, {spans},
  round((max(cx)-min(cx)) * (max(cy)-min(cy)) * (max(cz)-min(cz)), 6) + 0.0::DOUBLE AS aabb_volume
FROM filled GROUP BY variant_id""".format(
    ends=", ".join(Q.r6(f"{n}(c{a})", f"aabb_{n}_{a}") for n in ("min", "max") for a in "xyz"),
    spans=", ".join(Q.r6(f"max(c{a}) - min(c{a})", f"span_{a}") for a in "xyz"))


@query("c7_aabb", Q.with_(Q.TO_FILLED, BOX_SQL))
def aabb(spark, sf_dir):
    return rounded(V.box_of_centres(B.cells(spark, sf_dir)), *BOX)


# Per-sample indicators.

@query("d1_limit_margin", Q.with_(Q.SAMPLES, f"SELECT variant_id, sample_id, {Q.r6('g_lim')} FROM samples"))
def limit_margin(spark, sf_dir):
    return rounded(B.ordered_samples(spark, sf_dir).select("variant_id", "sample_id", "g_lim"), "g_lim")


@query("d2_clearance_score", Q.with_(Q.SAMPLES, f"SELECT variant_id, sample_id, {Q.r6('g_self')} FROM samples"))
def clearance_score(spark, sf_dir):
    return rounded(B.ordered_samples(spark, sf_dir).select("variant_id", "sample_id", "g_self"), "g_self")


@query("d9_manipulability_map", Q.with_(Q.SAMPLES, f"""
SELECT variant_id, sample_id, {Q.r6('s0 / (s0 + 1)', 'g_man')} FROM samples"""))
def manipulability_map(spark, sf_dir):
    rows = B.ordered_samples(spark, sf_dir)
    g_man = G.manipulability(F.col("sigmas"), F.lit(2), F.size("q"), 1.0)
    return rows.select("variant_id", "sample_id", r6(g_man).alias("g_man"))


@query("d10_smallest_singular", Q.with_(Q.SAMPLES, f"SELECT variant_id, sample_id, {Q.r6('g_sigma')} FROM samples"))
def smallest_singular(spark, sf_dir):
    return rounded(B.ordered_samples(spark, sf_dir).select("variant_id", "sample_id", "g_sigma"), "g_sigma")


@query("d11_isotropy", Q.with_(Q.SAMPLES, f"SELECT variant_id, sample_id, {Q.r6('g_iso')} FROM samples"))
def isotropy(spark, sf_dir):
    return rounded(B.ordered_samples(spark, sf_dir).select("variant_id", "sample_id", "g_iso"), "g_iso")


@query("d12_reachability_flag", Q.with_(Q.TO_GRIDS, """
SELECT variant_id, count(*) AS n, count(*) FILTER (g_lim > 0 AND clearance > 0 AND x - bmin_x >= 0 AND x - bmin_x < nx
  AND y - bmin_y >= 0 AND y - bmin_y < ny AND z - bmin_z >= 0 AND z - bmin_z < nz) AS n_reachable
FROM samples JOIN grids USING (variant_id) GROUP BY variant_id"""))
def reachability_flag(spark, sf_dir):
    placed = V.assign_cells(B.samples(spark, sf_dir), grids(spark, sf_dir), keep_outside=True)
    clear = G.finite(F.col("clearance")) & (F.col("clearance") > 0)
    flag = S.reachable(F.col("cell_idx").isNotNull(), F.col("g_lim"), clear, G.finite(F.col("x")))
    return placed.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_reachable"))


DIRECTIONS = """
dirs AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c,
  sqrt(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE
       + embedding[3]::DOUBLE * embedding[3]::DOUBLE) AS n FROM embeddings),
dbins AS (SELECT vec_id, label, (-(max({'d': a/n * bx + b/n * by_ + c/n * bz, 'n': -bin})).n)::INTEGER AS sphere_bin
  FROM dirs CROSS JOIN sphere GROUP BY vec_id, label)"""
SPHERE = "sphere AS (" + Q.SAMPLES.split("sphere AS (")[1].split("binned AS")[0].rstrip().rstrip(",")


def directions(spark, sf_dir):
    vec = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    df = B.table(spark, sf_dir, "embeddings").select("vec_id", "label", *[v.alias(f"_{i}") for i, v in enumerate(vec)])
    a, b, c = F.col("_0"), F.col("_1"), F.col("_2")
    df = df.withColumn("_n", F.sqrt(a * a + b * b + c * c))
    return df.select("vec_id", "label", K.sphere_bin(a / F.col("_n"), b / F.col("_n"), c / F.col("_n")).alias("sphere_bin"))


@query("d13_sphere_bin", Q.with_(SPHERE + "," + DIRECTIONS, "SELECT vec_id, sphere_bin FROM dbins"))
def sphere_bin(spark, sf_dir):
    return directions(spark, sf_dir).select("vec_id", "sphere_bin")


@query("d13_orientation_bin", Q.with_(Q.SAMPLES, "SELECT variant_id, sample_id, sphere_bin FROM samples"))
def orientation_bin(spark, sf_dir):
    """Bins of the samples' orientations, given as whole quaternions."""
    return B.ordered_samples(spark, sf_dir).select("variant_id", "sample_id", "sphere_bin")


# Cell aggregates.

@query("e1_survey_cells", Q.with_(Q.TO_TOUCHED, f"""
SELECT variant_id, cell_idx, attempts, passes, {', '.join(Q.r6(c) for c in
  ('avg_g_self', 'avg_g_lim', 'max_g_man', 'max_g_iso', 'max_g_sigma'))}, n_bins FROM touched"""))
def survey_cells(spark, sf_dir):
    out = S.survey_cells(B.with_indicators(V.assign_cells(B.raw_samples(spark, sf_dir), grids(spark, sf_dir))))
    out = out.withColumn("n_bins", F.coalesce(F.bit_count("rot_mask"), F.lit(0)).cast("bigint")).drop("rot_mask")
    return rounded(out, "avg_g_self", "avg_g_lim", "max_g_man", "max_g_iso", "max_g_sigma")


@query("e2_dense_map", Q.with_(Q.TO_FILLED, f"""
SELECT variant_id, cell_idx, {', '.join(Q.r6(c) for c in ('cx', 'cy', 'cz'))}, g_ws, sample_counts, attempts FROM filled"""))
def dense_map(spark, sf_dir):
    out = B.cells(spark, sf_dir).select("variant_id", "cell_idx", "cx", "cy", "cz", "g_ws", "sample_counts", "attempts")
    return rounded(out, "cx", "cy", "cz")


@query("e3_pass_rate", Q.with_(Q.TO_TOUCHED, f"""
SELECT variant_id, cell_idx, {Q.r6('passes / greatest(attempts, 1)', 'g_selfpass')} FROM touched"""))
def pass_rate(spark, sf_dir):
    placed = V.assign_cells(B.samples(spark, sf_dir), grids(spark, sf_dir))
    counts = placed.groupBy("variant_id", "cell_idx").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("g_self") > 0).alias("passes"))
    return counts.select("variant_id", "cell_idx", r6(S.pass_rate(F.col("passes"), F.col("attempts"))).alias("g_selfpass"))


@query("e4_density", Q.with_(Q.TO_TOUCHED, f"""
SELECT variant_id, cell_idx, {Q.r6('ln(1 + passes) / peak', 'g_red')},
  {Q.r6('ln(1 + attempts) / ln(1 + max(attempts) OVER (PARTITION BY variant_id))', 'redundancy')}
FROM touched JOIN peaks USING (variant_id)"""))
def density(spark, sf_dir):
    placed = V.assign_cells(B.samples(spark, sf_dir), grids(spark, sf_dir))
    counts = materialize(placed.groupBy("variant_id", "cell_idx").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("g_self") > 0).alias("passes")), "counts")
    out = S.redundancy(S.log_density(counts, "passes", "g_red"), "attempts", "redundancy")
    return rounded(out.drop("attempts", "passes"), "g_red", "redundancy")


@query("e5_rotation_coverage", Q.with_(SPHERE + "," + DIRECTIONS, """
SELECT label AS cell_idx, count(*) AS n, round(count(DISTINCT sphere_bin) / 64.0::DOUBLE, 6) AS g_rot FROM dbins GROUP BY label"""))
def rotation_coverage(spark, sf_dir):
    mask = F.bit_or(F.expr("shiftleft(1L, sphere_bin)"))
    return (directions(spark, sf_dir).groupBy(F.col("label").alias("cell_idx"))
            .agg(F.count(F.lit(1)).alias("n"), mask.alias("_m"))
            .select("cell_idx", "n", r6(S.rotation_coverage(F.col("_m"))).alias("g_rot")))


@query("e5_cell_rotation_coverage", Q.with_(Q.TO_IN_CELL, """
SELECT variant_id, cell_idx, count(*) AS n, round(count(DISTINCT sphere_bin) / 64.0::DOUBLE, 6) AS g_rot
FROM in_cell GROUP BY variant_id, cell_idx"""))
def cell_rotation_coverage(spark, sf_dir):
    """Coverage of every cell from the samples' orientations."""
    placed = V.assign_cells(B.ordered_samples(spark, sf_dir).select("variant_id", "x", "y", "z", "sphere_bin"), grids(spark, sf_dir))
    mask = F.bit_or(F.expr("shiftleft(1L, sphere_bin)"))
    return placed.groupBy("variant_id", "cell_idx").agg(F.count(F.lit(1)).alias("n"), mask.alias("_m")).select(
        "variant_id", "cell_idx", "n", r6(S.rotation_coverage(F.col("_m"))).alias("g_rot"))


@query("e6_map_representative", Q.with_(Q.TO_IN_CELL, f"""
SELECT variant_id, cell_idx, substr(variant_id, 1, 1) AS family, {Q.r6('q0')}, {Q.r6('q1')} FROM (
  SELECT *, row_number() OVER (PARTITION BY variant_id, cell_idx ORDER BY g_man + g_self DESC, sample_id) AS k
  FROM in_cell WHERE g_self > 0) WHERE k = 1"""))
def map_representative(spark, sf_dir):
    """Joint vector and family of every reachable cell of the finished map."""
    samples = B.ordered_samples(spark, sf_dir)
    families = samples.select("variant_id", "family").distinct()
    out = S.build_map(samples, 1.0, families=families).filter("q_star is not null")
    return out.select("variant_id", "cell_idx", "family", r6(F.col("q_star")[0]).alias("q0"), r6(F.col("q_star")[1]).alias("q1"))


@query("e6_representative", Q.with_(Q.TO_IN_CELL, f"""
SELECT variant_id, cell_idx, sample_id, {Q.r6('utility')}, {Q.r6('q0')}, {Q.r6('q1')} FROM (
  SELECT *, g_man + g_self AS utility, row_number() OVER (PARTITION BY variant_id, cell_idx
    ORDER BY g_man + g_self DESC, sample_id) AS k FROM in_cell WHERE g_self > 0) WHERE k = 1"""))
def representative(spark, sf_dir):
    placed = V.assign_cells(B.ordered_samples(spark, sf_dir), grids(spark, sf_dir))
    best = S.representatives(placed, ["sample_id", "q"])
    out = best.select("variant_id", "cell_idx", F.col("sample_id").cast("bigint"), "utility",
                      F.get("q", F.lit(0)).alias("q0"), F.get("q", F.lit(1)).alias("q1"))
    return rounded(out, "utility", "q0", "q1")


@query("e7_boundary_distance", Q.with_(Q.TO_CELLS, f"SELECT variant_id, cell_idx, {Q.r6('g_margin')} FROM cells"))
def boundary_distance(spark, sf_dir):
    dense = B.cells(spark, sf_dir).select("variant_id", "cell_idx", "ix", "iy", "iz", "res_x", "res_y", "res_z",
                                          (F.col("g_ws") > 0).alias("valid"))
    edge = S.boundary_distance(dense).drop("distance")
    out = dense.select("variant_id", "cell_idx", "ix", "iy", "iz").join(edge, ["variant_id", "ix", "iy", "iz"])
    return out.select("variant_id", "cell_idx", r6("g_margin").alias("g_margin"))


@query("e8_box_margin", Q.with_(Q.TO_GRIDS, f"""
SELECT variant_id, sample_id, {Q.r6('''least(greatest(least(x-bmin_x, bmax_x-x, y-bmin_y, bmax_y-y, z-bmin_z, bmax_z-z), 0)
  / (least(bmax_x-bmin_x, bmax_y-bmin_y, bmax_z-bmin_z) / 2), 1)''', 'margin')} FROM samples JOIN grids USING (variant_id)"""))
def box_margin(spark, sf_dir):
    boxes = grids(spark, sf_dir).select("variant_id", *BOUND_COLUMNS)
    rows = V.lookup_join(B.ordered_samples(spark, sf_dir).select("variant_id", "sample_id", "x", "y", "z"),
                         boxes, ["variant_id"])
    margin = G.box_margin([F.col(a) for a in V.AXES], [F.col(f"bmin_{a}") for a in V.AXES],
                          [F.col(f"bmax_{a}") for a in V.AXES])
    return rows.select("variant_id", "sample_id", r6(margin).alias("margin"))



@query("survey_end_to_end", Q.with_(Q.TO_CELLS, f"""
SELECT variant_id, cell_idx, sample_counts, {', '.join(Q.r6(c) for c in LABELS)} FROM cells"""))
def survey_end_to_end(spark, sf_dir):
    """Samples to finished map, with nothing taken from an earlier query."""
    return rounded(S.build_map(B.raw_samples(spark, sf_dir), 1.0, score=B.with_indicators).select("variant_id", "cell_idx", "sample_counts", *LABELS), *LABELS)


# Convergence over ordered streams. Fixed test parameters.
WINDOW, EVERY, TARGET, RATE = 250, 100, 0.3, 0.1

MARKS = f"""
len AS (SELECT variant_id, max(sample_id) AS n_samples FROM ev GROUP BY variant_id),
marks AS (SELECT variant_id, k * {EVERY} AS checkpoint FROM len, unnest(range(1, n_samples // {EVERY} + 1)) t(k)),
heat AS (SELECT m.variant_id, m.checkpoint,
    count(f.sample_id) FILTER (is_new OR is_better) / least({WINDOW}, m.checkpoint) AS heat
  FROM marks m LEFT JOIN flagged f ON f.variant_id = m.variant_id AND f.sample_id <= m.checkpoint AND f.sample_id > m.checkpoint - {WINDOW}
  GROUP BY m.variant_id, m.checkpoint),
total AS (SELECT count(DISTINCT user_id) AS n_cells FROM events),
curve AS (SELECT m.variant_id, m.checkpoint, count(*) FILTER (is_new) AS valid_cells, count(*) FILTER (is_better) AS improvements,
    count(*) FILTER (is_new) / (SELECT n_cells FROM total) AS coverage
  FROM marks m LEFT JOIN flagged f ON f.variant_id = m.variant_id AND f.sample_id <= m.checkpoint GROUP BY m.variant_id, m.checkpoint),
stops AS (SELECT h.variant_id, min(h.checkpoint) AS stop_at FROM heat h JOIN curve c USING (variant_id, checkpoint)
  JOIN ev e ON e.variant_id = h.variant_id AND e.sample_id = h.checkpoint AND e.passed
  WHERE coverage >= {TARGET} AND h.checkpoint >= {WINDOW} AND heat < {RATE} GROUP BY h.variant_id)"""
TO_MARKS = Q.EVENTS + "," + MARKS


def stream(spark, sf_dir):
    events = B.ordered_events(spark, sf_dir)
    return events, C.significant_events(events, 0.01)


def cell_totals(spark, sf_dir):
    events = B.ordered_events(spark, sf_dir)
    return events.select("variant_id").distinct().withColumn(
        "n_cells", events.agg(F.count_distinct("cell_idx")).scalar())


@query("f1_significant_events", Q.with_(Q.EVENTS, "SELECT variant_id, cell_idx, sample_id, is_new, is_better FROM flagged"))
def significant_events(spark, sf_dir):
    return stream(spark, sf_dir)[1].select("variant_id", "cell_idx", F.col("sample_id").cast("bigint"), "is_new", "is_better")


@query("f2_update_heat", Q.with_(TO_MARKS, f"SELECT variant_id, checkpoint, {Q.r6('heat')} FROM heat"))
def update_heat(spark, sf_dir):
    return rounded(C.update_heat(*stream(spark, sf_dir), WINDOW, EVERY), "heat")


@query("f3_coverage_curve", Q.with_(TO_MARKS, f"""
SELECT variant_id, checkpoint, valid_cells, improvements, {Q.r6('coverage')} FROM curve"""))
def coverage_curve(spark, sf_dir):
    return rounded(C.coverage_curve(*stream(spark, sf_dir), cell_totals(spark, sf_dir), EVERY), "coverage")


def stop_table(spark, sf_dir):
    events, flags = stream(spark, sf_dir)
    flags = materialize(flags, "flags")
    heat = C.update_heat(events, flags, WINDOW, EVERY)
    curve = C.coverage_curve(events, flags, cell_totals(spark, sf_dir), EVERY)
    return C.stop_points(events, heat, curve, TARGET, WINDOW, RATE)


@query("f4_stop_points", Q.with_(TO_MARKS, "SELECT variant_id, n_samples, stop_at FROM len LEFT JOIN stops USING (variant_id)"))
def stop_points(spark, sf_dir):
    return stop_table(spark, sf_dir)


@query("f4_stops_by_rounds", Q.with_(TO_MARKS, "SELECT variant_id, stop_at FROM stops"))
def stops_by_rounds(spark, sf_dir):
    """Stop points from rounds that double; each round reads its own samples and the state of those before."""
    events, totals = B.ordered_events(spark, sf_dir), materialize(cell_totals(spark, sf_dir), "totals")
    longest = events.agg(F.max("sample_id")).first()[0]
    state, stops = None, None
    for first, count in rounds(longest, WINDOW):
        part = events.filter(F.col("sample_id").between(first, first + count - 1))
        if stops is not None:
            part = part.join(stops, "variant_id", "left_anti")
        state = C.merge_round(state, part, WINDOW, EVERY, 0.01)
        found = C.state_stops(state, totals, first + count - 1, TARGET, WINDOW, RATE)
        if stops is not None:
            found = found.join(stops.select("variant_id"), "variant_id", "left_anti").unionByName(stops)
        stops = materialize(found, "stops")
    return stops


@query("f4_survey_prefix", Q.with_(TO_MARKS, f"""
SELECT variant_id, cell_idx, count(*) AS attempts, count(*) FILTER (passed) AS passes, {Q.r6('max(g_man) FILTER (passed)', 'best')}
FROM ev LEFT JOIN stops USING (variant_id) WHERE stop_at IS NULL OR sample_id <= stop_at GROUP BY variant_id, cell_idx"""))
def survey_prefix(spark, sf_dir):
    kept = C.prefix(B.ordered_events(spark, sf_dir), materialize(stop_table(spark, sf_dir), "stops"))
    out = kept.groupBy("variant_id", "cell_idx").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("passed").alias("passes"),
        F.max(F.when(F.col("passed"), F.col("g_man"))).alias("best"))
    return rounded(out, "best")


@query("f5_moving_average", Q.with_(Q.EVENTS, f"""
SELECT variant_id, sample_id, {Q.r6('''avg(g_man) OVER (PARTITION BY variant_id ORDER BY sample_id
  ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)''', 'smooth')} FROM ev"""))
def moving_average(spark, sf_dir):
    points = B.ordered_events(spark, sf_dir).select("variant_id", "sample_id", "g_man")
    out = C.smoothed_series(points, ["variant_id"], "sample_id", "g_man", 25, "smooth")
    return out.select("variant_id", F.col("sample_id").cast("bigint"), r6("smooth").alias("smooth"))
