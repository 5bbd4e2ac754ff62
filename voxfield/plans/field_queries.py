"""Probe, nearest-cell, score and field queries over the map of the line-item samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import materialize
from ..operators import fields as K, grid as V, survey as S
from ..schemas import AUDIT_LABELS
from . import bindings as B, sql as Q
from .registry import query, r6, rounded
from .survey_queries import BOX_SQL, grids

BASELINE = "NO"

MARKS = "marks AS (SELECT variant_id, " + ", ".join(
    f"quantile_cont(c{a}, {p}) AS {a}_{n}" for a in "xyz"
    for n, p in (("lo", 1 - 0.995), ("hi", 0.995), ("mid_lo", 0.4), ("mid_hi", 0.6))) + " FROM cells WHERE g_ws > 0.5 GROUP BY variant_id)"


def _first(name: str, where: str, order: str) -> str:
    return f"""SELECT variant_id, '{name}' AS probe, cx, cy, cz, cell_idx FROM (SELECT c.*, row_number() OVER (PARTITION BY variant_id
      ORDER BY {order}, cell_idx) AS k FROM cells c JOIN marks USING (variant_id) WHERE g_ws > 0.5 AND {where}) WHERE k = 1"""


PROBES = ["probes AS (" + "\nUNION ALL ".join(
    [_first(f"{a}_pos_extreme", f"c{a} >= {a}_hi", "sample_counts DESC") for a in "xyz"]
    + [_first(f"{a}_neg_extreme", f"c{a} <= {a}_lo", "sample_counts DESC") for a in "xyz"]
    + [_first("central_best_man", " AND ".join(f"c{a} BETWEEN {a}_mid_lo AND {a}_mid_hi" for a in "xyz"), "g_man DESC")]) + ")",
    """low AS (SELECT variant_id, 'low_margin_' || k AS probe, cx, cy, cz, cell_idx FROM (SELECT *, row_number() OVER (
      PARTITION BY variant_id ORDER BY g_margin, cell_idx) AS k FROM cells WHERE g_ws > 0.5) WHERE k <= 5)"""]
TO_PROBES = ",".join([Q.TO_CELLS, MARKS, *PROBES])
PLACE = f"{Q.r6('cx', 'x')}, {Q.r6('cy', 'y')}, {Q.r6('cz', 'z')}, cell_idx"


@query("k1_extreme_probes", Q.with_(TO_PROBES, f"SELECT variant_id, probe, {PLACE} FROM probes WHERE probe <> 'central_best_man'"))
def extreme_probes(spark, sf_dir):
    out = K.quantile_probes(B.cells(spark, sf_dir)).filter(F.col("probe") != "central_best_man")
    return rounded(out, "x", "y", "z")


@query("k2_central_probe", Q.with_(TO_PROBES, f"SELECT variant_id, probe, {PLACE} FROM probes WHERE probe = 'central_best_man'"))
def central_probe(spark, sf_dir):
    out = K.quantile_probes(B.cells(spark, sf_dir)).filter(F.col("probe") == "central_best_man")
    return rounded(out, "x", "y", "z")


@query("k3_low_margin_probes", Q.with_(TO_PROBES, f"SELECT variant_id, probe, {PLACE} FROM low"))
def low_margin_probes(spark, sf_dir):
    return rounded(K.low_margin_probes(B.cells(spark, sf_dir), 5), "x", "y", "z")


ATTACHED = ["cx", "cy", "cz", "g_ws", *AUDIT_LABELS]
NEAREST = """
near AS (SELECT p.probe, p.x, p.y, p.z, c.*, sqrt((cx-p.x)*(cx-p.x) + (cy-p.y)*(cy-p.y) + (cz-p.z)*(cz-p.z)) AS nearest_dist,
    row_number() OVER (PARTITION BY variant_id, p.probe ORDER BY round((cx-p.x)*(cx-p.x) + (cy-p.y)*(cy-p.y) + (cz-p.z)*(cz-p.z), 9), cell_idx) AS k
  FROM cells c CROSS JOIN {probes} p)"""


def nearest_sql(limit: float) -> str:
    attach = ", ".join(f"CASE WHEN nearest_dist <= {limit} THEN round({c}, 6) + 0.0::DOUBLE END AS {c}" for c in ATTACHED)
    return f"""SELECT variant_id, probe, {Q.r6('x', 'probe_x')}, {Q.r6('y', 'probe_y')}, {Q.r6('z', 'probe_z')}, cell_idx,
      {Q.r6('nearest_dist')}, nearest_dist <= {limit} AS matched, {attach},
      CASE WHEN nearest_dist <= {limit} THEN sample_counts END AS sample_counts FROM near WHERE k = 1"""


def rounded_matches(out):
    return rounded(out, "probe_x", "probe_y", "probe_z", "nearest_dist", *ATTACHED)


@query("k4_nearest_cells", Q.with_(Q.TO_CELLS + """,
given AS (SELECT n_name AS probe, n_nationkey * 2.37::DOUBLE - 1.013::DOUBLE AS x, n_regionkey * 2.71::DOUBLE + 0.017::DOUBLE AS y,
  n_nationkey % 7 * 1.43::DOUBLE + 0.019::DOUBLE AS z FROM nation),""" + NEAREST.format(probes="given"), nearest_sql(0.6)))
def nearest_cells(spark, sf_dir):
    probes = B.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("probe"), (F.col("n_nationkey") * 2.37 - 1.013).alias("x"),
        (F.col("n_regionkey") * 2.71 + 0.017).alias("y"), (F.col("n_nationkey") % 7 * 1.43 + 0.019).alias("z"))
    return rounded_matches(K.nearest_cells(B.cells(spark, sf_dir), grids(spark, sf_dir), probes, 0.6))


@query("k5_family_audit_probes", Q.with_(TO_PROBES + f""",
base AS (SELECT probe, cx AS x, cy AS y, cz AS z FROM (SELECT * FROM probes UNION ALL SELECT * FROM low) WHERE variant_id = '{BASELINE}'),"""
                                         + NEAREST.format(probes="base"),
                                         f"SELECT * FROM ({nearest_sql(0.05)}) WHERE variant_id NOT LIKE 'R%'"))
def family_audit_probes(spark, sf_dir):
    return rounded_matches(audit(spark, sf_dir).probes)


def audit(spark, sf_dir):
    """Without the variants that begin with R."""
    return K.family_audit(B.cells(spark, sf_dir), grids(spark, sf_dir), BASELINE, "^[AN]")


def _audit_sql() -> str:
    means = ", ".join(Q.r6(f"avg({k}) FILTER (g_ws > 0.5)", f"{k}_mean") for k in AUDIT_LABELS)
    marks = ", ".join(Q.r6(f"quantile_cont({k}, {p}) FILTER (g_ws > 0.5)", f"{k}_{n}")
                      for k in AUDIT_LABELS for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
    body = BOX_SQL.replace("FROM filled", f""", count(*) FILTER (g_ws > 0.5) AS n_reachable,
      {Q.r6('count(*) FILTER (g_ws > 0.5) / count(*)', 'coverage')}, {means}, {marks} FROM cells""")
    return Q.with_(Q.TO_CELLS, f"SELECT * FROM ({body}) WHERE variant_id NOT LIKE 'R%'")


@query("k5_family_audit_summary", Q.with_(TO_PROBES + f""",
named AS (SELECT count(*) AS n FROM (SELECT * FROM probes UNION ALL SELECT * FROM low) WHERE variant_id = '{BASELINE}'),
boxes AS ({BOX_SQL.replace("FROM filled", ", count(*) FILTER (g_ws > 0.5) AS n_reachable FROM cells")})""", f"""
SELECT variant_id, '{BASELINE}' AS baseline, n AS probe_count, 0.05::DOUBLE AS max_match_dist_m,
  {Q.r6('n_reachable / n_cells', 'coverage')}, n_cells, n_reachable, span_x, span_y, span_z, aabb_volume
FROM boxes, named WHERE variant_id NOT LIKE 'R%'"""))
def family_audit_summary(spark, sf_dir):
    out = audit(spark, sf_dir).documents
    spans = {f"span_{a}": F.col("span")[i] for i, a in enumerate("xyz")}
    return rounded(out.withColumns(spans).drop("span"), "coverage", *spans, "aabb_volume")


@query("k5_family_audit_global", _audit_sql())
def family_audit_global(spark, sf_dir):
    out = audit(spark, sf_dir).overall
    return rounded(out, *[c for c in out.columns if c not in ("variant_id", "n_cells", "n_reachable")])


@query("k7_threshold_filter", Q.with_(Q.TO_FILLED, f"""
SELECT variant_id, cell_idx, {Q.r6('g_man')} FROM filled WHERE g_ws = 1 AND g_man >= 0.6"""))
def threshold_filter(spark, sf_dir):
    return rounded(K.reachable_cells(B.cells(spark, sf_dir), "g_man", 0.6).select("variant_id", "cell_idx", "g_man"), "g_man")


SCORED_METRICS = ["g_selfpass", "g_lim", "g_man", "g_iso", "g_sigma", "g_red", "g_rot"]
SCORES = "qs AS (SELECT variant_id, " + ", ".join(
    f"quantile_cont(greatest({m}, 0), 0.99) AS q_{m}" for m in SCORED_METRICS) + """ FROM cells WHERE g_ws = 1 GROUP BY variant_id),
norms AS (SELECT c.*, """ + ", ".join(
    f"CASE WHEN q_{m} < 1e-9 THEN 0.0 ELSE least(greatest({m}, 0) / q_{m}, 1) END::DOUBLE AS n_{m}" for m in SCORED_METRICS) + """
  FROM cells c JOIN qs USING (variant_id) WHERE g_ws = 1),
scored AS (SELECT *, pow(least(greatest((least(n_g_selfpass, n_g_lim) - 0.1::DOUBLE) / 0.9::DOUBLE, 0), 1), 0.8::DOUBLE) AS safety,
  pow(CASE WHEN least(n_g_selfpass, n_g_lim) > 0.01 THEN pow(n_g_man, 0.4::DOUBLE) * pow(n_g_iso, 0.15::DOUBLE) * pow(n_g_sigma, 0.15::DOUBLE)
    * pow(n_g_red, 0.15::DOUBLE) * pow(n_g_rot, 0.15::DOUBLE) ELSE 0 END, 1.2::DOUBLE) AS dexterity FROM norms)"""
TO_SCORES = Q.TO_CELLS + "," + SCORES


@query("k8_normalised_metrics", Q.with_(TO_SCORES, "SELECT variant_id, cell_idx, "
       + ", ".join(Q.r6(f"n_{m}") for m in SCORED_METRICS) + " FROM norms"))
def normalised_metrics(spark, sf_dir):
    out = K.normalised(K.reachable_cells(B.cells(spark, sf_dir)), SCORED_METRICS)
    names = [f"n_{m}" for m in SCORED_METRICS]
    return rounded(out.select("variant_id", "cell_idx", *names), *names)


def scored_points(spark, sf_dir):
    return K.scores(K.reachable_cells(B.cells(spark, sf_dir)))


@query("k9_scores", Q.with_(TO_SCORES, f"SELECT variant_id, cell_idx, {Q.r6('safety')}, {Q.r6('dexterity')} FROM scored"))
def scores(spark, sf_dir):
    return rounded(scored_points(spark, sf_dir).select("variant_id", "cell_idx", "safety", "dexterity"), "safety", "dexterity")


@query("k4_viewer_probe", Q.with_(TO_SCORES, f"""
SELECT variant_id, cell_idx, {Q.r6('distance')}, {Q.r6('safety')}, distance < 0.6 AND safety > 0.001 AS is_valid FROM (
  SELECT *, sqrt((cx-20.1)*(cx-20.1) + (cy-4.2)*(cy-4.2) + (cz-3.3)*(cz-3.3)) AS distance, row_number() OVER (PARTITION BY variant_id
    ORDER BY (cx-20.1)*(cx-20.1) + (cy-4.2)*(cy-4.2) + (cz-3.3)*(cz-3.3), cell_idx) AS k FROM scored) WHERE k = 1"""))
def viewer_probe(spark, sf_dir):
    return rounded(K.viewer_probe(scored_points(spark, sf_dir), (20.1, 4.2, 3.3), max_distance=0.6), "distance", "safety")


RESOLUTION = 80


def _spread(a: str, source: str, target: str, left: str) -> str:
    keep = "* EXCLUDE (d2)" if a != "x" else "*"
    d2 = "d2 + " if a != "x" else ""
    return f"""{target} AS (SELECT {keep}, {d2}(o_{a} + i{a} * h_{a} - c{a}) * (o_{a} + i{a} * h_{a} - c{a}) AS d2 FROM {source},
      unnest(range(greatest(0, ceil((c{a} - o_{a}) / h_{a} - {left} / h_{a} - 1e-9))::BIGINT,
        least({RESOLUTION} - 1, floor((c{a} - o_{a}) / h_{a} + {left} / h_{a} + 1e-9))::BIGINT + 1)) t(i{a}))"""


LATTICE = f"""
lat0 AS (SELECT variant_id, {', '.join(f"min(c{a}) - 0.05::DOUBLE AS o_{a}, (max(c{a}) - min(c{a}) + 2 * 0.05::DOUBLE) / {RESOLUTION - 1} AS h_{a}" for a in 'xyz')}
  FROM filled WHERE g_ws = 1 GROUP BY variant_id),
lat AS (SELECT *, greatest(h_x, h_y, h_z) * 3.0::DOUBLE AS radius FROM lat0),
p0 AS (SELECT variant_id, cx, cy, cz, g_man, g_lim, lat.* EXCLUDE (variant_id) FROM filled JOIN lat USING (variant_id) WHERE g_ws = 1),
""" + ",\n".join([_spread("x", "p0", "p1", "radius"), _spread("y", "p1", "p2", "sqrt(greatest(radius * radius - d2, 0))"),
                  _spread("z", "p2", "p3", "sqrt(greatest(radius * radius - d2, 0))")]) + """,
field AS (SELECT variant_id, ix, iy, iz, sum(w * g_man) / sum(w) AS g_man, sum(w * g_lim) / sum(w) AS g_lim
  FROM (SELECT *, exp(-4.0 * d2 / (radius * radius)) AS w FROM p3 WHERE d2 <= radius * radius) GROUP BY variant_id, ix, iy, iz)"""


@query("k10_resampled_field", Q.with_(Q.TO_FILLED + "," + LATTICE, f"""
SELECT variant_id, ix::INTEGER AS ix, count(*) AS n, {Q.r6('avg(g_man)', 'mean_man')}, {Q.r6('max(g_man)', 'max_man')}, {Q.r6('avg(g_lim)', 'mean_lim')}
FROM field GROUP BY variant_id, ix"""))
def resampled_field(spark, sf_dir):
    points = K.reachable_cells(B.cells(spark, sf_dir))
    lattice = materialize(K.lattices(points, RESOLUTION), "lattices")
    field = K.resampled_field(points, ["g_man", "g_lim"], lattice)
    out = field.groupBy("variant_id", "ix").agg(
        F.count(F.lit(1)).alias("n"), F.avg("g_man").alias("mean_man"), F.max("g_man").alias("max_man"), F.avg("g_lim").alias("mean_lim"))
    return rounded(out, "mean_man", "max_man", "mean_lim")


def _smooth_sql() -> str:
    steps, source = [], "filled"
    for a in "xyz":
        fold = f"((f.i{a} + o) % (2 * n{a}) + 2 * n{a}) % (2 * n{a})"
        others = " AND ".join(f"g.i{b} = f.i{b}" for b in "xyz" if b != a)
        steps.append(f"""s{a} AS (SELECT f.variant_id, f.ix, f.iy, f.iz, sum(w * g.v) AS v FROM (SELECT variant_id, ix, iy, iz, {'g_man AS v' if source == 'filled' else 'v'} FROM {source}) f
          JOIN grids USING (variant_id) CROSS JOIN taps JOIN (SELECT variant_id, ix, iy, iz, {'g_man AS v' if source == 'filled' else 'v'} FROM {source}) g
          ON g.variant_id = f.variant_id AND {others} AND g.i{a} = CASE WHEN {fold} < n{a} THEN {fold} ELSE 2 * n{a} - 1 - {fold} END
          GROUP BY f.variant_id, f.ix, f.iy, f.iz)""")
        source = f"s{a}"
    return """taps0 AS (SELECT o, exp(-0.5 * (o / 1.5::DOUBLE) * (o / 1.5::DOUBLE)) AS e FROM range(-6, 7) t(o)),
taps AS (SELECT o, e / (SELECT sum(e) FROM taps0) AS w FROM taps0),
""" + ",\n".join(steps)


TO_SMOOTH = Q.TO_FILLED + "," + _smooth_sql()


def smooth_man(spark, sf_dir):
    return K.smoothed_field(B.cells(spark, sf_dir), "g_man", 1.5)


@query("k11_gaussian_smoothing", Q.with_(TO_SMOOTH, f"SELECT variant_id, ix, iy, iz, {Q.r6('v', 'g_man')} FROM sz"))
def gaussian_smoothing(spark, sf_dir):
    out = smooth_man(spark, sf_dir)
    return out.select("variant_id", *[F.col(f"i{a}").cast("bigint").alias(f"i{a}") for a in "xyz"], r6("g_man").alias("g_man"))


@query("k12_axis_slice", Q.with_(TO_SMOOTH, f"""
SELECT variant_id, ix, iy, iz, {Q.r6('v', 'g_man')} FROM sz JOIN grids USING (variant_id)
WHERE ix = floor((bmin_x + bmax_x) / 2 + 0.2::DOUBLE - bmin_x) AND v > 0.001"""))
def axis_slice(spark, sf_dir):
    g = grids(spark, sf_dir)
    at = (F.col("bmin_x") + F.col("bmax_x")) / 2 + 0.2
    planes = g.select("variant_id", K.nearest_plane(at, F.col("bmin_x") + F.col("res_x") / 2, F.col("res_x"), F.col("nx")).alias("plane"))
    out = K.axis_slice(smooth_man(spark, sf_dir), planes, "x", "g_man")
    return out.select("variant_id", *[F.col(f"i{a}").cast("bigint").alias(f"i{a}") for a in "xyz"], r6("g_man").alias("g_man"))


@query("k12_plane_projection", Q.with_(Q.TO_CELLS, f"SELECT variant_id, cell_idx, {Q.r6('cx')}, {Q.r6('cy')}, {Q.r6('g_margin', 'value')} FROM cells"))
def plane_projection(spark, sf_dir):
    return rounded(K.plane_projection(B.cells(spark, sf_dir), "g_margin"), "cx", "cy", "value")


@query("k13_ratio_field", Q.with_(Q.TO_IN_CELL + "," + Q.TOUCHED, f"""
SELECT variant_id, cell_idx, {Q.r6('q / (avg_g_self + 1e-6::DOUBLE)', 'ratio')} FROM (
  SELECT variant_id, cell_idx, g_self AS q, row_number() OVER (PARTITION BY variant_id, cell_idx ORDER BY g_man + g_self DESC, sample_id) AS k
  FROM in_cell WHERE g_self > 0) JOIN touched USING (variant_id, cell_idx) WHERE k = 1"""))
def ratio_field(spark, sf_dir):
    placed = V.assign_cells(B.ordered_samples(spark, sf_dir), grids(spark, sf_dir))
    best = S.representatives(placed, ["g_self"]).withColumnRenamed("g_self", "g_self_qstar").drop("utility")
    cells = B.cells(spark, sf_dir).select("variant_id", "cell_idx", "g_self").join(best, ["variant_id", "cell_idx"])
    return rounded(K.ratio_field(cells).select("variant_id", "cell_idx", "ratio"), "ratio")
