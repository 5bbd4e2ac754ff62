"""Shared pieces of the SQL counterparts."""

from __future__ import annotations

# Line items as samples with their indicators; `sid` is the position in the variant's stream.
SAMPLES = """
raw AS (
  SELECT l_returnflag || l_linestatus AS variant_id, l_returnflag AS family,
    row_number() OVER (PARTITION BY l_returnflag || l_linestatus
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS sample_id,
    l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z,
    l_discount * 10 - 0.5::DOUBLE AS q0, l_tax * 10 - 0.4::DOUBLE AS q1,
    ((l_partkey % 100) - 10) / 500.0::DOUBLE AS clearance,
    l_quantity / 50 AS s0, l_extendedprice / (l_extendedprice + 30000) AS g_man,
    l_partkey % 7 - 3 AS a, l_suppkey % 7 - 3 AS b, l_partkey % 5 - 2 AS c
  FROM lineitem),
quats AS (
  SELECT DISTINCT a, b, c, a / sqrt((a*a + b*b + c*c + 1)::DOUBLE) AS qx, b / sqrt((a*a + b*b + c*c + 1)::DOUBLE) AS qy,
    c / sqrt((a*a + b*b + c*c + 1)::DOUBLE) AS qz, 1 / sqrt((a*a + b*b + c*c + 1)::DOUBLE) AS qw FROM raw),
sphere AS (
  SELECT i::INTEGER AS bin, CAST(cos(pi() * (3.0::DOUBLE - sqrt(5.0::DOUBLE)) * i) * sqrt(1 - y*y) AS FLOAT)::DOUBLE AS bx,
    CAST(y AS FLOAT)::DOUBLE AS by_, CAST(sin(pi() * (3.0::DOUBLE - sqrt(5.0::DOUBLE)) * i) * sqrt(1 - y*y) AS FLOAT)::DOUBLE AS bz
  FROM (SELECT i, 1.0::DOUBLE - 2.0::DOUBLE * i / 63 AS y FROM range(64) t(i))),
binned AS (
  SELECT a, b, c, (-(max({'d': 2.0*(qx*qz + qw*qy) * bx + 2.0*(qy*qz - qw*qx) * by_ + (1.0 - 2.0*(qx*qx + qy*qy)) * bz,
    'n': -bin})).n)::INTEGER AS sphere_bin
  FROM quats CROSS JOIN sphere GROUP BY a, b, c),
samples AS (
  SELECT variant_id, family, sample_id, x, y, z, q0, q1, clearance, s0, g_man, sphere_bin,
    CASE WHEN clearance <= 0 THEN 0.0::DOUBLE ELSE least(clearance / 0.05::DOUBLE, 1.0::DOUBLE) END AS g_self,
    (least(greatest(least(q0 + 0.6::DOUBLE, 0.6::DOUBLE - q0) / 0.6::DOUBLE, 0), 1)
     + least(greatest(least(q1 + 0.6::DOUBLE, 0.6::DOUBLE - q1) / 0.6::DOUBLE, 0), 1)) / 2 AS g_lim,
    least(s0, 1.0) / greatest(s0, 1.0) AS g_iso, least(s0, 1.0) / (least(s0, 1.0) + 0.1::DOUBLE) AS g_sigma
  FROM raw JOIN binned USING (a, b, c))"""


def _axis(a: str) -> str:
    return (f"(lo_{a} + hi_{a}) * 0.5::DOUBLE - (hi_{a} - lo_{a}) * 0.5::DOUBLE * 1.1::DOUBLE AS b0_{a}, "
            f"(lo_{a} + hi_{a}) * 0.5::DOUBLE + (hi_{a} - lo_{a}) * 0.5::DOUBLE * 1.1::DOUBLE AS b1_{a}")


BOUNDS = f"""
ends AS (SELECT variant_id, count(*) AS n_valid, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y,
  min(z) AS lo_z, max(z) AS hi_z FROM samples GROUP BY variant_id),
bounds AS (SELECT variant_id, n_valid, {_axis('x')}, {_axis('y')}, {_axis('z')} FROM ends)"""

GRIDS = """
dims AS (SELECT *, greatest(1, ceil(round(b1_x - b0_x, 9)))::BIGINT AS nx, greatest(1, ceil(round(b1_y - b0_y, 9)))::BIGINT AS ny,
  greatest(1, ceil(round(b1_z - b0_z, 9)))::BIGINT AS nz FROM bounds),
grids AS (SELECT variant_id, nx, ny, nz, nx * ny * nz AS n_cells,
  (b0_x + b1_x) / 2 - nx / 2.0::DOUBLE AS bmin_x, (b0_x + b1_x) / 2 + nx / 2.0::DOUBLE AS bmax_x,
  (b0_y + b1_y) / 2 - ny / 2.0::DOUBLE AS bmin_y, (b0_y + b1_y) / 2 + ny / 2.0::DOUBLE AS bmax_y,
  (b0_z + b1_z) / 2 - nz / 2.0::DOUBLE AS bmin_z, (b0_z + b1_z) / 2 + nz / 2.0::DOUBLE AS bmax_z FROM dims)"""

IN_CELL = """
in_cell AS (
  SELECT s.*, floor(x - bmin_x)::BIGINT * ny * nz + floor(y - bmin_y)::BIGINT * nz + floor(z - bmin_z)::BIGINT AS cell_idx
  FROM samples s JOIN grids USING (variant_id)
  WHERE x - bmin_x >= 0 AND x - bmin_x < nx AND y - bmin_y >= 0 AND y - bmin_y < ny AND z - bmin_z >= 0 AND z - bmin_z < nz)"""

TOUCHED = """
touched AS (
  SELECT variant_id, cell_idx, count(*) AS attempts, count(*) FILTER (g_self > 0) AS passes,
    avg(g_self) FILTER (g_self > 0) AS avg_g_self, avg(g_lim) FILTER (g_self > 0) AS avg_g_lim,
    max(g_man) FILTER (g_self > 0) AS max_g_man, max(g_iso) FILTER (g_self > 0) AS max_g_iso,
    max(g_sigma) FILTER (g_self > 0) AS max_g_sigma, count(DISTINCT sphere_bin) FILTER (g_self > 0) AS n_bins
  FROM in_cell GROUP BY variant_id, cell_idx),
peaks AS (SELECT variant_id, max(ln(1 + passes)) AS peak FROM touched GROUP BY variant_id)"""

DENSE = """
dense AS (
  SELECT g.variant_id, left(g.variant_id, 1) AS family, ix * ny * nz + iy * nz + iz AS cell_idx, ix, iy, iz,
    bmin_x + ix + 0.5::DOUBLE AS cx, bmin_y + iy + 0.5::DOUBLE AS cy, bmin_z + iz + 0.5::DOUBLE AS cz
  FROM grids g, unnest(range(nx)) a(ix), unnest(range(ny)) b(iy), unnest(range(nz)) c(iz)),
filled AS (
  SELECT d.*, CASE WHEN passes > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS g_ws,
    coalesce(ln(1 + passes) / peak, 0)::DOUBLE AS g_red, coalesce(avg_g_self, 0)::DOUBLE AS g_self,
    coalesce(passes / greatest(attempts, 1), 0)::DOUBLE AS g_selfpass, coalesce(avg_g_lim, 0)::DOUBLE AS g_lim,
    coalesce(n_bins, 0) / 64.0::DOUBLE AS g_rot, coalesce(max_g_man, 0)::DOUBLE AS g_man, coalesce(max_g_iso, 0)::DOUBLE AS g_iso,
    coalesce(max_g_sigma, 0)::DOUBLE AS g_sigma, coalesce(attempts, 0)::BIGINT AS attempts, coalesce(passes, 0)::BIGINT AS sample_counts
  FROM dense d LEFT JOIN touched t USING (variant_id, cell_idx) JOIN peaks USING (variant_id))"""

MARGIN = """
nearest AS (
  SELECT v.variant_id, v.cell_idx, sqrt(min((v.ix-i.ix)*(v.ix-i.ix) + (v.iy-i.iy)*(v.iy-i.iy) + (v.iz-i.iz)*(v.iz-i.iz))::DOUBLE) AS distance
  FROM filled v JOIN filled i ON v.variant_id = i.variant_id AND i.g_ws = 0 WHERE v.g_ws > 0 GROUP BY v.variant_id, v.cell_idx),
farthest AS (SELECT variant_id, max(distance) AS far FROM nearest GROUP BY variant_id),
cells AS (SELECT f.*, coalesce(distance / far, 0)::DOUBLE AS g_margin
  FROM filled f LEFT JOIN nearest USING (variant_id, cell_idx) LEFT JOIN farthest USING (variant_id))"""

TO_GRIDS = ",".join([SAMPLES, BOUNDS, GRIDS])
TO_IN_CELL = ",".join([TO_GRIDS, IN_CELL])
TO_TOUCHED = ",".join([TO_IN_CELL, TOUCHED])
TO_FILLED = ",".join([TO_TOUCHED, DENSE])
TO_CELLS = ",".join([TO_FILLED, MARGIN])

# Events as ordered streams with significance flags.
EVENTS = """
ev AS (
  SELECT event_type AS variant_id, user_id AS cell_idx, value / (value + 50) AS g_man, value > 20 AS passed,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sample_id FROM events),
seen AS (
  SELECT *, max(g_man) OVER (PARTITION BY variant_id, cell_idx ORDER BY sample_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM ev WHERE passed),
flagged AS (
  SELECT *, best_before IS NULL AS is_new, best_before IS NOT NULL AND g_man > best_before * 1.01::DOUBLE AS is_better FROM seen)"""


#: The primes of XXH64 and the numbers of its arithmetic, which wraps at 2 ** 64.
_P = {1: 11400714785074694791, 2: 14029467366897019727, 3: 1609587929392839161, 4: 9650029242287828579, 5: 2870177450012600261}


def draw(numbers: list[str], seed: int = 42) -> tuple[dict[str, str], str]:
    """(columns, uniform): the 64-bit hash of whole numbers >= 0 as columns that build on each other, and the draw from it."""
    wrap = lambda e: f"(({e}) % 18446744073709551616::UHUGEINT)"
    big = lambda n: f"{n}::UHUGEINT"
    either = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
    turn = lambda e, n: f"({wrap(f'{e} * {big(1 << n)}')} + {e} // {big(1 << 64 - n)})"
    columns, h = {}, big(seed)
    for k, number in enumerate(numbers):
        steps = [("a", wrap(f"({number})::UHUGEINT * {big(_P[2])}")), ("b", turn(f"_a{k}", 31)), ("c", wrap(f"_b{k} * {big(_P[1])}")),
                 ("d", either(wrap(f"{h} + {big(_P[5] + 8)}"), f"_c{k}")), ("e", turn(f"_d{k}", 27)),
                 ("f", wrap(f"{wrap(f'_e{k} * {big(_P[1])}')} + {big(_P[4])}")), ("g", either(f"_f{k}", f"_f{k} // {big(1 << 33)}")),
                 ("h", wrap(f"_g{k} * {big(_P[2])}")), ("i", either(f"_h{k}", f"_h{k} // {big(1 << 29)}")),
                 ("j", wrap(f"_i{k} * {big(_P[3])}")), ("k", either(f"_j{k}", f"_j{k} // {big(1 << 32)}"))]
        columns |= {f"_{name}{k}": e for name, e in steps}
        h = f"_k{k}"
    return columns, f"(({h} // {big(1 << 11)})::DOUBLE / 9007199254740992.0::DOUBLE)"


def with_columns(rows: str, columns: dict[str, str]) -> str:
    """``rows`` with columns that build on each other, each in a select of its own, so that none is computed twice."""
    for name, expression in columns.items():
        rows = f"(SELECT *, {expression} AS {name} FROM {rows})"
    return rows


def stream(*parts: str) -> str:
    """The number of a stream of draws, from SQL text expressions."""
    return f"""('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 15))::BIGINT"""


def r6(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE AS {alias or expr}"


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
