"""Vector and indicator expressions; all stay inside Spark's own functions."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, functions as F

SPHERE_BINS = 64


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _single(v: float) -> float:
    return struct.unpack("f", struct.pack("f", v))[0]


def sphere_points(n: int = SPHERE_BINS) -> list[tuple[float, float, float]]:
    """Golden-angle lattice of ``n`` directions, rounded to single precision."""
    angle = math.pi * (3.0 - math.sqrt(5.0))
    points = []
    for i in range(n):
        y = 1.0 - 2.0 * i / (n - 1)
        ring = math.sqrt(1.0 - y * y)
        points.append(tuple(_single(v) for v in (math.cos(angle * i) * ring, y, math.sin(angle * i) * ring)))
    return points


def approach_vector(qx: Column, qy: Column, qz: Column, qw: Column) -> tuple[Column, Column, Column]:
    """Third axis of the frame given by a quaternion (x, y, z, w)."""
    return (2.0 * (qx * qz + qw * qy), 2.0 * (qy * qz - qw * qx), 1.0 - 2.0 * (qx * qx + qy * qy))


def limit_margin(q: Column, limits: Column) -> Column:
    """Mean over joints of the distance to the nearer limit as a share of half the range; outside counts 0."""
    def one(value: Column, limit: Column) -> Column:
        half = F.when(limit["hi"] - limit["lo"] > 0, limit["hi"] - limit["lo"]).otherwise(F.lit(1e-6)) / 2
        return clip(F.least(value - limit["lo"], limit["hi"] - value) / half, 0.0, 1.0)
    total = F.aggregate(F.zip_with(q, limits, one), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(limits) == 0, F.lit(1.0)).otherwise(total / F.size(limits))


def clearance_score(clearance: Column, safe: float = 0.05) -> Column:
    """0 for missing, non-finite or non-positive clearance, else clearance / safe up to 1."""
    safe = safe if safe > 0 else 0.10
    return (F.when(~finite(clearance) | (clearance <= 0), F.lit(0.0))
            .otherwise(clip(clearance / F.lit(safe), 0.0, 1.0)))


def saturate(v: Column, k: float) -> Column:
    """v / (v + k) for finite positive v, else 0."""
    return F.when(finite(v) & (v > 0), v / (v + F.lit(k))).otherwise(F.lit(0.0))


def manipulability(sigmas: Column, n_rows: Column, n_cols: Column, k: float = 1.0) -> Column:
    """Product of the singular values (0 when the matrix has fewer columns than rows), saturated by k."""
    w = F.aggregate(sigmas, F.lit(1.0), lambda a, s: a * s)
    return saturate(F.when((n_cols >= n_rows) & (F.size(sigmas) > 0), w).otherwise(F.lit(0.0)), k if k > 0 else 1.0)


def smallest_singular(sigmas: Column, k: float = 0.1) -> Column:
    return saturate(F.array_min(sigmas), k if k > 0 else 0.1)


def _rotated(rows: Column, pair: Column) -> Column:
    """The matrix after the rotation that makes two of its rows orthogonal."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    p, q = pair["p"], pair["q"]

    def turn(m: Column) -> Column:
        zeta = (m["qq"] - m["pp"]) / (2.0 * m["pq"])
        tangent = F.when(zeta < 0, -1.0).otherwise(1.0) / (F.abs(zeta) + F.sqrt(1.0 + zeta * zeta))
        return F.when(F.abs(m["pq"]) > 1e-300, tangent).otherwise(0.0)

    def apply(r: Column) -> Column:
        return F.transform(rows, lambda row, i: F.when(i == p, F.zip_with(
            r["a"], r["b"], lambda x, y: r["c"] * x - r["s"] * y)).when(i == q, F.zip_with(
                r["a"], r["b"], lambda x, y: r["s"] * x + r["c"] * y)).otherwise(row))
    both = F.struct(F.get(rows, p).alias("a"), F.get(rows, q).alias("b"))
    sums = lambda ab: F.struct(ab["a"].alias("a"), ab["b"].alias("b"), product(ab["a"], ab["a"]).alias("pp"),
                               product(ab["b"], ab["b"]).alias("qq"), product(ab["a"], ab["b"]).alias("pq"))
    tangents = lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), turn(m).alias("t"))
    turned = lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), (1.0 / F.sqrt(1.0 + m["t"] * m["t"])).alias("c"),
                                (m["t"] / F.sqrt(1.0 + m["t"] * m["t"])).alias("s"))
    return let(both, lambda ab: let(sums(ab), lambda m: let(tangents(m), lambda t: let(turned(t), apply))))


def singular_values(rows: Column, n_rows: int, sweeps: int = 8) -> Column:
    """Singular values, largest first, of a matrix given as an array of ``n_rows`` arrays, by one-sided Jacobi rotations.

    Each step makes two rows orthogonal; after a few sweeps over all pairs their lengths are the singular values. A matrix
    with fewer columns than rows has as many values as columns.
    """
    pairs = [(p, q) for p in range(n_rows) for q in range(p + 1, n_rows)] * sweeps
    steps = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs])
    matrix = "array<array<double>>"
    done = F.aggregate(steps, rows.cast(matrix), lambda m, pair: _rotated(m, pair).cast(matrix))
    norms = F.transform(done, lambda row: F.sqrt(F.aggregate(row, F.lit(0.0), lambda t, v: t + v * v)))
    return F.slice(F.sort_array(norms, asc=False), 1, F.least(F.lit(n_rows), F.size(F.get(rows, F.lit(0)))))


def isotropy(sigmas: Column) -> Column:
    """Smallest over largest singular value; 0 when any value is not finite or there is none."""
    ok = (F.size(sigmas) > 0) & F.forall(sigmas, finite) & (F.array_max(sigmas) > 0)
    return F.when(ok, clip(F.array_min(sigmas) / F.array_max(sigmas), 0.0, 1.0)).otherwise(F.lit(0.0))


def box_margin(position: list[Column], low: list[Column], high: list[Column]) -> Column:
    """Distance to the nearest face of a box over half its smallest side, within [0, 1]."""
    faces = [c for p, a, b in zip(position, low, high) for c in (p - a, b - p)]
    side = F.least(*[F.greatest(b - a, F.lit(1e-6)) for a, b in zip(low, high)])
    return clip(F.greatest(F.least(*faces), F.lit(0.0)) / (side / 2), 0.0, 1.0)


def vector(v: Column) -> tuple[Column, Column, Column]:
    return v["x"], v["y"], v["z"]


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: tuple, b: tuple) -> tuple:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def _xyz(v: tuple) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def segment_distances(pairs: Column) -> Column:
    """Distances of an array of segment pairs ``struct<p0, p1, q0, q1, reach>``, less ``reach``.

    Closest points are found on the infinite lines and clamped to the segments one by one; for (nearly) parallel
    lines the first segment's start is used. Each step is its own transform so that no value is computed twice.
    """
    lines = F.transform(pairs, lambda s: F.struct(
        s["p0"].alias("p0"), s["q0"].alias("q0"), s["reach"].alias("reach"),
        _xyz(minus(vector(s["p1"]), vector(s["p0"]))).alias("u"),
        _xyz(minus(vector(s["q1"]), vector(s["q0"]))).alias("v"),
        _xyz(minus(vector(s["p0"]), vector(s["q0"]))).alias("w")))
    products = F.transform(lines, lambda s: F.struct(
        s["u"].alias("u"), s["v"].alias("v"), s["w"].alias("w"), s["reach"].alias("reach"),
        dot(vector(s["u"]), vector(s["u"])).alias("uu"),
        dot(vector(s["u"]), vector(s["v"])).alias("uv"),
        dot(vector(s["v"]), vector(s["v"])).alias("vv"),
        dot(vector(s["u"]), vector(s["w"])).alias("uw"),
        dot(vector(s["v"]), vector(s["w"])).alias("vw")))
    placed = F.transform(products, lambda s: F.struct(
        s["u"].alias("u"), s["v"].alias("v"), s["w"].alias("w"), s["reach"].alias("reach"),
        clip(closest_on_first(s), 0.0, 1.0).alias("s"), clip(closest_on_second(s), 0.0, 1.0).alias("t")))

    def gap(s: Column) -> Column:
        parts = [s["w"][k] + s["s"] * s["u"][k] - s["t"] * s["v"][k] for k in ("x", "y", "z")]
        return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]) - s["reach"]
    return F.transform(placed, gap)


def _spread(s: Column) -> Column:
    return s["uu"] * s["vv"] - s["uv"] * s["uv"]


def closest_on_first(s: Column) -> Column:
    return F.when(_spread(s) > 1e-12, (s["uv"] * s["vw"] - s["vv"] * s["uw"]) / _spread(s)).otherwise(F.lit(0.0))


def closest_on_second(s: Column) -> Column:
    return (F.when(_spread(s) > 1e-12, (s["uu"] * s["vw"] - s["uv"] * s["uw"]) / _spread(s))
            .when(s["vv"] > 1e-12, s["vw"] / s["vv"]).otherwise(F.lit(0.0)))
