"""Probes, nearest cells, scores and resampled score fields."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import clip, finite
from ..functions.joins import lookup_join
from ..functions.kernels import gaussian_pass, lattice_sums
from ..functions.rng import hash_block, hash_key
from ..functions.quantile import exact_quantiles
from ..functions.store import materialize
from ..schemas import AUDIT_LABELS
from .grid import AXES, box_of_centres, grid_cells
from .stats import reachable_summary
from .survey import along_lines

# Fixed values of the score definitions.
SAFETY_CUTOFF, SAFETY_POWER, DEXTERITY_POWER, SAFETY_GATE = 0.1, 0.8, 1.2, 0.01
DEXTERITY_WEIGHTS = {"g_man": 0.4, "g_iso": 0.15, "g_sigma": 0.15, "g_red": 0.15, "g_rot": 0.15}

PROBE_CHUNK = 1_000


def _selectable(cells: DataFrame, require_reachable: bool) -> DataFrame:
    return cells.filter(F.col("g_ws") > 0.5) if require_reachable else cells


def axis_thresholds(cells: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles of the cell centres per variant, one column per axis and name."""
    axes = (cells.select("variant_id", *[F.col(f"c{a}").alias(a) for a in AXES])
            .unpivot(["variant_id"], list(AXES), "axis", "v"))
    marks = exact_quantiles(axes, ["variant_id", "axis"], "v", probs)
    return marks.groupBy("variant_id").pivot("axis", list(AXES)).agg(*[F.first(p).alias(p) for p in probs])


def quantile_probes(cells: DataFrame, extreme: float = 0.995, central: tuple[float, float] = (0.4, 0.6),
                    require_reachable: bool = True, prefer_counts: bool = True) -> DataFrame:
    """Per variant six extreme probes (largest sample count beyond the axis quantile) and the most manipulable
    cell of the central quantile box, if that holds any. One scan, one row per probe."""
    rows = _selectable(cells, require_reachable)
    marks = axis_thresholds(rows, {"lo": 1 - extreme, "hi": extreme, "mid_lo": central[0], "mid_hi": central[1]})
    rows = lookup_join(rows, materialize(marks, "probe-limits"), ["variant_id"])
    place = F.struct("cx", "cy", "cz", "cell_idx")
    count = F.col("sample_counts") if prefer_counts else F.lit(0)
    pick = lambda ok, rank: F.max_by(F.when(ok, place), F.when(ok, F.struct(rank.alias("a"), (-F.col("cell_idx")).alias("b"))))
    named = []
    for a in AXES:
        named.append((f"{a}_pos_extreme", pick(F.col(f"c{a}") >= F.col(f"{a}_hi"), count)))
        named.append((f"{a}_neg_extreme", pick(F.col(f"c{a}") <= F.col(f"{a}_lo"), count)))
    box = F.lit(True)
    for a in AXES:
        box = box & F.col(f"c{a}").between(F.col(f"{a}_mid_lo"), F.col(f"{a}_mid_hi"))
    named.append(("central_best_man", pick(box, F.col("g_man"))))
    found = rows.groupBy("variant_id").agg(*[c.alias(n) for n, c in named])
    return (found.select("variant_id", F.explode(F.array(*[
                F.struct(F.lit(n).alias("probe"), F.col(n).alias("p")) for n, _ in named])).alias("e"))
            .filter(F.col("e.p").isNotNull())
            .select("variant_id", "e.probe", F.col("e.p.cx").alias("x"), F.col("e.p.cy").alias("y"),
                    F.col("e.p.cz").alias("z"), F.col("e.p.cell_idx").alias("cell_idx")))


def low_margin_probes(cells: DataFrame, k: int = 5, require_reachable: bool = True) -> DataFrame:
    """The k cells of each variant closest to the boundary."""
    rank = F.row_number().over(Window.partitionBy("variant_id").orderBy("g_margin", "cell_idx"))
    return (_selectable(cells, require_reachable).select("variant_id", "cx", "cy", "cz", "cell_idx", "g_margin")
            .withColumn("_r", rank).filter(F.col("_r") <= k)
            .select("variant_id", F.concat(F.lit("low_margin_"), F.col("_r").cast("string")).alias("probe"),
                    F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "cell_idx"))


def select_probes(cells: DataFrame, baseline: str, low_margin_k: int = 5, **options) -> DataFrame:
    """All probes of one baseline variant."""
    rows = cells.filter(F.col("variant_id") == baseline)
    return (quantile_probes(rows, **options).unionByName(low_margin_probes(rows, low_margin_k))
            .select("probe", "x", "y", "z"))


def nearest_cells(cells: DataFrame, grids: DataFrame, probes: DataFrame, max_distance: float = 0.05,
                  chunk: int = PROBE_CHUNK) -> DataFrame:
    """Nearest cell of every variant to every probe; indicators are attached when it is close enough.

    Maps are dense on a regular grid, so the nearest cell follows from arithmetic; the lower cell wins a tie. The
    probes are put into chunks of about ``chunk``, every grid visits every chunk by an equi-join on its number.
    """
    place = F.struct("probe", "x", "y", "z")
    chunks = max(1, -(-probes.count() // chunk))
    spread = probes.select(F.pmod(F.xxhash64("probe", "x", "y", "z"), F.lit(chunks)).alias("_b"), place.alias("_p"))
    visits = grids.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
    targets = visits.join(spread, "_b").drop("_b")
    parts, d2 = [], F.lit(0.0)
    for a in AXES:
        cell = F.ceil((F.col(f"_p.{a}") - F.col(f"bmin_{a}")) / F.col(f"res_{a}")) - 1
        i = F.greatest(F.lit(0), F.least(F.col(f"n{a}") - 1, cell))
        centre = F.col(f"bmin_{a}") + (i + 0.5) * F.col(f"res_{a}")
        parts.append(i)
        d2 = d2 + (F.col(f"_p.{a}") - centre) * (F.col(f"_p.{a}") - centre)
    targets = targets.select(
        "variant_id", F.col("_p.probe").alias("probe"), *[F.col(f"_p.{a}").alias(f"probe_{a}") for a in AXES],
        (parts[0] * F.col("ny") * F.col("nz") + parts[1] * F.col("nz") + parts[2]).cast("bigint").alias("cell_idx"),
        F.sqrt(d2).alias("nearest_dist")).withColumn("matched", F.col("nearest_dist") <= max_distance)
    targets = materialize(targets, "probe-targets")
    wanted = ["cx", "cy", "cz", "g_ws", *AUDIT_LABELS, "sample_counts"]
    found = lookup_join(cells.select("variant_id", "cell_idx", *wanted),
                        targets.select("variant_id", "cell_idx").distinct(), ["variant_id", "cell_idx"], "left_semi")
    joined = targets.join(found, ["variant_id", "cell_idx"], "left")
    return joined.withColumns({c: F.when(F.col("matched"), F.col(c)) for c in wanted})


def viewer_probe(points: DataFrame, xyz: tuple[float, float, float], score: str = "safety",
                 max_distance: float = 0.05, min_score: float = 0.001) -> DataFrame:
    """Closest reachable point of each variant to one position and whether it is near and scored enough."""
    d2 = sum(((F.col(f"c{a}") - F.lit(float(v))) * (F.col(f"c{a}") - F.lit(float(v))) for a, v in zip(AXES, xyz)), F.lit(0.0))
    best = F.min_by(F.struct("cell_idx", score), F.struct(d2, F.col("cell_idx")))
    out = points.groupBy("variant_id").agg(best.alias("_b"), F.sqrt(F.min(d2)).alias("distance"))
    valid = (F.col("distance") < max_distance) & (F.col(f"_b.{score}") > min_score)
    return out.select("variant_id", F.col("_b.cell_idx").alias("cell_idx"), "distance",
                      F.col(f"_b.{score}").alias(score), valid.alias("is_valid"))


def reachable_cells(cells: DataFrame, metric: str | None = None, threshold: float | None = None) -> DataFrame:
    """Cells with g_ws = 1, optionally with a finite metric of at least ``threshold``."""
    kept = cells.filter(F.col("g_ws") == 1.0)
    return kept if metric is None else kept.filter(finite(F.col(metric)) & (F.col(metric) >= F.lit(threshold)))


def normalised(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """Adds n_<metric>: finite non-negative value over the variant's 99th percentile, within [0, 1]."""
    clean = {m: F.when(finite(F.col(m)), F.greatest(F.col(m), F.lit(0.0))).otherwise(F.lit(0.0)) for m in metrics}
    rows = cells.withColumns({f"n_{m}": c for m, c in clean.items()})
    values = rows.select("variant_id", *[F.col(f"n_{m}").alias(m) for m in metrics]).unpivot(
        ["variant_id"], metrics, "metric", "v")
    marks = exact_quantiles(values, ["variant_id", "metric"], "v", {"q99": 0.99})
    wide = materialize(marks.groupBy("variant_id").pivot("metric", metrics).agg(F.first("q99")), "q99")
    wide = wide.select("variant_id", *[F.col(m).alias(f"_q_{m}") for m in metrics])
    out = lookup_join(rows, wide, ["variant_id"])
    return out.withColumns({
        f"n_{m}": F.when(F.col(f"_q_{m}") < 1e-9, F.lit(0.0)).otherwise(clip(F.col(f"n_{m}") / F.col(f"_q_{m}"), 0.0, 1.0))
        for m in metrics}).drop(*[f"_q_{m}" for m in metrics])


def scores(points: DataFrame) -> DataFrame:
    """Adds safety and dexterity to reachable cells."""
    rows = normalised(points, ["g_selfpass", "g_lim", *DEXTERITY_WEIGHTS])
    raw = F.least(F.col("n_g_selfpass"), F.col("n_g_lim"))
    span = 1.0 - SAFETY_CUTOFF
    safety = F.pow(clip((raw - SAFETY_CUTOFF) / span, 0.0, 1.0), F.lit(SAFETY_POWER))
    product = F.lit(1.0)
    for m, w in DEXTERITY_WEIGHTS.items():
        product = product * F.pow(F.col(f"n_{m}"), F.lit(w))
    dexterity = F.pow(F.when(raw > SAFETY_GATE, product).otherwise(F.lit(0.0)), F.lit(DEXTERITY_POWER))
    return rows.withColumns({"safety": safety, "dexterity": dexterity})


def lattices(points: DataFrame, resolution: int = 80, pad: float = 0.05) -> DataFrame:
    """One sampling lattice per variant over the padded box of its points."""
    ends = points.groupBy("variant_id").agg(*[
        fn(f"c{a}").alias(f"{n}_{a}") for a in AXES for n, fn in (("lo", F.min), ("hi", F.max))])
    out = ends.select("variant_id", F.lit(resolution).alias("n"),
                      *[(F.col(f"lo_{a}") - pad).alias(f"o_{a}") for a in AXES],
                      *[((F.col(f"hi_{a}") - F.col(f"lo_{a}") + 2 * pad) / (resolution - 1)).alias(f"h_{a}") for a in AXES])
    return out.withColumn("radius", F.greatest(*[F.col(f"h_{a}") for a in AXES]) * 3.0)


def resampled_field(points: DataFrame, values: list[str], lattice: DataFrame, sharpness: float = 2.0) -> DataFrame:
    """Gaussian-kernel mean of scattered values at the lattice points within the kernel radius of any point.

    The lattice is regular, so each point reaches its lattice neighbours by arithmetic. Points are first brought
    together by place; a task adds up the weights of a batch of them in the box of the lattice that they reach, so that
    one row for each batch and lattice point is shuffled, not one for each point and lattice point. Lattice points
    without a neighbour have no row (their value is 0).
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = points.select("variant_id", "cx", "cy", "cz", *[F.col(v).cast("double").alias(v) for v in values])
    rows = lookup_join(near.repartitionByRange(parts, "variant_id", "cx", "cy"), lattice, ["variant_id"])
    per_variant = ["n", "radius", *[f"{k}_{a}" for k in "oh" for a in AXES]]
    sums = ["_sw", *[f"_s_{v}" for v in values]]

    def run(batches):
        for batch in batches:
            table = pa.table(batch)
            for variant in pc.unique(table["variant_id"]).to_pylist():
                own = table.filter(pc.equal(table["variant_id"], pa.scalar(variant, table["variant_id"].type)))
                at = np.stack([own[f"c{a}"].to_numpy() for a in AXES], axis=1)
                weighed = np.stack([np.ones(len(own)), *[own[v].to_numpy() for v in values]], axis=1)
                box = {c: own[c][0].as_py() for c in per_variant}
                first, total = lattice_sums(at, weighed, [box[f"o_{a}"] for a in AXES], [box[f"h_{a}"] for a in AXES],
                                            box["n"], box["radius"], sharpness)
                place = np.nonzero(total[..., 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([variant] * len(place[0]), table["variant_id"].type),
                     *[pa.array((p + f).astype("int32")) for p, f in zip(place, first)],
                     *[pa.array(total[..., k][place]) for k in range(len(sums))]],
                    names=["variant_id", "ix", "iy", "iz", *sums])
    partial = rows.select("variant_id", "cx", "cy", "cz", *values, *per_variant).mapInArrow(
        run, f"variant_id {points.schema['variant_id'].dataType.simpleString()}, ix int, iy int, iz int, "
             + ", ".join(f"{c} double" for c in sums))
    out = partial.groupBy("variant_id", "ix", "iy", "iz").agg(*[F.sum(c).alias(c) for c in sums])
    return out.select("variant_id", "ix", "iy", "iz", *[(F.col(f"_s_{v}") / F.col("_sw")).alias(v) for v in values])


def dense_lattice(field: DataFrame, lattice: DataFrame, values: list[str]) -> DataFrame:
    """Every lattice point, 0 where the field has no row."""
    grid = lattice.select("variant_id", *[F.col(f"o_{a}").alias(f"bmin_{a}") for a in AXES],
                          *[F.col(f"h_{a}").alias(f"res_{a}") for a in AXES], *[F.col("n").alias(f"n{a}") for a in AXES])
    points = grid_cells(grid).select("variant_id", "ix", "iy", "iz")
    return points.join(field, ["variant_id", "ix", "iy", "iz"], "left").fillna(0.0, values)


def smoothed_field(field: DataFrame, value: str, sigma: float = 1.5) -> DataFrame:
    """Gaussian filter of a dense lattice in three separable passes along grid lines."""
    out = field.select("variant_id", "ix", "iy", "iz", value)
    for axis in AXES:
        out = along_lines(out, axis, value, lambda line: gaussian_pass(line, sigma), [])
    return out


def nearest_plane(at: Column, origin: Column, step: Column, n: Column) -> Column:
    """Lattice index along an axis nearest to a coordinate."""
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((at - origin) / step + 0.5))).cast("int")


def axis_slice(field: DataFrame, planes: DataFrame, axis: str, value: str, min_value: float = 0.001) -> DataFrame:
    """Points of one lattice plane per variant (``planes``: variant_id, plane) scored above a minimum."""
    return (lookup_join(field, planes.select("variant_id", "plane"), ["variant_id"])
            .filter((F.col(f"i{axis}") == F.col("plane")) & (F.col(value) > min_value)).drop("plane"))


def plane_projection(cells: DataFrame, indicator: str) -> DataFrame:
    """Planar position and indicator of every cell."""
    return cells.select("variant_id", "cell_idx", "cx", "cy", F.col(indicator).alias("value"))


def ratio_field(cells: DataFrame, numerator: str = "g_self_qstar", denominator: str = "g_self",
                out: str = "ratio") -> DataFrame:
    """numerator / (denominator + 1e-6) when both columns exist, else the cells unchanged."""
    if numerator not in cells.columns or denominator not in cells.columns:
        return cells
    return cells.withColumn(out, F.col(numerator) / (F.col(denominator) + 1e-6))


def downsample(points: DataFrame, rate: int, seed: int = 0) -> DataFrame:
    """About one point in ``rate``, chosen by a hash of its key."""
    return points.filter(hash_block(hash_key(seed, F.col("variant_id"), F.col("cell_idx")), 8) % rate == 0)


class Audit(NamedTuple):
    overall: DataFrame
    probes: DataFrame
    documents: DataFrame


def family_audit(cells: DataFrame, grids: DataFrame, baseline: str, pattern: str = ".*", low_margin_k: int = 5,
                 max_distance: float = 0.05) -> Audit:
    """Global summary, probe comparison and summary document of every variant whose id matches.

    Probes are taken from the baseline. A document holds what the audit was run with and the variant's coverage, cells
    and box.
    """
    chosen = cells.filter(F.col("variant_id").rlike(pattern))
    overall = box_of_centres(chosen).join(reachable_summary(chosen).drop("n_cells"), "variant_id")
    probes = materialize(select_probes(cells, baseline, low_margin_k), "probes")
    documents = overall.select(
        "variant_id", F.lit(baseline).alias("baseline"), F.lit(probes.count()).cast("bigint").alias("probe_count"),
        F.lit(max_distance).alias("max_match_dist_m"), "coverage", "n_cells", "n_reachable",
        F.array(*[F.col(f"span_{a}") for a in AXES]).alias("span"), "aabb_volume")
    matched = nearest_cells(chosen, grids.filter(F.col("variant_id").rlike(pattern)), probes, max_distance)
    return Audit(overall, matched, documents)
