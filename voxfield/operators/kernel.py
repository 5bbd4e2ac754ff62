"""Chain poses: the one Arrow-batched numeric pass.

Spark cuts the samples of every variant into blocks and draws the joint vectors; a task turns all blocks of chains of one
shape into poses, link positions and singular values with a few stacked matrix products per joint. A block carries its
chain once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import SPHERE_BINS, sphere_points
from ..functions.rng import draw, stream
from .features import link_walk
from .specs import SPEC_RADIUS_SCALE, actuated_order, first_of, places

BLOCK_SAMPLES = 512
DEFAULT_RADIUS = 0.02
ZERO_COLUMN = 1e-6
#: Values (positions, joints and pairs of the samples) that a task holds at once in the pass over its blocks.
PASS_VALUES = 1 << 18
STEP = ("child", "parent", "axis_no", "kind")
BLOCK = ("variant_id", "sample_ids", "qs", "steps", "n_links", "end_link", "limits")

POSE_SCHEMA = ("variant_id string, sample_id bigint, q array<double>, x double, y double, z double, "
               "qx double, qy double, qz double, qw double, sphere_bin int, "
               "link_x array<double>, link_y array<double>, link_z array<double>, "
               "sigmas array<double>, n_rows int, n_cols int, jacobian array<double>, clearance double")


class Shape(NamedTuple):
    """What chains that are walked together have in common: links, number of moving joints, and (child, parent, number of
    the joint, kind) of every step."""
    n_links: int
    end_link: int
    moving: int
    steps: tuple[tuple[int, ...], ...]


class Pairs(NamedTuple):
    """Segment pairs of chains: the four links of each (chains, pairs), its reach and the number of pairs of a chain."""
    links: list[np.ndarray]
    reach: np.ndarray
    count: np.ndarray


def chains(specs: DataFrame) -> DataFrame:
    """One row per spec with what the pass needs: joints in walk order, limits of the moving ones, link radii.

    Links are numbered in walk order from the base (0); joints that the base does not reach are left out.
    """
    flat = actuated_order(specs).select(
        F.col("meta.variant_id").alias("variant_id"), F.col("chain.links").alias("links"),
        F.col("chain.joints").alias("joints"), F.col("meta.base_link").alias("base_link"),
        F.col("meta.ee_link").alias("ee_link"), "ordered",
        F.transform("ordered", lambda j: j["name"]).alias("actuated_joint_names"))
    df = link_walk(flat).withColumn("_order", F.transform("_walk", lambda w: w["name"]))
    placed = F.transform("_joints", lambda j: F.struct(places("_order", j["child_link"], j["parent_link"]).alias("at"), j.alias("j")))
    used = F.filter(placed, lambda s: (s["at"][0] >= 0) & (s["at"][1] >= 0))
    kind = lambda j: F.when(j["type"].isin("revolute", "continuous"), 1).when(j["type"] == "prismatic", 2).otherwise(0)
    steps = F.sort_array(F.transform(used, lambda s: F.struct(
        s["at"][0].alias("child"), s["at"][1].alias("parent"), places("actuated_joint_names", s["j"]["name"])[0].alias("axis_no"),
        kind(s["j"]).alias("kind"), *[s["j"][f].alias(n) for f, n in (("origin_xyz", "xyz"), ("origin_rpy", "rpy"), ("axis", "axis"))])))
    radius = lambda name: first_of(F.filter("_links", lambda l: l["name"] == name))["radius"]
    end = F.array_position("_order", F.col("ee_link"))
    return df.select(
        "variant_id", steps.alias("steps"),
        F.when(end > 0, end - 1).otherwise(F.size("_order") - 1).cast("int").alias("end_link"),
        F.size("_order").alias("n_links"),
        F.transform("ordered", lambda j: F.struct(j["limit_lower"].alias("lo"), j["limit_upper"].alias("hi"))).alias("limits"),
        F.transform("_order", lambda n: F.coalesce(radius(n) * SPEC_RADIUS_SCALE, F.lit(DEFAULT_RADIUS))).alias("radii"),
        F.col("_order").alias("link_names"))


def sample_blocks(chain_rows: DataFrame, n_samples: int, seed: int, block: int = BLOCK_SAMPLES,
                  first: int = 1) -> DataFrame:
    """Blocks of uniform joint vectors for samples ``first`` .. ``first + n_samples - 1`` of every chain.

    A draw depends on (seed, variant, sample, joint) alone, so rounds of samples add up to one pass over all of them.
    """
    parts = int(chain_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = first + n_samples - 1
    blocks = (chain_rows.withColumn("_stream", stream(seed, F.col("variant_id"))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((n_samples - 1) // block))))
              .repartition(parts, "variant_id", "_b"))
    ids = F.sequence(F.lit(first) + F.col("_b") * block, F.least(F.lit(last), F.lit(first - 1) + (F.col("_b") + 1) * block))
    one = lambda s: F.transform("limits", lambda lim, j: lim["lo"] + draw(F.col("_stream"), s, j) * (lim["hi"] - lim["lo"]))
    return blocks.withColumn("sample_ids", F.transform(ids, lambda s: s.cast("bigint"))).withColumn(
        "qs", F.transform("sample_ids", one)).drop("_b", "_stream")


def _euler(rpy: np.ndarray) -> np.ndarray:
    """Rotations for fixed-axis roll, pitch, yaw (n, 3)."""
    (cr, cp, cy), (sr, sp, sy) = np.cos(rpy).T, np.sin(rpy).T
    return np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
                     [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
                     [-sp, cp * sr, cp * cr]]).transpose(2, 0, 1)


def _about(axis: np.ndarray, of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rotations by the vectors ``axis[of] * value``; an axis need not have unit length, one of length 0 turns nothing."""
    size = np.linalg.norm(axis, axis=1)
    x, y, z = (axis / np.where(size == 0, 1.0, size)[:, None]).T
    none = np.zeros(len(axis))
    cross = np.array([[none, -z, y], [z, none, -x], [-y, x, none]]).transpose(2, 0, 1)
    angle = np.where(size[of] == 0, 0.0, values * size[of])[:, None, None]
    return np.eye(3) + np.sin(angle) * cross[of] + (1 - np.cos(angle)) * (cross @ cross)[of]


def _quaternions(r: np.ndarray) -> np.ndarray:
    """(x, y, z, w) of rotation matrices, from the largest of the four components."""
    trace = np.trace(r, axis1=1, axis2=2)
    diagonal = np.concatenate([np.diagonal(r, axis1=1, axis2=2), trace[:, None]], axis=1)
    pick = diagonal.argmax(axis=1)
    q = np.empty((len(r), 4))
    for i in range(3):
        at = pick == i
        j, k = (i + 1) % 3, (i + 2) % 3
        m = r[at]
        q[at, i] = 1 - trace[at] + 2 * m[:, i, i]
        q[at, j] = m[:, j, i] + m[:, i, j]
        q[at, k] = m[:, k, i] + m[:, i, k]
        q[at, 3] = m[:, k, j] - m[:, j, k]
    at = pick == 3
    m = r[at]
    q[at] = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1], 1 + trace[at]], axis=1)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def _turn(rotations: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (rotations @ vectors[:, :, None])[:, :, 0]


def chain_walk(shape: Shape, xyz: np.ndarray, rpy: np.ndarray, axis: np.ndarray, of: np.ndarray, q: np.ndarray):
    """Link positions (n, links, 3), end rotation (n, 3, 3) and the moving axes (number, kind, direction, place).

    ``xyz``, ``rpy`` and ``axis`` (chains, steps, 3) are those of chains of one shape, ``of`` (n) tells the chain of each
    joint vector.
    """
    n = len(q)
    rotation = {0: np.broadcast_to(np.eye(3), (n, 3, 3))}
    position = np.zeros((n, shape.n_links, 3))
    axes = []
    for k, (child, above, number, kind) in enumerate(shape.steps):
        place = position[:, above] + _turn(rotation[above], xyz[of, k])
        turned = rotation[above] @ _euler(rpy[:, k])[of]
        if number >= 0 and kind:
            direction = _turn(turned, axis[of, k])
            axes.append((number, kind, direction, place))
            if kind == 2:
                place = place + direction * q[:, number:number + 1]
            else:
                turned = turned @ _about(axis[:, k], of, q[:, number])
        position[:, child], rotation[child] = place, turned
    return position, rotation[shape.end_link], axes


def jacobian_of(axes: list, at_end: np.ndarray, moving: int, rows: np.ndarray) -> np.ndarray:
    """Jacobian (rows, 6, moving) of the samples at ``rows``."""
    jacobian = np.zeros((len(rows), 6, moving))
    for number, kind, direction, place in axes:
        if kind == 1:
            jacobian[:, :3, number] = np.cross(direction[rows], at_end[rows] - place[rows])
            jacobian[:, 3:, number] = direction[rows]
        else:
            jacobian[:, :3, number] = direction[rows]
    return jacobian


def chain_poses(steps: list[dict], n_links: int, end_link: int, q: np.ndarray):
    """Link positions (n, links, 3), end rotation (n, 3, 3) and Jacobian (n, 6, moving) of joint vectors ``q``."""
    shape = Shape(n_links, end_link, q.shape[1], tuple(tuple(s[c] for c in STEP) for s in steps))
    parts = [np.array([[s[c] for s in steps]], dtype=float).reshape(1, len(steps), 3) for c in ("xyz", "rpy", "axis")]
    position, end, axes = chain_walk(shape, *parts, np.zeros(len(q), dtype=int), q)
    return position, end, jacobian_of(axes, position[:, end_link], q.shape[1], np.arange(len(q)))


def singular_values(jacobian: np.ndarray) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """Singular values per matrix without its zero columns; the linear rows only when fewer than six columns remain.

    Matrices with the same columns are decomposed together, and all values are laid out in one buffer.
    """
    used = np.linalg.norm(jacobian, axis=1) > ZERO_COLUMN
    n_cols = used.sum(axis=1).astype("int32")
    n_rows = np.where(n_cols < 6, 3, 6).astype("int32")
    offsets = np.concatenate([[0], np.cumsum(np.minimum(n_rows, n_cols))]).astype("int32")
    flat = np.empty(offsets[-1])
    for mask in np.unique(used, axis=0):
        if mask.any():
            at = np.flatnonzero((used == mask).all(axis=1))
            found = np.linalg.svd(jacobian[at][:, :3 if mask.sum() < 6 else 6][:, :, mask], compute_uv=False)
            flat[offsets[at][:, None] + np.arange(found.shape[1])] = found
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), n_rows, n_cols


def smallest_gap(position: np.ndarray, pairs: Pairs, of: np.ndarray) -> np.ndarray:
    """Smallest surface distance over the segment pairs of each sample's chain, at least 0; NaN without pairs.

    The same closest points as ``functions.geometry.segment_distances``, for all samples at once.
    """
    if not pairs.reach.shape[1]:
        return np.full(len(position), np.nan)
    rows = np.arange(len(position))[:, None]
    a0, a1, b0, b1 = (position[rows, links[of]] for links in pairs.links)
    u, v, w = a1 - a0, b1 - b0, a0 - b0
    uu, uv, vv, uw, vw = ((x * y).sum(axis=2) for x, y in ((u, u), (u, v), (v, v), (u, w), (v, w)))
    spread = uu * vv - uv * uv
    skew = spread > 1e-12
    safe = np.where(skew, spread, 1.0)
    along = np.where(vv > 1e-12, vw / np.where(vv > 1e-12, vv, 1.0), 0.0)
    s = np.clip(np.where(skew, (uv * vw - vv * uw) / safe, 0.0), 0.0, 1.0)
    t = np.clip(np.where(skew, (uu * vw - uv * uw) / safe, along), 0.0, 1.0)
    gaps = np.linalg.norm(w + s[:, :, None] * u - t[:, :, None] * v, axis=2) - pairs.reach[of]
    return np.where(pairs.count[of] > 0, np.maximum(gaps.min(axis=1), 0.0), np.nan)


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype="int32") * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _shapes(batch: pa.RecordBatch) -> list[tuple[Shape, np.ndarray]]:
    """The shapes of a batch of blocks, each with the rows that have it."""
    steps = batch["steps"].flatten()
    codes = np.stack([_numbers(steps.field(c)) for c in STEP], axis=1).astype("int64")
    ends = np.cumsum(_lengths(batch["steps"]))
    moving = _lengths(batch["limits"])
    found: dict[tuple, list[int]] = {}
    for row, (end, start, *rest) in enumerate(zip(ends, np.r_[0, ends[:-1]] if len(ends) else [], _numbers(batch["n_links"]),
                                                  _numbers(batch["end_link"]), moving)):
        found.setdefault((*map(int, rest), codes[start:end].tobytes()), []).append(row)
    return [(Shape(*key[:3], tuple(map(tuple, np.frombuffer(key[3], "int64").reshape(-1, len(STEP)).tolist()))), np.array(rows))
            for key, rows in found.items()]


def _passes(batch: pa.RecordBatch):
    """(shape, blocks, chain of each sample, joint vectors): blocks of one shape that are walked together, of about
    ``PASS_VALUES`` values or one block."""
    samples = _lengths(batch["sample_ids"])
    width = _lengths(batch["pairs"]) if "pairs" in batch.schema.names else np.zeros(len(samples), dtype=int)
    for shape, rows in _shapes(batch):
        cost = np.cumsum(samples[rows] * (shape.n_links + shape.moving + np.max(width[rows])))
        for part in np.split(rows, np.flatnonzero(np.diff(cost // PASS_VALUES)) + 1):
            blocks = batch.take(pa.array(part))
            of = np.repeat(np.arange(len(part)), samples[part])
            yield shape, blocks, of, _numbers(blocks["qs"].flatten().flatten()).reshape(len(of), shape.moving)


def _walked(shape: Shape, blocks: pa.RecordBatch, of: np.ndarray, q: np.ndarray):
    steps = blocks["steps"].flatten()
    parts = [_numbers(steps.field(c).flatten()).astype(float).reshape(blocks.num_rows, len(shape.steps), 3) for c in ("xyz", "rpy", "axis")]
    return chain_walk(shape, *parts, of, q)


def _pairs(blocks: pa.RecordBatch) -> Pairs:
    """The segment pairs of blocks, filled up to equal numbers with pairs at the base that are infinitely far apart."""
    count = _lengths(blocks["pairs"])
    flat = blocks["pairs"].flatten()
    at = np.repeat(np.arange(len(count)), count), _runs(count)
    links = []
    for c in ("a0", "a1", "b0", "b1"):
        links.append(np.zeros((len(count), count.max(initial=0)), dtype=int))
        links[-1][at] = _numbers(flat.field(c))
    reach = np.full(links[0].shape, -np.inf)
    reach[at] = _numbers(flat.field("reach"))
    return Pairs(links, reach, count)


def _inside(at_end: np.ndarray, grid: pa.StructArray, of: np.ndarray) -> np.ndarray:
    """Whether positions lie in a cell of their chain's grid; written like the cell test of ``grid.assign_cells``."""
    ok = np.isfinite(at_end).all(axis=1)
    for k, a in enumerate("xyz"):
        low, size, count = (_numbers(grid.field(f"{n}{a}"))[of] for n in ("bmin_", "res_", "n"))
        cell = np.floor((at_end[:, k] - low) / size)
        ok &= (cell >= 0) & (cell < count)
    return ok


def _take_lists(lists: pa.ListArray, count: int, at: np.ndarray) -> pa.Array:
    """Lists at the given places of ``count`` rows, null elsewhere."""
    index = np.full(count, -1)
    index[at] = np.arange(len(at))
    return lists.take(pa.array(index, mask=index < 0))


def positions(blocks: DataFrame) -> DataFrame:
    """End positions only, for scouting: no Jacobian, singular values, directions or clearance."""
    def run(batches):
        for batch in batches:
            for shape, part, of, q in _passes(batch):
                position, _, _ = _walked(shape, part, of, q)
                at_end = position[:, shape.end_link]
                yield pa.RecordBatch.from_arrays(
                    [part["variant_id"].take(pa.array(of)), part["sample_ids"].flatten(), *[pa.array(at_end[:, i]) for i in range(3)]],
                    names=["variant_id", "sample_id", "x", "y", "z"])
    return blocks.select(*BLOCK).mapInArrow(run, "variant_id string, sample_id bigint, x double, y double, z double")


def pose_samples(blocks: DataFrame, with_jacobian: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per sample: end pose, direction bin, link positions and singular values; ``only`` these columns.

    Blocks of chains of one shape are walked together, so that a few samples of many chains cost no more than many of one.

    Blocks that carry the segment ``pairs`` of their chain also get the clearance of every sample. Blocks that carry a
    ``grid`` yield the samples inside it only, and the singular values and the direction of those with a positive
    clearance only (null for the others): every stage works on what the one before it left.
    """
    with_pairs, with_grid = "pairs" in blocks.columns, "grid" in blocks.columns
    sphere = np.array(sphere_points(SPHERE_BINS)).T
    fields = [c for c in POSE_SCHEMA.split(", ") if only is None or c.split(" ")[0] in only]
    columns = [c.split(" ")[0] for c in fields]
    with_values = not {"sigmas", "n_rows", "n_cols", "jacobian"}.isdisjoint(columns)

    def run(batches):
        for batch in batches:
            for shape, part, of, q in _passes(batch):
                ids = _numbers(part["sample_ids"].flatten())
                position, end, axes = _walked(shape, part, of, q)
                if with_grid:
                    inside = np.flatnonzero(_inside(position[:, shape.end_link], part["grid"], of))
                    if not len(inside):
                        continue
                    ids, of, q, position, end = ids[inside], of[inside], q[inside], position[inside], end[inside]
                    axes = [(*axis[:2], axis[2][inside], axis[3][inside]) for axis in axes]
                at_end = position[:, shape.end_link]
                gaps = smallest_gap(position, _pairs(part), of) if with_pairs else np.full(len(ids), np.nan)
                scored = np.flatnonzero(~(gaps <= 0)) if with_grid else np.arange(len(ids))
                made = {"variant_id": lambda: part["variant_id"].take(pa.array(of)), "sample_id": lambda: pa.array(ids),
                        "q": lambda: _lists(q), "clearance": lambda: pa.array(gaps)}
                for i, a in enumerate("xyz"):
                    made[a] = lambda i=i: pa.array(at_end[:, i])
                    made[f"link_{a}"] = lambda i=i: _lists(np.ascontiguousarray(position[:, :, i]))
                if with_values:
                    jacobian = jacobian_of(axes, at_end, shape.moving, scored)
                    values, n_rows, n_cols = singular_values(jacobian)
                    flat = jacobian.reshape(len(scored), -1) if with_jacobian else np.empty((len(scored), 0))
                    spread = lambda values: _take_lists(values, len(ids), scored)
                    made |= {"sigmas": lambda: spread(values), "n_rows": lambda: spread(pa.array(n_rows)),
                             "n_cols": lambda: spread(pa.array(n_cols)), "jacobian": lambda: spread(_lists(flat))}
                if "sphere_bin" in columns:
                    known = scored[np.isfinite(end[scored]).all(axis=(1, 2))]
                    bins = np.full(len(ids), -1)
                    bins[known] = (end[known][:, :, 2] @ sphere).argmax(axis=1)
                    made["sphere_bin"] = lambda: pa.array(bins.astype("int32"), mask=bins < 0)
                if not {"qx", "qy", "qz", "qw"}.isdisjoint(columns):
                    quat = _quaternions(end)
                    made |= {c: lambda i=i: pa.array(quat[:, i]) for i, c in enumerate(("qx", "qy", "qz", "qw"))}
                yield pa.RecordBatch.from_arrays([made[c]() for c in columns], names=columns)
    carried = [c for c in ("pairs", "grid") if c in blocks.columns]
    return blocks.select(*BLOCK, *carried).mapInArrow(run, ", ".join(fields))


def link_points(poses: DataFrame) -> DataFrame:
    """Link positions as an array of points in walk order."""
    points = F.transform(F.arrays_zip("link_x", "link_y", "link_z"), lambda p: F.struct(
        p["link_x"].alias("x"), p["link_y"].alias("y"), p["link_z"].alias("z")))
    return poses.withColumn("points", points).drop("link_x", "link_y", "link_z")

