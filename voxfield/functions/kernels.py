"""Arrow-batched helpers for the few inner loops that Spark's expressions evaluate one element at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .geometry import SPHERE_BINS, sphere_points


def sphere_bin(vx: Column, vy: Column, vz: Column, n: int = SPHERE_BINS) -> Column:
    """Number of the lattice direction nearest to (vx, vy, vz); the lowest number wins a tie.

    The directions have unit length, so the nearest one has the largest dot product. A direction that is zero, missing
    or not finite has no bin: null.
    """
    points = np.array(sphere_points(n)).T

    @F.pandas_udf("int")
    def nearest(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        v = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in (x, y, z)])
        known = np.isfinite(v).all(axis=0) & (v != 0).any(axis=0)
        bins = np.full(len(x), None, dtype=object)
        bins[known] = (v[:, known].T @ points).argmax(axis=1)
        return pd.Series(bins, dtype="Int32")
    return nearest(vx, vy, vz)


def _by_length(lines: pd.Series, work) -> pd.Series:
    """Apply ``work`` to stacked lines of equal length."""
    out = np.empty(len(lines), dtype=object)
    lengths = lines.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i, line in zip(at, work(np.stack([lines.iat[k] for k in at]), at)):
            out[i] = line
    return pd.Series(out)


def lower_envelope(f: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For every line of ``f`` and place i the least f[j] + ((i - j) * step)^2, in time linear in the line.

    The lower envelope of the parabolas is built for all lines in step: each parabola enters every line's stack once and
    leaves it at most once. Infinite values add no parabola.
    """
    lines, n = f.shape
    scale = step * step
    top = np.full(lines, -1)
    place = np.zeros((lines, n), dtype=np.int64)
    begins = np.full((lines, n + 1), np.inf)
    for q in range(n):
        open_ = np.flatnonzero(np.isfinite(f[:, q]))
        while len(open_):
            first = open_[top[open_] < 0]
            top[first], place[first, 0], begins[first, 0] = 0, q, -np.inf
            rest = open_[top[open_] >= 0] if not len(first) else np.setdiff1d(open_, first, assume_unique=True)
            p = place[rest, top[rest]]
            meet = ((f[rest, q] - f[rest, p]) / scale[rest] + q * q - p * p) / (2 * (q - p))
            above = meet <= begins[rest, top[rest]]
            kept = rest[~above]
            top[kept] += 1
            place[kept, top[kept]], begins[kept, top[kept]] = q, meet[~above]
            open_ = rest[above]
            top[open_] -= 1
    begins[np.arange(lines), top + 1] = np.inf
    out, at, row = np.full(f.shape, np.inf), np.zeros(lines, dtype=np.int64), np.flatnonzero(top >= 0)
    for i in range(n):
        late = row[begins[row, at[row] + 1] < i]
        while len(late):
            at[late] += 1
            late = late[begins[late, at[late] + 1] < i]
        j = place[row, at[row]]
        out[row, i] = f[row, j] + scale[row] * (i - j) ** 2
    return out


def squared_distance_pass(line: Column, step: Column, places: Column | None = None, length: Column | None = None,
                          copies: Column | None = None) -> Column:
    """For each position i of a line: min over j of line[j] + ((i - j) * step)^2.

    With ``places`` (ascending) the line lists those of its ``length`` cells only, each ``copies`` times, and all others are
    0; a cell's copies stand side by side.
    """

    @F.pandas_udf("array<double>")
    def along(lines: pd.Series, steps: pd.Series) -> pd.Series:
        spacing = steps.to_numpy()

        return _by_length(lines, lambda block, at: lower_envelope(block, spacing[at]))

    @F.pandas_udf("array<double>")
    def among(lines: pd.Series, steps: pd.Series, places: pd.Series, lengths: pd.Series, copies: pd.Series) -> pd.Series:
        out, spacing, each = np.empty(len(lines), dtype=object), steps.to_numpy(), copies.to_numpy()
        size = lengths.to_numpy() * each
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            counts = np.array([len(lines.iat[k]) for k in at])
            row, ends = np.repeat(np.arange(len(at)), counts), np.cumsum(counts)
            rank = np.arange(len(row)) - np.repeat(ends - counts, counts)
            slot = np.concatenate([places.iat[k] for k in at]) * each[at][row] + rank % each[at][row]
            block = np.zeros((len(at), n))
            block[row, slot] = np.concatenate([lines.iat[k] for k in at])
            found = np.split(lower_envelope(block, spacing[at])[row, slot], ends[:-1])
            for k, part in zip(at, found):
                out[k] = part
        return pd.Series(out)
    return along(line, step) if places is None else among(line, step, places, length, copies)


def gaussian_pass(line: Column, sigma: float, truncate: float = 4.0) -> Column:
    """Normalised Gaussian filter along a line with mirrored edges (edge value repeated)."""
    reach = int(truncate * sigma + 0.5)
    offsets = np.arange(-reach, reach + 1)
    weights = np.exp(-0.5 * (offsets / sigma) ** 2)
    weights = weights / weights.sum()

    @F.pandas_udf("array<double>")
    def along(lines: pd.Series) -> pd.Series:
        def work(block, at):
            n = block.shape[1]
            total = np.zeros(block.shape)
            for offset, weight in zip(offsets, weights):
                fold = np.mod(np.arange(n) + offset, 2 * n)
                total += weight * block[:, np.where(fold < n, fold, 2 * n - 1 - fold)]
            return total
        return _by_length(lines, work)
    return along(line)


def lattice_sums(at: np.ndarray, weighed: np.ndarray, origin: list[float], step: list[float], n: int, radius: float,
                 sharpness: float) -> tuple[list[int], np.ndarray]:
    """Sums of Gaussian weights times ``weighed`` over the lattice points within ``radius`` of each point.

    Returns the first lattice index of the box that the points reach and the sums in that box, last axis as the columns
    of ``weighed``. The kernel is a product over the axes, cut off at the radius.
    """
    low, high = [], []
    for k in range(3):
        place = (at[:, k] - origin[k]) / step[k]
        low.append(np.maximum(0, np.ceil(place - radius / step[k] - 1e-9)).astype(int))
        high.append(np.minimum(n - 1, np.floor(place + radius / step[k] + 1e-9)).astype(int))
    reach = np.logical_and.reduce([a <= b for a, b in zip(low, high)])
    if not reach.any():
        return [0, 0, 0], np.zeros((0, 0, 0, weighed.shape[1]))
    first = [int(a[reach].min()) for a in low]
    total = np.zeros([int(b[reach].max()) - f + 1 for b, f in zip(high, first)] + [weighed.shape[1]])
    scale = -(sharpness / radius) ** 2
    for p in np.flatnonzero(reach):
        gaps = [(origin[k] + np.arange(low[k][p], high[k][p] + 1) * step[k] - at[p, k]) ** 2 for k in range(3)]
        d2 = gaps[0][:, None, None] + gaps[1][:, None] + gaps[2]
        weight = np.where(d2 <= radius * radius, np.exp(scale * d2), 0.0)
        box = tuple(slice(low[k][p] - first[k], high[k][p] + 1 - first[k]) for k in range(3))
        total[box] += weight[..., None] * weighed[p]
    return first, total
