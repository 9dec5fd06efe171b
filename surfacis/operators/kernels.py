"""NumPy kernels over the atoms of many structures or tiles at a time: neighbours, free sphere points, areas by slices."""

from __future__ import annotations

import math

import numpy as np

#: Pairs, or pairs times points or slices, that a kernel holds at a time (an atom's own are never parted).
BLOCK = 1 << 19
_NONE = np.zeros(0, np.int64)


def near_pairs(xyz: np.ndarray, r: np.ndarray, group: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs of atoms of one group whose spheres of radii r meet, sorted by the first. group: ascending numbers; own: which atoms may stand first. Atoms whose place or radius is no number have no pairs."""
    at = np.flatnonzero(np.isfinite(xyz).all(1) & ~np.isnan(r))
    if len(at) < 2:
        return _NONE, _NONE
    p, q = xyz[at], r[at]
    of = np.zeros(len(at), np.int64) if group is None else np.unique(group[at], return_inverse=True)[1]
    low = np.minimum.reduceat(p, np.flatnonzero(np.diff(of, prepend=-1)), axis=0)
    width, span = 2.000002 * (np.abs(q).max() or 1.0), None
    while span is None or math.prod(int(s) for s in span) * (int(of[-1]) + 1) > 1 << 62:
        scaled, width = (p - low[of]) / width, 2 * width
        span = np.floor(scaled.max(0)) + 3
    cell = np.floor(scaled).astype(np.int64) + 1
    span = span.astype(np.int64)
    code = ((of * span[0] + cell[:, 0]) * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(code, kind="stable")
    code, p, q, at = code[order], p[order], q[order], at[order]
    out, here = [], np.arange(len(code))
    # Half of the cells around one, so that each pair meets once: cells that follow each other in z are one stretch of the sorted numbers.
    for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
        other = code + (a * span[1] + b) * span[2]
        first = here + 1 if (a, b) == (0, 0) else np.searchsorted(code, other - 1)
        n = np.searchsorted(code, other + 1, "right") - first
        for s, e in _stretches(np.cumsum(n), BLOCK):
            m = n[s:e]
            i = np.repeat(here[s:e], m)
            j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[s:e], m)
            d, reach = p[i] - p[j], q[i] + q[j]
            near = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] < reach * reach
            out.append((at[i[near]], at[j[near]]))
    i, j = (np.concatenate([x[k] for x in out]) for k in (0, 1))
    i, j = np.concatenate((i, j)), np.concatenate((j, i))
    if own is not None:
        i, j = i[own[i]], j[own[i]]
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def _stretches(done: np.ndarray, most: int):
    """Stretches start, end of rows whose numbers, of which done are the running sums, add up to most at the most, or of one row that has more."""
    a, before = 0, 0
    while a < len(done):
        b = max(a + 1, int(np.searchsorted(done, before + most, "right")))
        yield a, b
        a, before = b, int(done[b - 1])


def _by_atom(i: np.ndarray, n: int, most: int):
    """Stretches of pairs, sorted by i, that hold all pairs of their atoms."""
    ends = np.searchsorted(i, np.arange(n), "right")
    for a, b in _stretches(ends, most):
        s, e = int(ends[a - 1]) if a else 0, int(ends[b - 1])
        if s < e:
            yield s, e


def exposed_points(xyz: np.ndarray, r: np.ndarray, points: np.ndarray, side: np.ndarray | None = None, group: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """Number of points on each widened sphere that no other sphere of its group holds (strictly inside). With sides, two columns: what no sphere of its own side holds, and what none holds, from one test of each point.

    A point p of i lies in j if 2 r_i p (j - i) > |j - i|^2 + r_i^2 - r_j^2, one product of matrices for all pairs and points. What lies within rounding of
    the border is told by the distance itself, so counts are those of the plain test.
    """
    i, j = near_pairs(xyz, r, group, own)
    n, out = len(points), np.full((len(r), 1 if side is None else 2), len(points))
    if not len(i):
        return out if side is not None else out[:, 0]
    high = np.concatenate((points.T, np.ones((1, n)))).astype(r.dtype)
    for s, e in _by_atom(i, len(r), max(1, BLOCK // n)):
        ii, jj = i[s:e], j[s:e]
        d, ri, rj = xyz[jj] - xyz[ii], r[ii], r[jj]
        with np.errstate(invalid="ignore", over="ignore"):
            gap = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] + ri * ri - rj * rj
            depth = np.concatenate((2 * ri[:, None] * d, -gap[:, None]), axis=1) @ high
            border = 500 * np.finfo(r.dtype).eps * (max(np.abs(xyz[ii]).max(), np.abs(xyz[jj]).max()) + 2 * max(np.abs(ri).max(), np.abs(rj).max())) ** 2
            inside, outside = depth > border, depth < -border
            if np.count_nonzero(inside) + np.count_nonzero(outside) < inside.size:
                row, k = np.nonzero(~(inside | outside))
                d2 = np.zeros(len(row), r.dtype)
                for c in range(3):
                    t = xyz[ii[row], c] + ri[row] * points[k, c] - xyz[jj[row], c]
                    d2 += t * t
                inside[row, k] = d2 < rj[row] * rj[row]
        first = np.flatnonzero(np.diff(ii, prepend=-1))
        free = lambda held: n - np.bitwise_count(np.bitwise_or.reduceat(np.packbits(held, axis=1), first, axis=0)).sum(1, dtype=np.int64)
        out[ii[first], -1] = free(inside)
        if side is not None:
            out[ii[first], 0] = free(inside & (side[ii] == side[jj])[:, None])
    return out if side is not None else out[:, 0]


def slice_areas(xyz: np.ndarray, r: np.ndarray, n_slices: int, group: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """Exposed area of each widened sphere, summed over slices across z; the arcs of a circle that neighbours cover are united by a running maximum."""
    i, j = near_pairs(xyz, r, group, own)
    full, covered = 2 * math.pi, np.zeros(len(r), r.dtype)
    for s, e in _by_atom(i, len(r), max(1, BLOCK // (4 * n_slices))):
        ii, jj = i[s:e], j[s:e]
        dx, dy = xyz[jj, 0] - xyz[ii, 0], xyz[jj, 1] - xyz[ii, 1]
        dist, mid = np.sqrt(dx * dx + dy * dy), np.arctan2(dy, dx) + math.pi
        ri, z, zj, rj = r[ii, None], xyz[ii, 2, None], xyz[jj, 2, None], r[jj, None]
        height = z - ri + 2 * ri / n_slices * (np.arange(n_slices) + 0.5).astype(r.dtype)
        own_, other = np.sqrt(np.maximum(0, ri * ri - (height - z) ** 2)), rj * rj - (height - zj) ** 2
        met = other > 0
        other = np.sqrt(np.where(met, other, 0))
        row, k = np.nonzero(met & (dist[:, None] < own_ + other))
        own_, other, dist, mid = own_[row, k], other[row, k], dist[row], mid[row]
        same = dist < 1e-10
        holds = np.where(same, other > own_, dist + own_ <= other)
        with np.errstate(divide="ignore", invalid="ignore"):
            half = np.arccos(np.clip((own_ * own_ + dist * dist - other * other) / (2 * own_ * dist), -1, 1))
        low, high = mid - half, mid + half
        low, high = np.where(holds, 0, np.where(low < 0, low + full, low)), np.where(holds, full, np.where(high > full, high - full, high))
        keep = holds | (~same & (dist + other > own_))
        low, high, circle = low[keep], high[keep], (ii[row] * n_slices + k)[keep]
        over = low > high
        low, circle = np.concatenate((low, np.zeros(over.sum(), low.dtype))), np.concatenate((circle, circle[over]))
        high = np.concatenate((np.where(over, full, high), high[over]))
        if not len(low):
            continue
        order = np.lexsort((low, circle))
        low, high, circle = low[order], high[order], circle[order]
        # The largest end before each arc in its circle: ends as ranks, so that a later circle's are larger, and their running maximum.
        by_end = np.argsort(high, kind="stable")
        rank = np.empty(len(high), np.int64)
        rank[by_end] = np.arange(len(high))
        starts = np.diff(circle, prepend=-1) != 0
        rank += (np.cumsum(starts) - 1) * len(high)
        before = high[by_end[np.maximum.accumulate(rank) % len(high)]]
        before = np.where(starts, 0, np.concatenate(([0], before[:-1])))
        new = np.maximum(0, high - np.maximum(low, before))
        part = np.bincount(circle // n_slices - ii[0], new)
        covered[ii[0] : ii[0] + len(part)] += part.astype(r.dtype)
    return np.maximum(0, 4 * math.pi * r * r - 2 * r / n_slices * r * covered)
