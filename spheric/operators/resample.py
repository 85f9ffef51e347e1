"""Linear and cubic resampling of a patch's scattered samples by a triangulation, one group for each map: for patches that fit a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spheric import ship

CORNERS = np.array([[0, 1], [1, 2], [2, 0]])


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles by adding points one by one (Bowyer 1981, Watson 1981): triangles whose circle holds a new point give way to those of their rim with it.

    Points are added from left to right, so a triangle whose circle ends before the new point is done and looked at no more.
    """
    n = len(points)
    centre, size = points.mean(0), max(np.ptp(points, axis=0).max(), 1e-9) * 50
    every = np.vstack([points, centre + size * np.array([[-1.0, -1.0], [1.0, -1.0], [0.0, 1.5]])])
    triangles = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> np.ndarray:
        a, b, c = every[t[:, 0]], every[t[:, 1]], every[t[:, 2]]
        u, v = b - a, c - a
        d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        uu, vv = (u * u).sum(1), (v * v).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = (v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d
        return np.column_stack([a[:, 0] + x, a[:, 1] + y, x * x + y * y])

    held, done = circles(triangles), []
    for i in np.lexsort((points[:, 1], points[:, 0])):
        off = every[i] - held[:, :2]
        past = (off[:, 0] > 0) & (off[:, 0] ** 2 > held[:, 2] * (1 + 1e-9))
        bad = ~past & ((off * off).sum(1) < held[:, 2] * (1 + 1e-12))
        edges = triangles[bad][:, CORNERS].reshape(-1, 2)
        _, first, counts = np.unique(np.sort(edges, 1), axis=0, return_index=True, return_counts=True)
        rim = edges[first[counts == 1]]
        new = np.column_stack([rim, np.full(len(rim), i)])
        done.append(triangles[past])
        keep = ~bad & ~past
        triangles, held = np.vstack([triangles[keep], new]), np.vstack([held[keep], circles(new)])
    triangles = np.vstack([*done, triangles])
    return triangles[(triangles < n).all(1)]


def slopes(points: np.ndarray, values: np.ndarray, triangles: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """The gradient at each point for which cubics along all edges bend least (Nielson 1983): the bending's minimum, by conjugate gradients on its normal equations, a 2 by 2 block for each point and each edge."""
    edges = np.unique(np.sort(triangles[:, CORNERS].reshape(-1, 2), 1), axis=0)
    i, j = edges.T
    e = points[j] - points[i]
    weight = (e * e).sum(1) ** -1.5
    rise = values[j] - values[i]

    def gathered(at_i: np.ndarray, at_j: np.ndarray) -> np.ndarray:
        out = np.zeros_like(points)
        for axis in (0, 1):
            out[:, axis] = np.bincount(i, at_i * e[:, axis], len(points)) + np.bincount(j, at_j * e[:, axis], len(points))
        return out

    def applied(g: np.ndarray) -> np.ndarray:
        gi, gj = (g[i] * e).sum(1), (g[j] * e).sum(1)
        return gathered(weight * (2 * gi + gj), weight * (gi + 2 * gj))

    g = np.zeros_like(points)
    rest = gathered(3 * weight * rise, 3 * weight * rise)
    way, left = rest.copy(), (rest * rest).sum()
    goal = left * tolerance**2
    for _ in range(20 * len(points)):
        if left <= goal:
            break
        turned = applied(way)
        step = left / (way * turned).sum()
        g, rest = g + step * way, rest - step * turned
        before, left = left, (rest * rest).sum()
        way = rest + left / before * way
    return g


def shares(corners: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three shares of a triangle's corners in each place."""
    s = (at - corners[0]) @ np.linalg.inv(np.column_stack([corners[1] - corners[0], corners[2] - corners[0]])).T
    return np.column_stack([1 - s.sum(1), s])


def clough_tocher(corners: np.ndarray, f: np.ndarray, g: np.ndarray, beyond: list[np.ndarray | None], b: np.ndarray) -> np.ndarray:
    """The smooth cubic of a triangle split at its centroid, at shares b (Clough and Tocher 1965; Alfeld 1984): f and g are the corners' values and gradients.

    Across an edge its slope towards the centroid of the triangle beyond changes linearly along the edge; towards the edge's middle where there is none.
    """
    middle = corners.mean(0)
    # control values: near corner i on the way to corner j, near corner i on the way to the centroid, and inside the part beside an edge
    near = {(i, j): f[i] + (corners[j] - corners[i]) @ g[i] / 3 for i in range(3) for j in range(3) if i != j}
    inner = [f[i] + (middle - corners[i]) @ g[i] / 3 for i in range(3)]
    side = {}
    for (i, j), other in zip(CORNERS, beyond, strict=True):
        to = middle - (corners[i] + corners[j]) / 2 if other is None else middle - other
        a, c = np.linalg.solve(np.column_stack([corners[i] - middle, corners[j] - middle]), to)
        d = -a - c
        ends = a * (f[i] + near[j, i]) + c * (near[i, j] + f[j]) + d * (inner[i] + inner[j])
        side[i, j] = side[j, i] = (ends / 2 - a * near[i, j] - c * near[j, i]) / d
    deep = [(inner[i] + side[i, (i + 1) % 3] + side[i, (i + 2) % 3]) / 3 for i in range(3)]
    top = sum(deep) / 3
    out = np.empty(len(b))
    part = b.argmin(1)
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        own = part == k
        p, q, r = b[own, i] - b[own, k], b[own, j] - b[own, k], 3 * b[own, k]
        out[own] = (
            f[i] * p**3 + f[j] * q**3 + top * r**3 + 6 * side[i, j] * p * q * r
            + 3 * (near[i, j] * p * p * q + near[j, i] * p * q * q + inner[i] * p * p * r + inner[j] * q * q * r + deep[i] * p * r * r + deep[j] * q * r * r)
        )
    return out


def interpolated(points: np.ndarray, values: np.ndarray, targets: np.ndarray, method: str = "linear") -> np.ndarray:
    """Values at the targets from the triangle around each; outside all of them the mean of the values. Of points in one place the first counts."""
    out = np.full(len(targets), values.mean())
    points, at = np.unique(points, axis=0, return_index=True)
    values = values[at]
    triangles = triangulate(points) if len(points) > 2 else np.empty((0, 3), int)
    u, v = points[triangles[:, 1]] - points[triangles[:, 0]], points[triangles[:, 2]] - points[triangles[:, 0]]
    triangles = triangles[abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) >= 1e-14]
    if not len(triangles):
        return out
    gradient, across = None, {}
    if method == "cubic":
        gradient = slopes(points, values, triangles)
        for t in triangles:
            for i, j in CORNERS:
                across.setdefault(frozenset((t[i], t[j])), []).append(points[t].mean(0))
    # a triangle meets the targets of its own stretch of the first axis alone
    order = np.argsort(targets[:, 0], kind="stable")
    axis = targets[order, 0]
    done = np.zeros(len(targets), bool)
    for t in triangles:
        corners = points[t]
        low, high = corners[:, 0].min(), corners[:, 0].max()
        slack = 1e-9 * (1 + high - low)
        some = order[np.searchsorted(axis, low - slack) : np.searchsorted(axis, high + slack, "right")]
        some = some[~done[some]]
        if not len(some):
            continue
        b = shares(corners, targets[some])
        inside = (b >= -1e-12).all(1)
        own = some[inside]
        if not len(own):
            continue
        if method == "cubic":
            middle = corners.mean(0)
            beyond = [next((c for c in across[frozenset((t[i], t[j]))] if not np.array_equal(c, middle)), None) for i, j in CORNERS]
            out[own] = clough_tocher(corners, values[t], gradient[t], beyond, b[inside])
        else:
            out[own] = b[inside] @ values[t]
        done[own] = True
    return out


def linear(points: np.ndarray, values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return interpolated(points, values, targets)


def cubic(points: np.ndarray, values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return interpolated(points, values, targets, "cubic")


def resample(samples: DataFrame, n_rows: int, n_cols: int, method: str = "linear") -> DataFrame:
    """map_id, row, col, value: samples (map_id, lat, lon, value) on a grid between their extremes, method linear or cubic. Samples with a null are left out; of equal places the one of smallest value counts."""
    if method not in ("linear", "cubic"):
        raise ValueError("method must be 'linear' or 'cubic'")

    def work(table: pa.Table) -> pa.Table:
        lat, lon, value = (table.column(c).to_numpy() for c in ("lat", "lon", "value"))
        order = np.lexsort((value, lon, lat))
        lat, lon, value = lat[order], lon[order], value[order]
        grid = np.stack(np.meshgrid(np.linspace(lat.min(), lat.max(), n_rows), np.linspace(lon.min(), lon.max(), n_cols), indexing="ij"), -1).reshape(-1, 2)
        out = interpolated(np.column_stack([lat, lon]), value, grid, method)
        k = np.arange(n_rows * n_cols)
        return pa.table({"map_id": pa.array(np.full(len(k), table.column("map_id")[0].as_py())), "row": pa.array(k // n_cols), "col": pa.array(k % n_cols), "value": pa.array(out)})

    ship(samples.sparkSession)
    return samples.select("map_id", "lat", "lon", "value").dropna().groupBy("map_id").applyInArrow(work, "map_id long, row long, col long, value double")
