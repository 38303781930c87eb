"""Path functions whose steps depend on those before: Arrow-batched Python over arrays of points.

Paths are arrays of structs (x, y); each function takes and returns such a column.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PATH = "array<struct<x:double,y:double>>"


def clean(points: list[tuple[float, float]], closed: bool, merge: float = 1e-4, turn: float = 179.75) -> list[tuple[float, float]]:
    """Without vertices that nearly repeat the one before, and without those where the path turns back on itself."""
    out: list[tuple[float, float]] = []
    for p in points:
        if not out or math.dist(out[-1], p) > merge:
            out.append(p)
    if closed and len(out) > 1 and math.dist(out[0], out[-1]) <= merge:
        out.pop()
    limit = math.cos(math.radians(turn))
    i = 1
    while i < len(out) - 1:
        (ax, ay), (bx, by), (cx, cy) = out[i - 1], out[i], out[i + 1]
        u, v = (bx - ax, by - ay), (cx - bx, cy - by)
        size = math.hypot(*u) * math.hypot(*v)
        if size and (u[0] * v[0] + u[1] * v[1]) / size <= limit:
            del out[i]
            i = max(1, i - 1)
        else:
            i += 1
    if closed and len(out) > 2:
        out.append(out[0])
    return out


def subdivide(at, lo: float, hi: float, sag: float, chord: float, bend: float, depth: int = 16) -> list[tuple[float, float]]:
    """Points of a curve `at(t)`, halving spans until sag, chord and turning are within limits."""
    out = [at(lo)]

    def step(a: float, b: float, left: int) -> None:
        m = (a + b) / 2
        p, q, r = at(a), at(m), at(b)
        length = math.dist(p, r)
        off = math.dist(q, ((p[0] + r[0]) / 2, (p[1] + r[1]) / 2))
        u, v = (q[0] - p[0], q[1] - p[1]), (r[0] - q[0], r[1] - q[1])
        size = math.hypot(*u) * math.hypot(*v)
        angle = math.degrees(math.acos(max(-1.0, min(1.0, (u[0] * v[0] + u[1] * v[1]) / size)))) if size else 0.0
        if left and (off > sag or length > chord or angle > bend):
            step(a, m, left - 1)
            step(m, b, left - 1)
        else:
            out.append(r)

    step(lo, hi, depth)
    return out


def ellipse(cx: float, cy: float, mx: float, my: float, ratio: float, start: float, end: float):
    """The curve of an ellipse by its centre, major axis and the ratio of the minor one."""
    return lambda t: (cx + mx * math.cos(start + (end - start) * t) - my * ratio * math.sin(start + (end - start) * t), cy + my * math.cos(start + (end - start) * t) + mx * ratio * math.sin(start + (end - start) * t))


def spline(points: list[tuple[float, float]], degree: int = 3):
    """The clamped uniform B-spline of these control points."""
    p = np.array(points, float)
    degree = min(degree, len(p) - 1)
    knots = np.concatenate((np.zeros(degree), np.linspace(0, 1, len(p) - degree + 1), np.ones(degree)))

    def at(t: float) -> tuple[float, float]:
        t = min(max(t, 0.0), 1.0)
        k = min(max(int(np.searchsorted(knots, t, side="right")) - 1, degree), len(p) - 1)
        d = [p[j + k - degree].copy() for j in range(degree + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                lo, hi = knots[j + k - degree], knots[j + 1 + k - r]
                a = (t - lo) / (hi - lo) if hi > lo else 0.0
                d[j] = (1 - a) * d[j - 1] + a * d[j]
        return float(d[degree][0]), float(d[degree][1])

    return at


def crossings(x: np.ndarray, y: np.ndarray, edge: float = 1e-9, tiny: float = 1e-12) -> np.ndarray:
    """Points (a row each) where two edges of a closed ring that aren't neighbours cross strictly inside both.

    A line sweeps over the edges by their least x. Its status are bands of y, as many
    as the root of the number of edges, each with the edges that it has met and not yet
    left; an edge meets those in its own bands whose extents it shares. Edges that
    share two bands meet in the higher one's first. So the work grows with the edges
    that lie near each other, and not with the square of the ring.
    """
    n = len(x)
    ax, ay, bx, by = x, y, np.roll(x, -1), np.roll(y, -1)
    left, right, low, high = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    bands = max(1, int(n**0.5))
    tall = float(high.max() - low.min()) or 1.0
    band = lambda v: np.minimum(((v - low.min()) / tall * bands).astype(int), bands - 1)
    first, last = band(low).tolist(), band(high).tolist()
    status: list[list[int]] = [[] for _ in range(bands)]
    ends = right.tolist()
    out: list[np.ndarray] = []
    one: list[int] = []
    two: list[int] = []

    def test() -> None:
        i, j = np.array(one, int), np.array(two, int)
        i, j = np.minimum(i, j), np.maximum(i, j)
        keep = (low[i] <= high[j]) & (low[j] <= high[i]) & (i + 1 < j) & ~((i == 0) & (j == n - 1))
        i, j = i[keep], j[keep]
        rx, ry, sx, sy = bx[i] - ax[i], by[i] - ay[i], bx[j] - ax[j], by[j] - ay[j]
        den = rx * sy - ry * sx
        ok = np.abs(den) >= tiny
        i, j, rx, ry, sx, sy, den = (v[ok] for v in (i, j, rx, ry, sx, sy, den))
        t = ((ax[j] - ax[i]) * sy - (ay[j] - ay[i]) * sx) / den
        u = ((ax[j] - ax[i]) * ry - (ay[j] - ay[i]) * rx) / den
        hit = (t > edge) & (t < 1 - edge) & (u > edge) & (u < 1 - edge)
        out.append(np.column_stack((ax[i] + t * rx, ay[i] + t * ry))[hit])
        one.clear()
        two.clear()

    for k in np.argsort(left, kind="stable").tolist():
        at = float(left[k])
        for b in range(first[k], last[k] + 1):
            held = status[b]
            if held:
                held[:] = [m for m in held if ends[m] >= at]
                near = held if b == first[k] else [m for m in held if first[m] == b]
                one += [k] * len(near)
                two += near
            held.append(k)
        if len(one) > 1_000_000:
            test()
    test()
    return np.concatenate(out)


CROSSINGS = T.ArrayType(T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType()))


def ring_crossings(verts: Column) -> Column:
    """Where a closed ring crosses itself; null rings and those of three edges or fewer never do."""

    @F.pandas_udf(CROSSINGS)
    def run(rings: pd.Series) -> pd.Series:
        found = []
        for ring in rings:
            if ring is None or len(ring) < 4:
                found.append([])
                continue
            x, y = (np.array([v[k] for v in ring], float) for k in ("x", "y"))
            found.append([{"x": p, "y": q} for p, q in crossings(x, y).tolist()])
        return pd.Series(found)

    return run(verts)


def clean_vertices(verts: Column, closed: Column) -> Column:
    @F.pandas_udf(_PATH)
    def run(paths: pd.Series, shut: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y} for x, y in clean([(v["x"], v["y"]) for v in p], bool(c))] for p, c in zip(paths, shut)])

    return run(verts, closed)


def spline_points(verts: Column, sag: float = 0.05, chord: float = 5.0, bend: float = 30.0) -> Column:
    """The B-spline of control points as a path; fewer than two points stay as they are."""

    @F.pandas_udf(_PATH)
    def run(paths: pd.Series) -> pd.Series:
        out = []
        for p in paths:
            pts = [(v["x"], v["y"]) for v in p]
            out.append([{"x": x, "y": y} for x, y in (subdivide(spline(pts), 0.0, 1.0, sag, chord, bend) if len(pts) > 1 else pts)])
        return pd.Series(out)

    return run(verts)


def sampled(points: list[tuple[float, float]], most: float, bend: float = 30.0, depth: int = 16) -> list[tuple[float, float]]:
    """A path by its length: spans of at most `most`, then halved where the middle is off the chord by an eighth of it or turns by more than `bend` degrees.

    A sharp corner turns at any scale, so a span is halved `depth` times at most.
    """
    p = np.array(points, float)
    run = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))))
    total = float(run[-1])
    if total <= 0:
        return []
    at = lambda d: (float(np.interp(d, run, p[:, 0])), float(np.interp(d, run, p[:, 1])))
    steps, off = max(2, math.ceil(total / max(1e-9, most))), max(1e-6, most / 8)
    out = [at(0.0)]

    def span(a: float, b: float, left: int) -> None:
        m = (a + b) / 2
        u, v, w = at(a), at(m), at(b)
        d1, d2, d = (v[0] - u[0], v[1] - u[1]), (w[0] - v[0], w[1] - v[1]), (w[0] - u[0], w[1] - u[1])
        size = d[0] ** 2 + d[1] ** 2
        t = min(max((d1[0] * d[0] + d1[1] * d[1]) / size, 0.0), 1.0) if size else 0.0
        turn = abs(math.degrees(math.atan2(d1[0] * d2[1] - d1[1] * d2[0], d1[0] * d2[0] + d1[1] * d2[1])))
        if left and (math.dist(v, (u[0] + t * d[0], u[1] + t * d[1])) > off or turn > bend):
            span(a, m, left - 1)
            span(m, b, left - 1)
        else:
            out.append(w)

    for k in range(steps):
        span(total * k / steps, total * (k + 1) / steps, depth)
    return out


def samples_by_length(verts: Column, most: float, bend: float = 30.0) -> Column:
    """sampled() over a column of paths; paths below two points or without length are empty."""

    @F.pandas_udf(_PATH)
    def run(paths: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y} for x, y in sampled([(v["x"], v["y"]) for v in p], most, bend)] if len(p) > 1 else [] for p in paths])

    return run(verts)


def spline_samples(verts: Column, n: int = 64, near: float = 1e-4) -> Column:
    """n + 1 points of the B-spline of control points, without the last where it meets the first; fewer than two points stay as they are."""

    @F.pandas_udf(_PATH)
    def run(paths: pd.Series) -> pd.Series:
        out = []
        for p in paths:
            pts = [(v["x"], v["y"]) for v in p]
            if len(pts) > 1:
                at = spline(pts)
                pts = [at(i / n) for i in range(n + 1)]
                pts = pts[:-1] if math.dist(pts[0], pts[-1]) < near else pts
            out.append([{"x": x, "y": y} for x, y in pts])
        return pd.Series(out)

    return run(verts)
