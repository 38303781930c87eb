"""Image features over pixel arrays, as Arrow-batched functions for what expressions can't say.

Pixels are rows of grey values 0..255, given with their width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def resized(pixels: np.ndarray, width: int, w: int, h: int) -> np.ndarray:
    """Area means on a grid of w by h."""
    image = np.asarray(pixels, float).reshape(-1, width)
    rows = [np.mean(image[int(i * len(image) / h) : max(int((i + 1) * len(image) / h), int(i * len(image) / h) + 1)], axis=0) for i in range(h)]
    grid = np.stack(rows)
    return np.stack([np.mean(grid[:, int(j * width / w) : max(int((j + 1) * width / w), int(j * width / w) + 1)], axis=1) for j in range(w)], axis=1)


def _word(bits: np.ndarray) -> int:
    value = 0
    for b in bits.ravel():
        value = value << 1 | int(b)
    return value - (1 << 64) if value >> 63 else value


def difference_word(pixels: np.ndarray, width: int) -> int:
    """64 bits: whether each cell of a 9 by 8 grid is darker than the next in its row."""
    g = resized(pixels, width, 9, 8)
    return _word(g[:, :-1] < g[:, 1:])


def frequency_word(pixels: np.ndarray, width: int) -> int:
    """63 bits: which low frequencies of a 32 by 32 grid exceed the mean of those but the lowest."""
    g = resized(pixels, width, 32, 32)
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * n[:8, None] / 64)
    low = (basis @ g @ basis.T).ravel()[1:]
    return _word(low > low.mean())


@F.pandas_udf("long")
def difference_hash(pixels: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([difference_word(p, int(w)) for p, w in zip(pixels, width)])


@F.pandas_udf("long")
def frequency_hash(pixels: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([frequency_word(p, int(w)) for p, w in zip(pixels, width)])


def dark_share(pixels: Column, below: int = 128) -> Column:
    """Share of dark pixels."""
    return F.size(F.filter(pixels, lambda p: p < below)) / F.size(pixels)


def otsu_threshold(pixels: Column) -> Column:
    """The grey value that best parts dark from light: the greatest variance between the two classes."""
    n = F.size(pixels)
    hist = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.size(F.filter(pixels, lambda p: p == v)).cast("double"))
    total = F.aggregate(pixels, F.lit(0.0), lambda t, p: t + p.cast("double"))
    both = F.transform(F.array(F.struct(hist.alias("h"), total.alias("sum"))), lambda x: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.struct(_between(x["h"], v, n.cast("double"), x["sum"]).alias("var"), (-v).alias("neg"))))[0]
    return -F.array_max(both)["neg"]


def _between(hist: Column, v: Column, n: Column, total: Column) -> Column:
    low = F.slice(hist, 1, v + 1)
    w = F.aggregate(low, F.lit(0.0), lambda t, x: t + x)
    s = F.aggregate(F.transform(low, lambda x, i: x * i), F.lit(0.0), lambda t, x: t + x)
    gap = s / w - (total - s) / (n - w)
    return F.when((w > 0) & (w < n), w * (n - w) * gap * gap).otherwise(F.lit(-1.0))


# ---------------------------------------------------------------- shapes
def thinned(image: np.ndarray) -> np.ndarray:
    """A binary image reduced to lines one pixel wide, by Guo and Hall's two alternating passes."""
    now = np.pad(np.asarray(image, bool), 1)
    while True:
        before = now.copy()
        for odd in (False, True):
            n = [np.roll(now, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            runs = sum((~n[i] & (n[i + 1] | n[(i + 2) % 8])).astype(int) for i in (0, 2, 4, 6))
            first = sum((n[(i - 1) % 8] | n[i]).astype(int) for i in (0, 2, 4, 6))
            second = sum((n[i] | n[i + 1]).astype(int) for i in (0, 2, 4, 6))
            few = np.minimum(first, second)
            edge = (n[4] | n[5] | ~n[7]) & n[6] if odd else (n[0] | n[1] | ~n[3]) & n[2]
            now = now & ~((runs == 1) & (few >= 2) & (few <= 3) & ~edge)
        if (now == before).all():
            return now[1:-1, 1:-1]


def radial_signature(image: np.ndarray, rays: int = 48) -> np.ndarray:
    """By ray from the centre of mass, the distance of the farthest set pixel, as a share of the largest."""
    y, x = np.nonzero(image)
    out = np.zeros(rays)
    if len(x):
        dx, dy = x - x.mean(), y - y.mean()
        np.maximum.at(out, (np.floor(np.arctan2(dy, dx) / (2 * np.pi) * rays).astype(int)) % rays, np.hypot(dx, dy))
        out /= out.max() or 1.0
    return out


def distance_map(image: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest set one: exact, first along columns and then along rows."""
    far = float(sum(image.shape)) * 2
    column = np.where(image, 0.0, far)
    for i in range(1, len(column)):
        column[i] = np.minimum(column[i], column[i - 1] + 1)
    for i in range(len(column) - 2, -1, -1):
        column[i] = np.minimum(column[i], column[i + 1] + 1)
    w = np.arange(column.shape[1])
    across = (w[:, None] - w[None, :]) ** 2
    return np.sqrt(np.stack([(row[None, :] ** 2 + across).min(axis=1) for row in column]))


def chamfer(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance between two line images, both ways, as a share of the diagonal in per cent; 999 where one is empty."""
    if not a.any() or not b.any():
        return 999.0
    return float((distance_map(b)[a].mean() + distance_map(a)[b].mean()) / 2 / np.hypot(*a.shape) * 100)


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre, by the nearest pixel; what comes from outside is empty."""
    h, w = image.shape
    t = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
    sx = np.rint(np.cos(t) * dx + np.sin(t) * dy + (w - 1) / 2).astype(int)
    sy = np.rint(-np.sin(t) * dx + np.cos(t) * dy + (h - 1) / 2).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.zeros_like(image)
    out[ok] = image[sy[ok], sx[ok]]
    return out


def best_turn(image: np.ndarray, other: np.ndarray) -> float:
    """Degrees to turn other by to fit image best: every 10, then within 12 by 1, then within 2 by a quarter."""

    def fit(degrees: float) -> float:
        a, b = image.astype(float).ravel(), turned(other, degrees).astype(float).ravel()
        return float(np.mean((a - a.mean()) / max(a.std(), 1e-9) * (b - b.mean()) / max(b.std(), 1e-9)))

    best = max(np.arange(0, 360, 10.0), key=fit)
    for reach, step in ((12, 1.0), (2, 0.25)):
        best = max(np.arange(best - reach, best + reach + step / 2, step), key=fit)
    return float(best % 360)


def variants(image: np.ndarray) -> list[tuple[int, bool, np.ndarray]]:
    """The eight turns and mirrors: (degrees, mirrored, image)."""
    return [(90 * k, bool(m), np.rot90(np.fliplr(image) if m else image, k)) for m in (0, 1) for k in range(4)]


def closest_variant(word: int, image: np.ndarray) -> tuple[int, int, bool]:
    """(differing bits, degrees, mirrored) of the variant whose hash is nearest to a word."""
    return min((bin((frequency_word(v.ravel(), v.shape[1]) ^ word) & (1 << 64) - 1).count("1"), degrees, mirrored) for degrees, mirrored, v in variants(image))
