"""What lies inside a box: the second stage of detection, texture on either side of its edges, and the format a roll's
edges speak for. NumPy, one image at a time."""

from __future__ import annotations

import numpy as np

from gristmill.functions import raster
from gristmill.functions.tilt import filtered, gaussian

# Levels above the film's border, least runs, and the shares that decide.
LIFT, LOOSE_LIFT, EXPAND_LIFT, LEAST_RUN, HOLDER = 25, 10, 15, 5, 100
LOOK_AGAIN, LEAST_SHARE, ASPECT_OFF, MOSTLY = 0.40, 0.30, 0.15, 0.90


def longest_above(profile: np.ndarray, level: float) -> tuple[int, int]:
    """First longest run above the level of at least LEAST_RUN: its start and end; (0, 0) if there is none."""
    start, length = raster.spans(profile > level)
    return (start, start + length) if length >= LEAST_RUN else (0, 0)


def levels(profile: np.ndarray, border: float | None = None) -> tuple[float, float]:
    """The film border's level at the ends of a profile (or as given), and the level that parts it from the image."""
    rim, n = max(5, len(profile) // 20), len(profile)
    if border is None:
        border = float(min(np.percentile(profile[:rim], 25), np.percentile(profile[-rim:], 25)))
    return border, max(border + LIFT, (border + float(np.median(profile[n // 4 : n * 3 // 4]))) / 2)


def dark_extent(profile: np.ndarray) -> tuple[int, int]:
    """From the first to behind the last place that is darker than the holder; all of it if none is."""
    at = np.flatnonzero(profile < HOLDER)
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, len(profile))


def grown(rows: np.ndarray, span: tuple[int, int], height: int, level: float) -> tuple[int, int]:
    """A span made `height` tall about its middle, on either side only where MOSTLY all it takes in is above the level."""
    first, end = span
    middle = (first + end) // 2
    top, bottom = max(0, middle - height // 2), min(len(rows), middle + height // 2)
    fine = lambda part: not len(part) or (part > level).mean() >= MOSTLY
    return top if fine(rows[top : first + 1]) else first, bottom if fine(rows[end:bottom]) else end


def fitted_shape(rows: np.ndarray, cols: np.ndarray, down: tuple[int, int], right: tuple[int, int], target: float, border: float) -> tuple[tuple[int, int], tuple[int, int], str]:
    """Spans whose shape is far from the target's, repaired: too wide ones grow taller; what is still off takes its width
    from the dark strip's height, and its height too if that is taller."""
    target = max(target, 1 / target)
    off = lambda d, r: abs((r[1] - r[0]) / max(d[1] - d[0], 1) - target) / target
    way = ""
    if (right[1] - right[0]) / (down[1] - down[0]) > target * (1 + ASPECT_OFF):
        down, way = grown(rows, down, int((right[1] - right[0]) / target), border + EXPAND_LIFT), "grown"
    if off(down, right) <= ASPECT_OFF:
        return down, right, way
    (top, bottom), (left, end) = dark_extent(rows), dark_extent(cols)
    middle, width = (left + end) // 2, int((bottom - top) * target)
    new = max(0, middle - width // 2), min(len(cols), middle + width // 2)
    if new[0] < middle < new[1] and new[1] - new[0] > 100:
        return ((top, bottom) if bottom - top > down[1] - down[0] else down), new, "strip"
    return down, right, way


def refined_content(gray: np.ndarray, x: int, y: int, w: int, h: int, border: float | None = None, target: float | None = None) -> tuple[int, int, int, int, str]:
    """The bright image inside a box round its film, and how it was found: "span", "loose" (the level was lowered),
    either with "grown" or "strip" (the shape was repaired), or "kept" (what was found is no image)."""
    film = gray[y : y + h, x : x + w]
    rows, cols = np.median(film, 1).astype(float), np.median(film, 0).astype(float)
    (row_border, row_level), (col_border, col_level) = levels(rows, border), levels(cols)
    down, right, way = longest_above(rows, row_level), longest_above(cols, col_level), "span"
    area = lambda d, r: (d[1] - d[0]) * (r[1] - r[0])
    if area(down, right) < film.size * LOOK_AGAIN:
        again = longest_above(rows, row_border + LOOSE_LIFT), longest_above(cols, col_border + LOOSE_LIFT)
        if area(*again) > area(down, right):
            (down, right), way = again, "loose"
    strip = [b - a for a, b in (dark_extent(rows), dark_extent(cols))]
    if target is not None and min(strip) > 50 and down[1] > down[0] and right[1] > right[0]:
        shape = (right[1] - right[0]) / (down[1] - down[0])
        if abs(shape - max(target, 1 / target)) / max(target, 1 / target) > ASPECT_OFF:
            down, right, how = fitted_shape(rows, cols, down, right, target, row_border)
            way = f"{way} {how}".strip()
    if area(down, right) <= 0 or area(down, right) < w * h * LEAST_SHARE:
        return x, y, w, h, "kept"
    return x + right[0], y + down[0], right[1] - right[0], down[1] - down[0], way


class Sums:
    """Means over any box of an array, from one table of sums."""

    def __init__(self, g: np.ndarray):
        self.table, self.shape = np.pad(g.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0))), g.shape

    def of(self, top, bottom, left, right):
        t = self.table
        return (t[bottom, right] - t[top, right] - t[bottom, left] + t[top, left]) / ((bottom - top) * (right - left))


def deviation(gray: np.ndarray, size: int = 7) -> np.ndarray:
    """The standard deviation in a square round each pixel of the smoothed image; the border is mirrored."""
    g = gray.astype(float)
    for axis in (0, 1):
        g = filtered(g, gaussian(1.2), axis)
    wide = np.pad(g, size // 2, "reflect")
    wide = wide - wide.mean()  # keeps the difference of large sums exact enough
    top, left = np.arange(g.shape[0])[:, None], np.arange(g.shape[1])[None]
    mean, square = (Sums(v).of(top, top + size, left, left + size) for v in (wide, wide * wide))
    return np.sqrt(np.maximum(square - mean * mean, 0))


def content_signals(gray: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[float, float]:
    """How much more texture lies within a box's edges than beyond them (the mean of the two weakest sides, 0.5 where
    fewer can be compared), and how near the strongest change of texture is to each edge (0..1)."""
    texture = deviation(gray)
    high, wide = texture.shape
    means, band = Sums(texture), max(6, int(0.04 * min(w, h)))

    def mean(left: int, right: int, top: int, bottom: int) -> float | None:
        left, right, top, bottom = max(0, left), min(wide, right), max(0, top), min(high, bottom)
        return float(means.of(top, bottom, left, right)) if right - left >= 3 and bottom - top >= 3 else None

    level, upright = (y + band, y + h - band), (x + band, x + w - band)
    sides = [
        (mean(x, x + band, *level), mean(x - band, x, *level)), (mean(x + w - band, x + w, *level), mean(x + w, x + w + band, *level)),
        (mean(*upright, y, y + band), mean(*upright, y - band, y)), (mean(*upright, y + h - band, y + h), mean(*upright, y + h, y + h + band)),
    ]
    ratios = sorted(a / (a + b + 1e-3) for a, b in sides if a is not None and b is not None)
    content = float(np.mean(ratios[:2])) if len(ratios) >= 2 else 0.5
    # profiles across each pair of edges, over the middle four fifths of the other direction
    part = lambda at, n: slice(max(0, at + n // 10), max(0, at + n - n // 10))
    across, down = texture[part(y, h)], texture[:, part(x, w)]
    off = []
    for profile, edges, n in ((across.mean(0) if len(across) else None, (x, x + w), w), (down.mean(1) if down.shape[1] else None, (y, y + h), h)):
        reach = int(0.08 * n)
        for rises, edge in zip((True, False), edges, strict=True):
            if profile is None or min(len(profile), edge + reach) - max(0, edge - reach) < 8:
                continue
            first = max(0, edge - reach)
            seen = profile[first : edge + reach]
            half = min(8, len(seen) - 1)
            taps = gaussian(2.0)
            taps = taps[len(taps) // 2 - half : len(taps) // 2 + half + 1]
            change = np.gradient(filtered(seen[None], taps / taps.sum(), 1)[0])
            off.append(abs(first + int(change.argmax() if rises else change.argmin()) - edge))
    agree = float(np.mean([max(0.0, 1 - d / (0.03 * max(w, h))) for d in off])) if off else 0.0
    return content, agree


def edges_for(gray: np.ndarray, long_side: float, short_side: float) -> float:
    """How well a centred frame of that size meets edges of the image: the score of its refined box."""
    high, wide = gray.shape
    w, h = (short_side, long_side) if high > wide else (long_side, short_side)
    w, h = min(round(w), wide), min(round(h), high)
    return raster.refined_box(gray, (wide - w) // 2, (high - h) // 2, w, h)[4]
