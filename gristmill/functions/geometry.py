"""Crop rectangles as columns: clamping, frames, rotation, orientation. Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 0.02  # fixed value: smallest width or height of a normalised crop


def clamped(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Normalised edges within 0..1, 5 decimals; null if narrower or lower than LEAST before rounding."""
    edge = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    l, t, r, b = (edge(c) for c in (left, top, right, bottom))  # noqa: E741
    return F.when((r - l >= LEAST) & (b - t >= LEAST), F.array(*(F.bround(c, 5) for c in (l, t, r, b))))


def to_pixels(crop: Column, width: Column, height: Column) -> Column:
    """Edges are rounded; extents are differences of rounded edges."""
    at = lambda i, size: F.bround(F.element_at(crop, i) * size).cast("int")
    l, t, r, b = at(1, width), at(2, height), at(3, width), at(4, height)  # noqa: E741
    return F.struct(l.alias("x"), t.alias("y"), (r - l).alias("width"), (b - t).alias("height"))


def from_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return clamped(x / width, y / height, (x + w) / width, (y + h) / height)


def straight_size(width: Column, height: Column, degrees: Column) -> Column:
    """Size of the box around the rotated rectangle."""
    a = F.radians(degrees)
    c, s = F.abs(F.cos(a)), F.abs(F.sin(a))
    return F.struct((width * c + height * s).alias("width"), (width * s + height * c).alias("height"))


def turned(x: Column, y: Column, degrees: Column) -> Column:
    a = F.radians(degrees)
    return F.struct((x * F.cos(a) - y * F.sin(a)).alias("x"), (x * F.sin(a) + y * F.cos(a)).alias("y"))


def to_stored(crop: Column, orientation: Column) -> Column:
    """A crop of the upright image in the frame of the stored one, for orientation tags 1..8; others count as 1."""
    # which edge (1 left, 2 top, 3 right, 4 bottom) goes where; those below 0 are measured from the other side
    edges = {2: (-3, 2, -1, 4), 3: (-3, -4, -1, -2), 4: (1, -4, 3, -2), 5: (2, 1, 4, 3), 6: (2, -3, 4, -1), 7: (-4, -3, -2, -1), 8: (-4, 1, -2, 3)}
    which = F.array(*map(F.lit, (1, 2, 3, 4)))
    for tag, of in edges.items():
        which = F.when(orientation == tag, F.array(*map(F.lit, of))).otherwise(which)
    edge = lambda c: lambda i: F.bround(F.when(i < 0, 1 - F.element_at(c, -i)).otherwise(F.element_at(c, i)), 6)
    return F.transform(F.array(crop), lambda c: F.transform(which, edge(c)))[0]  # binds the crop, whose expression may be large


def fitted(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box of the given size around a centre, moved into width x height, normalised to 5 decimals."""
    w, h = F.least(w, width), F.least(h, height)
    x = F.least(F.greatest(cx - w / 2, F.lit(0.0)), width - w)
    y = F.least(F.greatest(cy - h / 2, F.lit(0.0)), height - h)
    return F.array(F.bround(x / width, 5), F.bround(y / height, 5), F.bround((x + w) / width, 5), F.bround((y + h) / height, 5))


def _between_frames(crop: Column, w0: Column, h0: Column, w1: Column, h1: Column, degrees: Column) -> Column:
    l, t, r, b = (F.element_at(crop, i) for i in (1, 2, 3, 4))  # noqa: E741
    d = turned((l + r) / 2 * w0 - w0 / 2, (t + b) / 2 * h0 - h0 / 2, degrees)
    return fitted(w1 / 2 + d["x"], h1 / 2 + d["y"], (r - l) * w0, (b - t) * h0, w1, h1)


def to_straight(crop: Column, width: Column, height: Column, degrees: Column) -> Column:
    """A crop of the image in the frame of the straightened one: its centre turns, its size stays."""
    s = straight_size(width, height, degrees)
    return _between_frames(crop, width, height, s["width"], s["height"], -degrees)


def point_to_straight(point: Column, width: Column, height: Column, degrees: Column) -> Column:
    """A normalised point of the image in the frame of the straightened one, 5 decimals."""
    s = straight_size(width, height, degrees)
    d = turned(F.element_at(point, 1) * width - width / 2, F.element_at(point, 2) * height - height / 2, -degrees)
    return F.array(F.bround((s["width"] / 2 + d["x"]) / s["width"], 5), F.bround((s["height"] / 2 + d["y"]) / s["height"], 5))


def from_straight(crop: Column, width: Column, height: Column, degrees: Column) -> Column:
    s = straight_size(width, height, degrees)
    return _between_frames(crop, s["width"], s["height"], width, height, degrees)


def straight_degrees(automatic: Column, conf: Column, explicit_set: Column, explicit: Column) -> Column:
    """An explicit angle (null is off) or the automatic one if it is large and sure enough; tiny angles are off."""
    auto = F.when((F.abs(automatic) >= 0.3) & (conf >= 0.4), automatic)
    deg = F.coalesce(F.when(explicit_set, explicit).otherwise(auto), F.lit(0.0))
    return F.when(F.abs(deg) < 0.01, F.lit(0.0)).otherwise(deg)
