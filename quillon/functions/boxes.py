"""Column functions over boxes: columns or records of x0, y0, x1, y1 (points, origin top left)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Sides = tuple[Column, Column, Column, Column]
NAMES = ("x0", "y0", "x1", "y1")


def side(b: str = "") -> Sides:
    """The sides of a box column, or of a row whose columns begin with b (ends in _), or are the sides themselves."""
    return tuple(F.col(f"{b}{k}" if not b or b.endswith("_") else f"{b}.{k}") for k in NAMES)


def box(sides: Sides) -> Column:
    return F.struct(*(c.alias(k) for c, k in zip(sides, NAMES, strict=True)))


def width(b: str = "") -> Column:
    x0, _, x1, _ = side(b)
    return F.greatest(F.lit(0.0), x1 - x0)


def height(b: str = "") -> Column:
    _, y0, _, y1 = side(b)
    return F.greatest(F.lit(0.0), y1 - y0)


def area(b: str = "") -> Column:
    return width(b) * height(b)


def expanded(b: str, pad: float) -> Column:
    x0, y0, x1, y1 = side(b)
    return box((x0 - pad, y0 - pad, x1 + pad, y1 + pad))


def merged(a: str, b: str) -> Column:
    """The smallest box that holds both."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = side(a), side(b)
    return box((F.least(ax0, bx0), F.least(ay0, by0), F.greatest(ax1, bx1), F.greatest(ay1, by1)))


def intersects(a: str, b: str, gap: float = 0.0) -> Column:
    """The boxes come within gap of each other, edges included."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = side(a), side(b)
    return (ax1 + gap >= bx0) & (bx1 + gap >= ax0) & (ay1 + gap >= by0) & (by1 + gap >= ay0)


def overlap(a: str, b: str) -> Column:
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = side(a), side(b)
    return F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))


def aligned(a: str, b: str, share: float = 0.35) -> Column:
    """The boxes stand above each other: they share more than a part of the narrower one's width."""
    (ax0, _, ax1, _), (bx0, _, bx1, _) = side(a), side(b)
    narrower = F.least(width(a), width(b))
    return (narrower > 0) & (F.least(ax1, bx1) - F.greatest(ax0, bx0) > share * narrower)


def distance(a: str, b: str) -> Column:
    """Points between the boxes upwards or downwards; 0 if they overlap there."""
    (_, ay0, _, ay1), (_, by0, _, by1) = side(a), side(b)
    return F.when(by0 >= ay1, by0 - ay1).when(by1 <= ay0, ay0 - by1).otherwise(0.0)


def encloses(outer: str, inner: str, share: float = 0.7) -> Column:
    """inner, if it has an area, lies in outer to that share."""
    return (area(inner) > 0) & (overlap(outer, inner) > 0) & (overlap(outer, inner) >= share * area(inner))


def clip(b: str, page: str, pad: float) -> Column:
    """The box grown by pad and cut to the page."""
    (x0, y0, x1, y1), (px0, py0, px1, py1) = side(b), side(page)
    return box((F.greatest(x0 - pad, px0), F.greatest(y0 - pad, py0), F.least(x1 + pad, px1), F.least(y1 + pad, py1)))
