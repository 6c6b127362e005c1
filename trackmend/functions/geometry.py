"""Geometry of boxes as Column expressions.  A box is the four columns ``<prefix>x1 y1 x2 y2``, or fields of a struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def field_box(of: Column) -> Box:
    return tuple(of[c] for c in ("x1", "y1", "x2", "y2"))


def box_wh(b: Box) -> tuple[Column, Column]:
    """Signed width and height."""
    return b[2] - b[0], b[3] - b[1]


def box_area(b: Box) -> Column:
    w, h = box_wh(b)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def box_centroid(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def distance(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    dx, dy = p[0] - q[0], p[1] - q[1]
    return F.sqrt(dx * dx + dy * dy)


def centroid_distance(a: Box, b: Box) -> Column:
    return distance(box_centroid(a), box_centroid(b))


def aspect_ratio(b: Box) -> Column:
    """The long side over the short one; sides are 1e-6 at least."""
    w, h = (F.greatest(x, F.lit(1e-6)) for x in box_wh(b))
    return F.greatest(w, h) / F.least(w, h)


def box_diag(b: Box) -> Column:
    return F.hypot(*box_wh(b))


def _intersection(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes that don't meet."""
    common = _intersection(a, b)
    union = box_area(a) + box_area(b) - common
    return F.when((common <= 0) | (union <= 0), 0.0).otherwise(F.try_divide(common, union))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 for boxes that don't meet or have no area."""
    common, smaller = _intersection(a, b), F.least(box_area(a), box_area(b))
    return F.when((common <= 0) | (smaller <= 0), 0.0).otherwise(F.try_divide(common, smaller))


def lerp_box(a: Box, b: Box, t: Column) -> Box:
    return tuple(p + (q - p) * t for p, q in zip(a, b, strict=True))


def wrap_deg(d: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(d + 180, F.lit(360.0)) - 180
