"""Geometry expressions on plain number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sanitise(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """A box with negative extents turned over, then each number clamped to 0..1 on its own."""
    return {
        "x": unit(F.when(w < 0, x + w).otherwise(x)),
        "y": unit(F.when(h < 0, y + h).otherwise(y)),
        "width": unit(F.abs(w)),
        "height": unit(F.abs(h)),
    }


def clip_rect(left: Column, bottom: Column, right: Column, top: Column, page_w: float, page_h: float) -> dict[str, Column]:
    """Box with the origin at the page's bottom left -> top-left box, grown by a tenth of its size a side, inside the page."""
    dx, dy = (right - left) * 0.1, (top - bottom) * 0.1
    return {
        "cx0": F.greatest(F.lit(0.0), left - dx),
        "cy0": F.greatest(F.lit(0.0), F.lit(float(page_h)) - top - dy),
        "cx1": F.least(F.lit(float(page_w)), right + dx),
        "cy1": F.least(F.lit(float(page_h)), F.lit(float(page_h)) - bottom + dy),
    }


def search_rect(c: dict[str, Column], page_w: float, page_h: float, pad: float = 150.0) -> dict[str, Column]:
    """The clip box grown by pad a side, inside the page."""
    return {
        "sx0": F.greatest(F.lit(0.0), c["cx0"] - pad),
        "sy0": F.greatest(F.lit(0.0), c["cy0"] - pad),
        "sx1": F.least(F.lit(float(page_w)), c["cx1"] + pad),
        "sy1": F.least(F.lit(float(page_h)), c["cy1"] + pad),
    }


def crop_box(left: Column, bottom: Column, right: Column, top: Column, page_h: float, scale: Column, img_w: Column, img_h: Column, pad: int = 60) -> dict[str, Column]:
    """Pixel box of a bottom-left box: flipped, scaled, padded, inside the image, cut to whole numbers."""
    high = F.lit(float(page_h))
    return {
        "px0": F.greatest(F.lit(0.0), left * scale - pad).cast("int"),
        "py0": F.greatest(F.lit(0.0), (high - top) * scale - pad).cast("int"),
        "px1": F.least(img_w.cast("double"), right * scale + pad).cast("int"),
        "py1": F.least(img_h.cast("double"), (high - bottom) * scale + pad).cast("int"),
    }


def edge_distance(a: list[Column], b: list[Column]) -> Column:
    """Gap between two boxes (x0, y0, x1, y1), 0 where they overlap."""
    dx = F.greatest(F.lit(0.0), a[0] - b[2], b[0] - a[2])
    dy = F.greatest(F.lit(0.0), a[1] - b[3], b[1] - a[3])
    return F.sqrt(dx * dx + dy * dy)


def overlap(a: list[Column], b: list[Column]) -> Column:
    """The boxes share more than an edge."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def polygon_box(points: Column) -> dict[str, Column]:
    """Smallest box around an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
