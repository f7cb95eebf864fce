"""Colour expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends in degrees of the named hues; Red is also what lies above 345.
HUES = ((15, "Red"), (45, "Orange"), (70, "Yellow"), (150, "Green"), (200, "Cyan"), (260, "Blue"), (300, "Purple"))


def chromatic(r: Column, g: Column, b: Column) -> Column:
    """Neither near white, nor near black, nor gray (0..255)."""
    white = (r > 240) & (g > 240) & (b > 240)
    black = (r < 20) & (g < 20) & (b < 20)
    gray = (F.abs(r - g) < 15) & (F.abs(g - b) < 15)
    return ~(white | black | gray)


def to_byte(x: Column) -> Column:
    """0..1 -> 0..255, cut to a whole number."""
    return (x * 255).cast("int")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114)


def base_hue(r: Column, g: Column, b: Column) -> Column:
    """Name of the hue of an 0..255 colour; Gray where the HLS saturation is under 0.15."""
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span, total = high - low, high + low
    s = F.when(span == 0, 0.0).when(total / 2 <= 0.5, span / total).otherwise(span / (2.0 - total))
    rc, gc, bc = ((high - c) / span for c in (r, g, b))
    sector = F.when(r == high, bc - gc).when(g == high, 2.0 + rc - bc).otherwise(4.0 + gc - rc)
    turn = sector / 6.0
    deg = (turn - F.floor(turn)) * 360
    name = reduce(lambda rest, h: F.when(deg < h[0], h[1]).otherwise(rest), reversed(HUES), F.lit("Pink"))
    return F.when(s < 0.15, "Gray").when(deg > 345, "Red").otherwise(name)
