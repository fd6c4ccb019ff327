"""Boxes as column expressions: struct(x0, y0, x1, y1) in page pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def union_box(b: Column) -> Column:
    """Aggregate: the smallest box around all."""
    return F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def _shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under > 0, over / F.when(under > 0, under).otherwise(1.0)).otherwise(0.0)


def v_overlap_ratio(a: Column, b: Column) -> Column:
    """Shared height by the smaller height, 0 if that is nothing."""
    return _ratio(_shared(a["y0"], a["y1"], b["y0"], b["y1"]), F.least(height(a), height(b)))


def h_overlap_ratio(a: Column, b: Column) -> Column:
    return _ratio(_shared(a["x0"], a["x1"], b["x0"], b["x1"]), F.least(width(a), width(b)))


def inter_area(a: Column, b: Column) -> Column:
    return _shared(a["x0"], a["x1"], b["x0"], b["x1"]) * _shared(a["y0"], a["y1"], b["y0"], b["y1"])


def iou(a: Column, b: Column) -> Column:
    both = inter_area(a, b)
    return _ratio(both, area(a) + area(b) - both)


def match_distance(a: Column, b: Column) -> Column:
    """Distance of two boxes: their corners' city-block distances, and the smaller of the two once more."""
    tl = F.abs(a["x0"] - b["x0"]) + F.abs(a["y0"] - b["y0"])
    br = F.abs(a["x1"] - b["x1"]) + F.abs(a["y1"] - b["y1"])
    return tl + br + F.least(tl, br)


def quad_to_box(quad: Column) -> Column:
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def contains(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def char_boxes(text: Column, b: Column) -> Column:
    """A line's box cut into as many equal parts as it has characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    step = width(b) / F.greatest(F.size(chars), F.lit(1))
    return F.transform(chars, lambda c, i: F.struct(c.alias("ch"), (b["x0"] + i * step).alias("x0"), (b["x0"] + (i + 1) * step).alias("x1")))


def word_boxes(text: Column, b: Column) -> Column:
    """A line's words with x extents in proportion to their characters, a space counting as one."""
    parts = F.filter(F.split(text, " "), lambda w: w != "")
    total = F.greatest(F.length(F.array_join(parts, " ")), F.lit(1))
    unit = width(b) / total

    def one(w: Column, i: Column) -> Column:
        before = F.length(F.array_join(F.slice(parts, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0)
        return F.struct(w.alias("text"), (b["x0"] + before * unit).alias("x0"), (b["x0"] + (before + F.length(w)) * unit).alias("x1"))

    return F.transform(parts, one)


def deflated(b: Column, share: float = 0.6) -> Column:
    """The box with its height shrunk about its center."""
    half = height(b) * share / 2
    return box(b["x0"], center_y(b) - half, b["x1"], center_y(b) + half)


def rounded(c: Column, places: int) -> Column:
    """Half-up rounding: floor after adding a half."""
    return F.floor(c * 10.0**places + 0.5) / 10.0**places
