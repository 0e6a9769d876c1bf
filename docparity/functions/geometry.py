"""Boxes: overlap, intersection over union, unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two (x, y, width, height) structs; 0 unless they overlap by an area."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    return F.when((w > 0) & (h > 0) & (both > 0), w * h / both).otherwise(0.0)


def touches(a: Column, b: Column) -> Column:
    """Overlap that counts shared edges."""
    return (
        (a["x"] <= b["x"] + b["width"]) & (b["x"] <= a["x"] + a["width"])
        & (a["y"] <= b["y"] + b["height"]) & (b["y"] <= a["y"] + a["height"])
    )


def percent_to_pixels(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Missing parts are 0, 0, 10 and 5 percent."""
    part = lambda v, d, size: F.coalesce(v, F.lit(float(d))) * size / 100
    return F.struct(
        part(x, 0, page_width).alias("x"), part(y, 0, page_height).alias("y"),
        part(width, 10, page_width).alias("width"), part(height, 5, page_height).alias("height"),
    )


def inset(box: Column) -> Column:
    """The small shift and shrink that stands in for a second extractor's box."""
    return F.struct((box["x"] + 2).alias("x"), (box["y"] + 1).alias("y"), (box["width"] - 4).alias("width"), (box["height"] - 2).alias("height"))
