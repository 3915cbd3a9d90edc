"""Boxes as columns: structs of x, y, w, h in fractions of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Shared area by joint area; 0 where there is none."""
    i = intersection(a, b)
    joint = area(a) + area(b) - i
    return F.when(joint > 0, i / joint).otherwise(0.0)


def coverage(a: Column, b: Column) -> Column:
    """Part of a that b covers."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def union_columns(box: str) -> list[Column]:
    """Aggregates of the box around all boxes of a group: clamped to the page, four decimals."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    x0, y0 = clamp(F.min(f"{box}.x")), clamp(F.min(f"{box}.y"))
    x1, y1 = clamp(F.max(F.col(f"{box}.x") + F.col(f"{box}.w"))), clamp(F.max(F.col(f"{box}.y") + F.col(f"{box}.h")))
    return [F.round(x0, 4).alias("x"), F.round(y0, 4).alias("y"), F.round(x1 - x0, 4).alias("w"), F.round(y1 - y0, 4).alias("h")]
