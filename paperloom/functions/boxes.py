"""Arithmetic on boxes given as left, top, right, bottom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def flip(left: Column, bottom: Column, right: Column, top: Column, page_height: Column) -> Box:
    """From an origin at the lower left to one at the upper left."""
    return left, page_height - F.greatest(top, bottom), right, page_height - F.least(top, bottom)


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 if the union is empty."""
    common = overlap(a[0], a[2], b[0], b[2]) * overlap(a[1], a[3], b[1], b[3])
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    union = area(a) + area(b) - common
    return F.when(union <= 0, 0.0).otherwise(common / union)


def vertical_overlap(a: Box, b: Box) -> Column:
    """Shared height over the smaller height."""
    height = F.least(a[3] - a[1], b[3] - b[1])
    return F.when(height <= 0, 0.0).otherwise(overlap(a[1], a[3], b[1], b[3]) / height)
