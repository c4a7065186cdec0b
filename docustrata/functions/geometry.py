"""Boxes, regions and homographies as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docustrata.functions.text import rounded

Box = Sequence[Column]


def normalized(px: Column, size: Column) -> Column:
    return rounded(px / F.greatest(F.lit(1), size), 4)


def center(a: Column, b: Column) -> Column:
    return (a + b) * 0.5


def inside(x: Column, y: Column, r: Box) -> Column:
    return x.between(r[0], r[2]) & y.between(r[1], r[3])


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def area(a: Box) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def overlap(a: Box, b: Box) -> Column:
    """Share of a that b covers."""
    return F.when(area(a) <= 0, F.lit(0.0)).otherwise(intersection(a, b) / F.nullif(area(a), F.lit(0.0)))


def iou(a: Box, b: Box) -> Column:
    both, union = intersection(a, b), area(a) + area(b) - intersection(a, b)
    return F.when(union <= 0, F.lit(0.0)).otherwise(both / F.nullif(union, F.lit(0.0)))


def contained(mode: Column, token: Box, region: Box, least: Column) -> Column:
    """By the region's mode: overlap, iou, or else that the centre lies in it."""
    at = inside(center(token[0], token[2]), center(token[1], token[3]), region)
    return F.when(mode == "overlap", overlap(token, region) >= least).when(mode == "iou", iou(token, region) >= least).otherwise(at)


def transform_point(m: Box, x: Column, y: Column) -> tuple[Column, Column]:
    """m: nine numbers, row by row."""
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def transform_box(m: Box, box: Box) -> list[Column]:
    """The upright box around the four transformed corners."""
    corners = [transform_point(m, box[i], box[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def inverse(m: Box) -> list[Column]:
    """Of a 3 x 3 matrix, by cofactors; null if it is singular."""
    c = lambda a, b, d, e: m[a] * m[b] - m[d] * m[e]
    adj = [c(4, 8, 5, 7), c(2, 7, 1, 8), c(1, 5, 2, 4), c(5, 6, 3, 8), c(0, 8, 2, 6), c(2, 3, 0, 5), c(3, 7, 4, 6), c(1, 6, 0, 7), c(0, 4, 1, 3)]
    det = F.nullif(m[0] * adj[0] + m[1] * adj[3] + m[2] * adj[6], F.lit(0.0))
    return [a / det for a in adj]


def region_pixels(region: Box, margin: Column, width: Column, height: Column) -> list[Column]:
    """Pixels of a relative region with its margin, cut to the page, truncated; the whole page if nothing is left."""
    low = lambda r, size: F.greatest(F.lit(0), ((r - margin) * size).cast("int"))
    high = lambda r, size: F.least(size.cast("int"), ((r + margin) * size).cast("int"))
    x1, y1, x2, y2 = low(region[0], width), low(region[1], height), high(region[2], width), high(region[3], height)
    bad = (x2 <= x1) | (y2 <= y1)
    whole = [F.lit(0), F.lit(0), width.cast("int"), height.cast("int")]
    return [F.when(bad, w).otherwise(v) for w, v in zip(whole, (x1, y1, x2, y2), strict=True)]
