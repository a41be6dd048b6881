"""Bin assignment as column expressions over driver-side edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_bin(value: Column, lo: float, hi: float, n: int) -> Column:
    """Equal-width bin 0..n-1 between lo and hi; the last bin is closed."""
    width = (hi - lo) / n
    if width <= 0:
        return F.when(value.isNotNull(), F.lit(0))
    return F.least(F.lit(n - 1), F.floor((value - F.lit(lo)) / F.lit(width)).cast("int"))


def quantile_bin(value: Column, edges: list[float]) -> Column:
    """1-based right-closed bin over sorted distinct edges; the first bin holds its left edge."""
    below = sum((F.when(value > F.lit(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(1))
    return F.when(value.isNotNull(), below)


def hex_cell(x: Column, y: Column, x_span: tuple[float, float], y_span: tuple[float, float], nx: int = 35) -> tuple[Column, Column]:
    """Hexagon centre (u, v) in lattice units, for nx hexagons across x.

    Two interleaved rectangular lattices; a point belongs to the nearer centre.  Where
    an axis has no extent only the first lattice is used, as one row of cells.
    """
    ny = int(nx / 3**0.5)
    u = (x - F.lit(x_span[0])) / F.lit((x_span[1] - x_span[0]) / nx) if x_span[1] > x_span[0] else F.lit(0.0)
    v = (y - F.lit(y_span[0])) / F.lit((y_span[1] - y_span[0]) / ny) if y_span[1] > y_span[0] else F.lit(0.0)
    au, av = F.floor(u + 0.5).cast("double"), F.floor(v + 0.5).cast("double")
    if x_span[1] <= x_span[0] or y_span[1] <= y_span[0]:
        return au, av
    bu, bv = F.floor(u) + F.lit(0.5), F.floor(v) + F.lit(0.5)
    near_a = (u - au) * (u - au) + 3.0 * (v - av) * (v - av) < (u - bu) * (u - bu) + 3.0 * (v - bv) * (v - bv)
    return F.when(near_a, au).otherwise(bu), F.when(near_a, av).otherwise(bv)


# Grade class limits in percent and their labels.
GRADE_LIMITS = (30.0, 40.0, 50.0)
GRADE_LABELS = ("<30", "30-40", "40-50", ">=50")


def grade_class(grade: Column, nan_class: str | None = None) -> Column:
    """Left-closed grade class; a missing grade gets ``nan_class`` (NULL by default)."""
    label = F.when(grade.isNull() | F.isnan(grade), F.lit(nan_class))
    for limit, name in zip(GRADE_LIMITS, GRADE_LABELS):
        label = label.when(grade < F.lit(limit), F.lit(name))
    return label.otherwise(F.lit(GRADE_LABELS[-1]))
