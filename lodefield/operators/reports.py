"""Spatial report tables: slices, sections, layers, hexagon maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.functions.binning import GRADE_LABELS, grade_class, hex_cell
from lodefield.functions.joins import lookup_join
from lodefield.functions.quantiles import column_spans

MIN_POINTS = 10
# Name fragments that mark the line and the layer column.
LINE_NAMES = ("勘探线", "线号", "line")
LAYER_NAMES = ("层位", "岩性", "层号", "lith", "layer")


def find_column(df: DataFrame, fragments: tuple[str, ...]) -> str | None:
    """First column whose name contains one of the fragments, ignoring case."""
    return next((c for c in df.columns if any(f in c.lower() for f in fragments)), None)


def points_by_set(df: DataFrame) -> DataFrame:
    return df.select("x", "y", "depth", "_set")


def hexbin_error(df: DataFrame, pred: str, truth: str = "grade", nx: int = 35) -> DataFrame:
    """``u, v, n, mean_error`` per hexagon, nx hexagons across x (centres in lattice units)."""
    spans = column_spans(df, ["x", "y"])
    u, v = hex_cell(F.col("x"), F.col("y"), spans["x"][1:], spans["y"][1:], nx)
    return df.groupBy(u.alias("u"), v.alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(pred) - F.col(truth)).alias("mean_error"))


def slices_equal(df: DataFrame, pred: str, truth: str = "grade", slices: int = 4) -> DataFrame:
    """Points near each of ``slices`` evenly spaced inner depths, with their error."""
    row = df.agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.stddev_samp("depth").alias("std")).first()
    if row.lo is None or row.std is None:
        centre, band = F.explode(F.array().cast("array<double>")), 0.0
    else:
        step = (row.hi - row.lo) / (slices + 1)
        centre = F.explode(F.array(*[F.lit(row.lo + i * step) for i in range(1, slices + 1)]))
        band = row.std * 0.1 + 1e-6
    return (
        df.withColumn("centre", centre)
        .filter(F.abs(F.col("depth") - F.col("centre")) <= F.lit(band))
        .select("centre", "x", "y", "depth", (F.col(pred) - F.col(truth)).alias("err"))
    )


def slices_regular(df: DataFrame, interval: float = 20.0, band: float = 10.0, span: tuple[float, float] | None = None) -> DataFrame:
    """Each point once per level ``z0 = zmin + k*interval`` within ``band`` of it.

    The levels a point meets are computed from its depth, so no join is needed.
    """
    lo, hi = span or column_spans(df, ["depth"])["depth"][1:]
    if lo is None:
        return df.withColumn("z0", F.lit(None).cast("double"))
    last = math.ceil((hi + interval - lo) / interval) - 1
    above = F.col("depth") - F.lit(lo)
    first_k = F.greatest(F.lit(0), F.floor((above - F.lit(band)) / F.lit(interval)).cast("int"))
    last_k = F.least(F.lit(last), F.ceil((above + F.lit(band)) / F.lit(interval)).cast("int"))
    levels = F.when(first_k <= last_k, F.sequence(first_k, last_k))
    met = df.withColumn("_k", F.explode(levels)).withColumn("z0", F.lit(lo) + F.col("_k") * F.lit(float(interval)))
    return met.filter(F.abs(F.col("depth") - F.col("z0")) <= F.lit(float(band))).drop("_k")


def slice_stats(sliced: DataFrame) -> DataFrame:
    """Count and grade statistics per slice and set."""
    return sliced.groupBy("z0", "_set").agg(
        F.count(F.lit(1)).alias("n"), F.min("grade").alias("grade_min"), F.avg("grade").alias("grade_mean"),
        F.max("grade").alias("grade_max"))


def slice_points(sliced: DataFrame) -> DataFrame:
    return sliced.select("z0", "_set", "x", "y", "grade")


def contour_cells(sliced: DataFrame, cell: float = 100.0, min_points: int = MIN_POINTS) -> DataFrame:
    """Mean grade per square cell, for slices with at least ``min_points`` points.

    Cells are summed first; the slice totals come from the cells.
    """
    gx, gy = (F.floor(F.col(a) / F.lit(float(cell))).cast("bigint").alias(f"c{a}") for a in ("x", "y"))
    cells = sliced.groupBy("z0", gx, gy).agg(F.count(F.lit(1)).alias("n"), F.avg("grade").alias("grade_mean"))
    totals = cells.groupBy("z0").agg(F.sum("n").alias("slice_n")).filter(F.col("slice_n") >= min_points)
    return lookup_join(cells, totals, ["z0"], "inner")


def slice_classes(sliced: DataFrame, nan_class: str | None = None) -> DataFrame:
    """Points per slice and grade class; empty classes are absent."""
    return sliced.groupBy("z0", grade_class(F.col("grade"), nan_class).alias("grade_class")).agg(F.count(F.lit(1)).alias("n"))


def slice_classes_wide(sliced: DataFrame, nan_class: str | None = None) -> DataFrame:
    """One row per slice with a count per class, in class order; 0 for an empty class."""
    wide = slice_classes(sliced, nan_class).groupBy("z0").pivot("grade_class", list(GRADE_LABELS)).agg(F.sum("n"))
    return wide.na.fill(0, list(GRADE_LABELS))


def section_summary(df: DataFrame, line: str, min_points: int = MIN_POINTS) -> DataFrame:
    """Per line with enough points: axis along the wider spread, its start, counts by set."""
    return (
        df.filter(F.col(line).isNotNull())
        .groupBy(line)
        .agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("_vx"), F.var_samp("y").alias("_vy"),
             F.min("x").alias("_x0"), F.min("y").alias("_y0"),
             F.count_if(F.col("_set") == "Train").alias("n_train"), F.count_if(F.col("_set") == "Test").alias("n_test"))
        .filter(F.col("n") >= min_points)
        .select(line, "n", "n_train", "n_test", F.when(F.col("_vx") < F.col("_vy"), "y").otherwise("x").alias("axis"),
                F.when(F.col("_vx") < F.col("_vy"), F.col("_y0")).otherwise(F.col("_x0")).alias("start"))
    )


def section_points(df: DataFrame, line: str, min_points: int = MIN_POINTS) -> DataFrame:
    """Points of each section in section coordinates ``hcoord_rel, depth``."""
    joined = lookup_join(df, section_summary(df, line, min_points), [line], "inner")
    along = F.when(F.col("axis") == "y", F.col("y")).otherwise(F.col("x"))
    return joined.select(line, "_set", (along - F.col("start")).alias("hcoord_rel"), "depth", "grade")


def layer_summary(df: DataFrame, layer: str, min_points: int = MIN_POINTS) -> DataFrame:
    return (
        df.filter(F.col(layer).isNotNull())
        .groupBy(layer)
        .agg(F.count(F.lit(1)).alias("n"), F.min("grade").alias("grade_min"), F.avg("grade").alias("grade_mean"),
             F.max("grade").alias("grade_max"))
        .filter(F.col("n") >= min_points)
    )


def layer_points(df: DataFrame, layer: str, min_points: int = MIN_POINTS) -> DataFrame:
    kept = layer_summary(df, layer, min_points).select(layer)
    return lookup_join(df, kept, [layer], "left_semi").select(layer, "x", "y", "grade")
