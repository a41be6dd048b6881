"""Surface lookup and clip."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodefield.functions.joins import lookup_join

LEAF_ROWS = 16
_BITS = 3
_MAX_BITS = 24


def nearest_surface(points: DataFrame, surface: DataFrame, out: str = "surface_z") -> DataFrame:
    """Add the z of the surface point nearest in x and y (ties: least x, then y, then z).

    Search runs over distinct point locations and a pyramid of surface cells: each
    step opens the children of the cells still in play and drops those whose
    nearest edge is farther than another cell's farthest corner.  Only the last few
    cells meet actual surface points, so no location meets a whole dense area.
    """
    dem = surface.groupBy("x", "y").agg(F.min("z").alias("z"))
    box = dem.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                  F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if box.n == 0:
        return points.withColumn(out, F.lit(None).cast("double"))
    size = max(box.x1 - box.x0, box.y1 - box.y0) or 1.0

    def cells(bits: int) -> DataFrame:
        def at(name: str, lo: float):
            raw = F.floor((F.col(name) - F.lit(lo)) / F.lit(size / 2**bits)).cast("bigint")
            return F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), raw))
        return dem.withColumn("ix", at("x", box.x0)).withColumn("iy", at("y", box.y0))

    bits = _BITS * max(0, math.ceil(math.log(max(box.n / LEAF_ROWS, 1), 4) / _BITS))
    while bits < _MAX_BITS:
        fullest = cells(bits).groupBy("ix", "iy").count().agg(F.max("count")).first()[0]
        if fullest <= LEAF_ROWS:
            break
        bits += _BITS
    leaves = cells(bits)

    places = points.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    in_play = places.withColumns({"ix": F.lit(0).cast("bigint"), "iy": F.lit(0).cast("bigint")})
    fan = 2**_BITS
    for level in range(_BITS, bits + 1, _BITS):
        shift = bits - level
        boxes = leaves.groupBy(F.shiftright("ix", shift).alias("ix"), F.shiftright("iy", shift).alias("iy")).agg(
            F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"))
        child = in_play
        for name in ("ix", "iy"):
            step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(fan - 1).cast("bigint")))
            child = child.withColumn("_d", step).withColumn(name, F.col(name) * fan + F.col("_d")).drop("_d")
        met = lookup_join(child, boxes, ["ix", "iy"], "inner")
        gap = {a: F.greatest(F.lit(0.0), F.col(f"a{a}") - F.col(f"p{a}"), F.col(f"p{a}") - F.col(f"b{a}")) for a in "xy"}
        far = {a: F.greatest(F.abs(F.col(f"p{a}") - F.col(f"a{a}")), F.abs(F.col(f"p{a}") - F.col(f"b{a}"))) for a in "xy"}
        bound = F.min(far["x"] * far["x"] + far["y"] * far["y"]).over(W.partitionBy("px", "py"))
        in_play = (
            met.withColumn("_lb", gap["x"] * gap["x"] + gap["y"] * gap["y"])
            .withColumn("_ub", bound)
            .filter(F.col("_lb") <= F.col("_ub"))
            .select("px", "py", "ix", "iy")
        )
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    found = (
        lookup_join(in_play, leaves, ["ix", "iy"], "inner")
        .groupBy("px", "py")
        .agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "x", "y", "z")).alias("hit"))
        .select(F.col("px").alias("x"), F.col("py").alias("y"), F.col("hit.z").alias(out))
    )
    return lookup_join(points, found, ["x", "y"], "left")


def clip_to_surface(points: DataFrame, surface: DataFrame | None, mode: str = "depth") -> DataFrame:
    """Keep points at or below the surface.

    ``depth`` keeps ``depth <= 0``; ``surface`` also looks up the local surface.
    Without a surface nothing is clipped.
    """
    if surface is None:
        return points
    if mode not in ("depth", "surface"):
        raise ValueError(f"unknown mode {mode!r}")
    kept = points.filter("depth <= 0")
    return nearest_surface(kept, surface) if mode == "surface" else kept
