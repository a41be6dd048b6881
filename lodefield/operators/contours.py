"""Isolines of gridded slices: marching squares, then segments chained into lines.

Every operation is a grouping or an equi-join on cell keys.  Segments run with the higher
side on their left, so a crossing point has at most one segment before and one after it,
and lines are chained by doubling how far back each point looks: as many rounds as the
logarithm of the longest line, with no line or slice gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefield.functions.joins import lookup_join
from lodefield.sources.staging import staged

LEVELS = 12
# The round steps between levels, as multiples of a power of ten.
NICE_STEPS = (1.0, 2.0, 2.5, 5.0, 10.0)
_CORNERS = ("sw", "se", "ne", "nw")
_LINE = ["z0", "level"]


def _squares(cells: DataFrame) -> DataFrame:
    """``z0, cx, cy, sw, se, ne, nw``: four neighbouring cell means that are all there."""
    # A cell is the corner `c` of the square that starts at its own place less the corner's offset.
    offsets = {"sw": (0, 0), "se": (1, 0), "ne": (1, 1), "nw": (0, 1)}
    met = F.explode(F.array(*[
        F.struct(F.lit(c).alias("corner"), (F.col("cx") - dx).alias("sx"), (F.col("cy") - dy).alias("sy")) for c, (dx, dy) in offsets.items()]))
    at = cells.select("z0", "grade_mean", met.alias("m")).select("z0", "grade_mean", "m.*")
    squares = at.groupBy("z0", F.col("sx").alias("cx"), F.col("sy").alias("cy")).agg(
        *[F.max(F.when(F.col("corner") == c, F.col("grade_mean"))).alias(c) for c in _CORNERS])
    return squares.dropna(subset=list(_CORNERS))


def slice_levels(cells: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``z0, step``: the least round step of which the slice's span holds at most ``levels``; flat slices have none."""
    spans = cells.groupBy("z0").agg(F.min("grade_mean").alias("lo"), F.max("grade_mean").alias("hi")).filter("hi > lo")
    raw = (F.col("hi") - F.col("lo")) / F.lit(float(levels))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = None
    for nice in NICE_STEPS[:-1]:
        step = (F if step is None else step).when(F.lit(nice) * power >= raw, F.lit(nice) * power)
    return spans.select("z0", step.otherwise(F.lit(NICE_STEPS[-1]) * power).alias("step"))


def contour_segments(cells: DataFrame, cell: float = 100.0, levels: int = LEVELS) -> DataFrame:
    """Segments of the isolines through the centres of gridded cells (``z0, cx, cy, grade_mean``).

    A segment goes from the crossing ``cx, cy, side`` at ``x, y`` to ``to_cx, to_cy, to_side`` at ``to_x, to_y``,
    with the higher grade on its left.  ``side`` 0 is the grid line from a cell's centre to its right neighbour's, 1 to its upper
    neighbour's.  Levels are the multiples of the slice's step.  A corner at the level counts as above.  Of a square
    with two opposite corners above, the mean of all four says which are connected.  Squares with an empty or not
    finite corner have no segment, so lines end there and at the margin of the grid.
    """
    cells = cells.select("z0", "cx", "cy", "grade_mean").filter("abs(grade_mean) < double('Infinity') and not isnan(grade_mean)")
    # Used by the levels and the squares: written once.
    cells = staged(cells, "contour-cells")
    squares = lookup_join(_squares(cells), slice_levels(cells, levels), ["z0"], "inner")
    corners = [F.col(c) for c in _CORNERS]
    first = F.floor(F.least(*corners) / F.col("step")) + 1
    last = F.floor(F.greatest(*corners) / F.col("step"))
    # A level above the least corner and up to the greatest: the division may round, so this is tested again.
    cut = squares.withColumn("_m", F.explode(F.sequence(first - 1, last + 1)))
    cut = cut.withColumn("level", F.col("_m") * F.col("step")).filter(
        (F.col("level") > F.least(*corners)) & (F.col("level") <= F.greatest(*corners)))
    above = [c >= F.col("level") for c in corners]
    # Round the square's sides: right-handed from the lower one; a segment starts where the grade falls and ends where it rises.
    falls = [above[i] & ~above[(i + 1) % 4] for i in range(4)]
    rises = [~above[i] & above[(i + 1) % 4] for i in range(4)]
    saddle = (falls[0] & falls[2]) | (falls[1] & falls[3])
    joined = (corners[0] + corners[1] + corners[2] + corners[3]) / 4 >= F.col("level")
    only = F.when(rises[0], 0).when(rises[1], 1).when(rises[2], 2).otherwise(3)
    pairs = F.array(*[
        F.when(falls[i], F.struct(F.lit(i).alias("a"), F.when(saddle, F.when(joined, F.lit((i + 1) % 4)).otherwise(F.lit((i + 3) % 4))).otherwise(only).alias("b")))
        for i in range(4)])
    cut = cut.withColumn("_pair", F.explode(F.filter(pairs, lambda p: p.isNotNull())))
    return cut.select(*_LINE, *_crossing(F.col("_pair.a"), cell, ""), *_crossing(F.col("_pair.b"), cell, "to_"))


def _crossing(side: Column, cell: float, prefix: str) -> list[Column]:
    """Key and place of the level's crossing of a square's side (0 lower, 1 right, 2 upper, 3 left)."""
    def by_side(*values):
        return F.when(side == 0, values[0]).when(side == 1, values[1]).when(side == 2, values[2]).otherwise(values[3])

    cx, cy = F.col("cx"), F.col("cy")
    key_x, key_y = by_side(cx, cx + 1, cx, cx), by_side(cy, cy, cy + 1, cy)
    sw, se, ne, nw = (F.col(c) for c in _CORNERS)
    # From left to right and upwards whichever square asks, so that both neighbours get the same place.
    low, high = by_side(sw, se, nw, sw), by_side(se, ne, ne, nw)
    part = (F.col("level") - low) / (high - low)
    upright = side.isin(1, 3)
    half = F.lit(0.5)
    return [
        key_x.cast("bigint").alias(f"{prefix}cx"), key_y.cast("bigint").alias(f"{prefix}cy"), F.when(upright, 1).otherwise(0).alias(f"{prefix}side"),
        ((key_x + half + F.when(upright, F.lit(0.0)).otherwise(part)) * F.lit(float(cell))).alias(f"{prefix}x"),
        ((key_y + half + F.when(upright, part).otherwise(F.lit(0.0))) * F.lit(float(cell))).alias(f"{prefix}y"),
    ]


def _node(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("cx", "cy", "side")])


def _look_back(links: DataFrame) -> DataFrame:
    """``z0, level, node, back, steps, least, ended`` for ``links`` (``z0, level, node, before``; before: null at a line's start).

    ``back`` is the start of the line, ``steps`` away; on a closed line, which has none, ``least`` is its least node.
    """
    ended = F.col("before").isNull()
    state = staged(links.select(
        *_LINE, "node", F.coalesce("before", "node").alias("back"), F.when(ended, 0).otherwise(1).cast("bigint").alias("steps"),
        F.least(F.col("node"), F.coalesce("before", "node")).alias("least"), ended.alias("ended")), "contour-links")
    while True:
        further = state.select(*_LINE, F.col("node").alias("back"), F.col("back").alias("_back"), F.col("steps").alias("_steps"),
                               F.col("least").alias("_least"), F.col("ended").alias("_ended"))
        # Points that have reached their line's start stay as they are; only the others look further.
        met = state.filter("not ended").join(further, [*_LINE, "back"])
        # Until no point reaches a start any more and none finds a lesser node, which then is the least of its closed line.
        doubled = met.select(
            *_LINE, "node", F.col("_back").alias("back"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"),
            F.col("_ended").alias("ended"), (F.col("_ended") | (F.col("_least") < F.col("least"))).alias("moved"))
        done = state.filter("ended").withColumn("moved", F.lit(False))
        state = staged(done.unionByName(doubled), "contour-links")
        if state.filter("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def contour_lines(segments: DataFrame) -> DataFrame:
    """``z0, level, line_cx, line_cy, line_side, closed, place, x, y``: the points of each line in order, from 0.

    A line is named by its first crossing: where an open line starts, the least crossing (by cx, cy, side) of a closed
    one, whose last point is followed by its first.
    """
    segments = staged(segments, "contour-segments")
    starts = segments.select(*_LINE, _node().alias("node"), "x", "y")
    ends = segments.select(*_LINE, _node("to_").alias("node"), F.col("to_x").alias("x"), F.col("to_y").alias("y"), _node().alias("before"))
    points = staged(
        starts.withColumn("before", F.lit(None).cast(ends.schema["before"].dataType)).unionByName(ends)
        .groupBy(*_LINE, "node").agg(F.max("before").alias("before"), F.max("x").alias("x"), F.max("y").alias("y")), "contour-points")
    found = _look_back(points.select(*_LINE, "node", "before"))
    opened = found.filter("ended").select(*_LINE, "node", "back", "steps").withColumn("closed", F.lit(False))
    # A closed line is cut before its least node and followed again.
    loops = points.join(found.filter("not ended").select(*_LINE, "node", "least"), [*_LINE, "node"])
    cut = loops.select(*_LINE, "node", F.when(F.col("node") != F.col("least"), F.col("before")).alias("before"))
    closed = _look_back(cut).select(*_LINE, "node", "back", "steps").withColumn("closed", F.lit(True))
    return points.join(opened.unionByName(closed), [*_LINE, "node"]).select(
        *_LINE, *[F.col(f"back.{c}").alias(f"line_{c}") for c in ("cx", "cy", "side")], "closed", F.col("steps").alias("place"), "x", "y")
