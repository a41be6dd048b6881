"""From collars and assay intervals to 3-D sample points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.functions.joins import lookup_join

NUMERIC = ("d_from", "d_to", "grade")
POINT_COLUMNS = ("x", "y", "depth", "grade")


def parse_intervals(intervals: DataFrame, cols: tuple[str, ...] = NUMERIC) -> DataFrame:
    """Keep intervals whose numbers parse and are finite."""
    as_text = [c for c in cols if intervals.schema[c].dataType.typeName() != "double"]
    parsed = intervals.withColumns({c: F.col(c).try_cast("double") for c in as_text}) if as_text else intervals
    keep = F.lit(True)
    for c in cols:
        # One test for text (NULL), infinities and NaN, which sorts above infinity.
        keep &= F.abs(c) < F.lit(float("inf"))
    return parsed.filter(keep)


def non_empty(intervals: DataFrame) -> DataFrame:
    return intervals.filter("d_to > d_from")


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL or NaN anywhere."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in doubles}).na.drop()


def check_unique_holes(collars: DataFrame) -> int:
    """Number of rows; an error when a hole has several."""
    row = collars.groupBy("hole_id").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if (row.most or 0) > 1:
        raise ValueError("a hole has several collar rows")
    return row.n or 0


def join_collars(intervals: DataFrame, collars: DataFrame, check: bool = True) -> DataFrame:
    """Inner join on hole; holes or intervals without a partner vanish."""
    rows = check_unique_holes(collars) if check else None
    return lookup_join(intervals, collars, ["hole_id"], "inner", small_rows=rows)


def composite_points(intervals: DataFrame, step: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Expand each non-empty interval (with collar ``e``, ``n``) to points along it.

    k = max(1, int(length/step)) evenly spaced points, both ends included; k = 1 is
    the upper end alone.  ``point_idx`` numbers the points of an interval.
    """
    length = F.col("d_to") - F.col("d_from")
    k = F.greatest(F.lit(1), F.floor(length / F.lit(float(step))).cast("int"))
    points = (
        non_empty(intervals)
        .withColumn("_k", k)
        .withColumn("point_idx", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    )
    along = F.when(F.col("_k") == 1, F.lit(0.0)).otherwise(F.col("point_idx") * length / (F.col("_k") - 1))
    return points.select(
        F.col("e").alias("x"),
        F.col("n").alias("y"),
        (-(F.col("d_from") + along) + F.lit(0.0)).alias("depth"),
        "grade",
        "hole_id",
        *keep,
        "point_idx",
    )


def build_samples(
    collars: DataFrame,
    intervals: DataFrame,
    step: float = 2.0,
    id_col: str = "interval_id",
    keep: tuple[str, ...] = (),
    check: bool = True,
) -> DataFrame:
    """Collars and intervals to clean points with a stable ``sample_id``."""
    geometry = collars.select("hole_id", "e", "n")
    joined = join_collars(non_empty(parse_intervals(intervals)), geometry, check)
    points = composite_points(joined, step, keep=(id_col, *keep))
    with_id = points.withColumn("sample_id", F.concat_ws(":", F.col(id_col).cast("string"), F.col("point_idx")))
    return with_id.drop(id_col, "point_idx").na.drop(subset=[*POINT_COLUMNS, "hole_id"])


def attach_attributes(points: DataFrame, collars: DataFrame, attributes: list[str], on_conflict: str = "expand") -> DataFrame:
    """Left-join collar attributes; points without a collar row keep NULLs.

    Each attribute is a distinct (hole, value) list of its own, so two values for one
    hole multiply its points; ``on_conflict="error"`` refuses that.
    """
    out = points
    for name in attributes:
        pairs = collars.select("hole_id", name).distinct()
        rows = check_unique_holes(pairs) if on_conflict == "error" else None
        out = lookup_join(out, pairs, ["hole_id"], "left", small_rows=rows)
    return out


def union_sets(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sets in one frame, labelled in ``_set``; duplicates are kept."""
    return train.withColumn("_set", F.lit("Train")).unionByName(test.withColumn("_set", F.lit("Test")))
