"""Regular 3-D blocks as key columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefield.functions.binning import uniform_bin

AXES = ("x", "y", "depth")
# Fixed value: the default number of blocks along x, y and depth.
DEFAULT_BLOCKS = (5, 5, 3)


@dataclass(frozen=True)
class Grid:
    spans: tuple[tuple[float, float], ...]
    counts: tuple[int, ...]

    def width(self, axis: int) -> float:
        lo, hi = self.spans[axis]
        return (hi - lo) / self.counts[axis]


def fit_grid(df: DataFrame, counts: tuple[int, ...] = DEFAULT_BLOCKS) -> Grid:
    row = df.agg(*[f(a).alias(f"{p}_{a}") for a in AXES for p, f in (("lo", F.min), ("hi", F.max))]).first()
    return Grid(tuple((row[f"lo_{a}"], row[f"hi_{a}"]) for a in AXES), tuple(counts))


def block_id(grid: Grid) -> Column:
    bi, bj, bk = F.col("bi"), F.col("bj"), F.col("bk")
    return (bi * F.lit(grid.counts[1]) + bj) * F.lit(grid.counts[2]) + bk


def _cells(axis: int, grid: Grid, margin: float) -> Column:
    """Cells along one axis whose span, widened by ``margin`` cell widths, holds the value."""
    lo, n, w = grid.spans[axis][0], grid.counts[axis], grid.width(axis)
    if w <= 0:
        return F.array(F.lit(0))
    pos = (F.col(AXES[axis]) - F.lit(lo)) / F.lit(w)
    first = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil(pos - F.lit(1.0 + margin)).cast("int")))
    last = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(pos + F.lit(margin)).cast("int")))
    return F.sequence(first, last)


def assign_blocks(df: DataFrame, grid: Grid, edges: str = "half_open") -> DataFrame:
    """Add ``bi, bj, bk`` and ``block_id``.

    ``half_open`` puts each row in one block; ``shared`` puts a row on a common
    edge into every block that touches it.
    """
    if edges == "half_open":
        out = df.withColumns({k: uniform_bin(F.col(AXES[i]), *grid.spans[i], grid.counts[i])
                              for i, k in enumerate(("bi", "bj", "bk"))})
    elif edges == "shared":
        out = df
        for i, k in enumerate(("bi", "bj", "bk")):
            out = out.withColumn(k, F.explode(_cells(i, grid, 0.0)))
    else:
        raise ValueError(f"unknown edges {edges!r}")
    return out.withColumn("block_id", block_id(grid))


def spread_to_blocks(df: DataFrame, grid: Grid, margin: float) -> DataFrame:
    """Copy each row to its own block and to those within ``margin`` cell widths of it."""
    out = df
    for i, k in enumerate(("bi", "bj", "bk")):
        out = out.withColumn(k, F.explode(_cells(i, grid, margin)))
    return out.withColumn("block_id", block_id(grid)).drop("bi", "bj", "bk")


def block_counts(df: DataFrame) -> DataFrame:
    """Rows per non-empty block."""
    return df.groupBy("block_id", "bi", "bj", "bk").agg(F.count(F.lit(1)).alias("n"))


def block_rmse(df: DataFrame, truth: str = "grade", pred: str = "kriging_pred") -> DataFrame:
    err = F.col(pred) - F.col(truth)
    return df.groupBy("block_id").agg(
        F.count(pred).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"))
