"""Outliers, features, scaling and tails.

Each step that needs global statistics is a fit that returns a small parameter
object and an apply that uses it as literals, so applying never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.functions.quantiles import exact_quantiles, quantiles_and

BASE_FEATURES = ("x", "y", "depth", "r", "xy", "depth2", "r2", "depth_norm")


@dataclass(frozen=True)
class ColumnStats:
    n: int
    mean: float | None
    std: float | None
    q1: float | None
    q3: float | None


def fit_outliers(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, ColumnStats]:
    """Count, mean, spread and quartiles per column; NULL and NaN are left out."""
    aggs = [f(c).alias(f"{p}_{c}") for c in cols for p, f in (("count", F.count), ("avg", F.avg), ("std", F.stddev_samp))]
    if approx:
        row, quart = df.agg(*aggs).first(), exact_quantiles(df, cols, [0.25, 0.75], approx=True)
    else:
        quart, row = quantiles_and(df, cols, [0.25, 0.75], aggs)
    return {c: ColumnStats(row[f"count_{c}"], row[f"avg_{c}"], row[f"std_{c}"], *(quart[c] or (None, None))) for c in cols}


def apply_outliers(df: DataFrame, stats: dict[str, ColumnStats], z_limit: float = 4.0) -> DataFrame:
    """Keep rows inside both the z-score and the quartile fence of every column."""
    keep = F.lit(True)
    for c, s in stats.items():
        if s.n < 2 or s.std is None:
            return df.filter(F.lit(False))
        fence, reach = 1.5 * (s.q3 - s.q1), z_limit * (s.std + 1e-9)
        lo, hi = max(s.q1 - fence, s.mean - reach), min(s.q3 + fence, s.mean + reach)
        keep &= F.col(c).between(F.lit(lo), F.lit(hi))
    return df.filter(keep)


def remove_outliers(df: DataFrame, cols: list[str], z_limit: float = 4.0) -> DataFrame:
    return apply_outliers(df, fit_outliers(df, cols), z_limit)


def add_features(df: DataFrame) -> DataFrame:
    x, y, d = F.col("x"), F.col("y"), F.col("depth")
    r = F.sqrt(x * x + y * y)
    return df.withColumns({"r": r, "xy": x * y, "depth2": d * d, "r2": r * r})


def fit_depth_norm(df: DataFrame) -> tuple[float, float]:
    row = df.agg(F.min("depth").alias("lo"), F.max("depth").alias("hi")).first()
    return row.lo, row.hi


def apply_depth_norm(df: DataFrame, span: tuple[float, float]) -> DataFrame:
    lo, hi = span
    if lo is None:
        return df.withColumn("depth_norm", F.lit(None).cast("double"))
    return df.withColumn("depth_norm", (F.col("depth") - F.lit(lo)) / F.lit(max(hi - lo, 1e-9)))


def engineer_features(df: DataFrame) -> DataFrame:
    return apply_depth_norm(add_features(df), fit_depth_norm(df))


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation; zero spread divides by 1."""
    aggs = [f(c).alias(f"{p}_{c}") for c in cols for p, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"{c}_sc": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def scale_features(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, cols))


def fit_tails(df: DataFrame, target: str = "grade", k: float = 0.02) -> tuple[float, float] | None:
    found = exact_quantiles(df, [target], [k, 1 - k])[target]
    return (found[0], found[1]) if found else None


def select_tails(df: DataFrame, limits: tuple[float, float] | None, target: str = "grade") -> DataFrame:
    """Rows at or below the low limit and rows at or above the high one.

    ``tail`` names the side; a row in both tails comes twice.
    """
    if limits is None:
        return df.withColumn("tail", F.lit("low")).filter(F.lit(False))
    v = F.col(target)
    sides = F.array(F.when(v <= F.lit(limits[0]), F.lit("low")), F.when(v >= F.lit(limits[1]), F.lit("high")))
    return df.withColumn("tail", F.explode(F.array_compact(sides)))
