"""Rebalancing of extreme grades: exact-size oversampling and jittered copies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodefield.functions.keyed import keyed_hash, keyed_normal
from lodefield.operators.clean import fit_tails, select_tails

# Fixed value: tail rows drawn unless the caller says otherwise.
MAX_DRAWS = 1000
# Hash space of keyed_hash cut into equal ranges; fixes the size of the offset table.
_RANGES = 65536
_RANGE_WIDTH = 2**60 // _RANGES


def draw_tails(tails: DataFrame, draws: int, seed: int, key: str = "sample_id") -> DataFrame:
    """``draws`` rows of ``tails`` with replacement, as a function of seed and key.

    Tail rows are ordered by keyed hash and draw i takes position
    ``hash(seed, i) mod n``.  Only hash ranges that hold a drawn position are ranked:
    the count per range gives each range's first position.
    """
    marked = tails.withColumn("_h", keyed_hash(f"{seed}t", key, "tail")).withColumn(
        "_range", F.call_function("div", F.col("_h"), F.lit(_RANGE_WIDTH)))
    sizes = marked.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    m = min(total, draws)
    if m == 0:
        return tails.withColumn("draw", F.lit(0).cast("bigint")).filter(F.lit(False))
    spark = tails.sparkSession
    # Both tables below are bounded: 65,536 ranges and `draws` positions.
    starts = sizes.toPandas().sort_values("_range", ignore_index=True)
    starts["_start"] = starts["_n"].cumsum() - starts["_n"]
    positions = spark.range(m).select(
        F.col("id").alias("draw"), F.pmod(keyed_hash(f"{seed}d", "id"), F.lit(total)).alias("_pos")).toPandas()
    at = np.searchsorted(starts["_start"].to_numpy(), positions["_pos"].to_numpy(), side="right") - 1
    picks = positions.assign(_range=starts["_range"].to_numpy()[at], _start=starts["_start"].to_numpy()[at])
    picks = F.broadcast(spark.createDataFrame(picks))
    order = W.partitionBy("_range").orderBy("_h", key, "tail")
    ranked = marked.join(picks.select("_range", "_start").distinct(), "_range").withColumn(
        "_pos", F.col("_start") + F.row_number().over(order) - 1).drop("_start")
    picked = ranked.join(picks, ["_range", "_pos"])
    return picked.drop("_h", "_range", "_start", "_pos")


def oversample_extremes(
    df: DataFrame, target: str = "grade", k: float = 0.02, seed: int = 42, key: str = "sample_id", draws: int = MAX_DRAWS,
) -> DataFrame:
    """Append min(tail rows, ``draws``) tail rows drawn with replacement; their key is suffixed."""
    tails = select_tails(df, fit_tails(df, target, k), target)
    copies = draw_tails(tails, draws, seed, key)
    copies = copies.withColumn(key, F.concat_ws("", F.col(key), F.lit("+o"), F.col("draw")))
    return df.unionByName(copies.select(*df.columns))


def jitter_extremes(
    df: DataFrame, target: str = "grade", k: float = 0.02, jitter: float = 0.01, seed: int = 42, key: str = "sample_id",
) -> DataFrame:
    """Append each tail row with normal noise of std ``max(std*jitter, 1e-6)`` on the target."""
    spread = df.agg(F.stddev_samp(target)).first()[0]
    tails = select_tails(df, fit_tails(df, target, k), target)
    scale = max((spread or 0.0) * jitter, 1e-6)
    noise = keyed_normal(seed, key, "tail") * F.lit(scale)
    copies = tails.withColumn(target, F.col(target) + noise).withColumn(
        key, F.concat_ws("", F.col(key), F.lit("+j"), F.col("tail")))
    return df.unionByName(copies.select(*df.columns))
