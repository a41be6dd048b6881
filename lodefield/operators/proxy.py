"""Rolling mean down each hole, without giving a whole hole to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodefield.functions.joins import lookup_join
from lodefield.sources.staging import staged

CHUNK_ROWS = 200_000


def rank_chunks(df: DataFrame, keys: list[str], chunk_rows: int, rows: int | None = None) -> DataFrame:
    """``df`` with ``_chunk``: pieces of the exact order of ``keys``, of about ``chunk_rows`` rows however the values repeat.

    Spark samples the splitters.  The rows are written with their chunk, so every later pass sees the same cut.
    """
    pieces = max(1, -(-(df.count() if rows is None else rows) // chunk_rows))
    return staged(df.repartitionByRange(pieces, *keys).withColumn("_chunk", F.spark_partition_id()), "rank-chunks")


def rolling_mean(
    df: DataFrame,
    value: str = "grade",
    out: str = "kriging_pred",
    group: str = "hole_id",
    order: tuple[str, str] = ("depth", "sample_id"),
    window: int = 3,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Mean of the row and up to ``window - 1`` rows before it in its group's order.

    Groups of more than ``chunk_rows`` rows are cut by the order of (depth, id) into
    chunks that roll in parallel, also where all their rows share one depth; each chunk
    also sees the last rows of the chunks before it.  Rows without a group are one group,
    missing depths come first, and missing values are left out of a mean.
    """
    by, tie = order
    back = window - 1

    def rolled(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn(out, F.avg(value).over(W.partitionBy(*keys).orderBy(by, tie).rowsBetween(-back, 0)))

    # A struct equals another where both hold null, unlike the bare column.
    keyed = df.withColumn("_group", F.struct(F.col(group).alias("g")))
    sizes = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    counted = staged(sizes.filter(F.col("_n") > chunk_rows), "long-groups")
    n_long, long_rows = counted.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n_long:
        return rolled(df, group)
    long_groups = counted.select("_group")
    short = lookup_join(keyed, long_groups, ["_group"], "left_anti", salt_by=tie, small_rows=n_long).drop("_group")
    long = lookup_join(keyed, long_groups, ["_group"], "left_semi", salt_by=tie, small_rows=n_long).drop("_group")
    rows = rank_chunks(long, [group, by, tie], chunk_rows, long_rows)

    latest = W.partitionBy(group, "_chunk").orderBy(F.desc(by), F.desc(tie))
    ends = (
        rows.select(group, "_chunk", by, tie, value)
        .withColumn("_rn", F.row_number().over(latest))
        .filter(F.col("_rn") <= back)
        .drop("_rn")
    )
    # Ends hold at most `back` rows per chunk; a chunk's halo is the last `back` of all before it.
    per_chunk = ends.groupBy(group, "_chunk").agg(F.collect_list(F.struct(by, tie, value)).alias("_ends"))
    before = W.partitionBy(group).orderBy("_chunk").rowsBetween(-back, -1)
    halo = (
        per_chunk.withColumn("_prev", F.flatten(F.collect_list("_ends").over(before)))
        .select(group, "_chunk", F.explode(F.slice(F.sort_array("_prev", asc=False), 1, back)).alias("_row"))
        .select(group, "_chunk", "_row.*")
        .withColumn("_halo", F.lit(True))
    )
    seen = rows.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    done = rolled(seen, group, "_chunk").filter(~F.col("_halo")).drop("_halo", "_chunk")
    return rolled(short, group).unionByName(done)
