"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``limit`` rows (stops counting beyond it)."""
    return df.limit(limit + 1).count() <= limit


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_by: str | None = None,
    salts: int = 32,
    max_broadcast: int = BROADCAST_ROWS,
    small_rows: int | None = None,
) -> DataFrame:
    """Equi join of a fact side with a dimension side.

    The dimension is broadcast only after its row count is checked (``small_rows``
    when the caller has counted it already).  A larger one
    is joined by shuffle on (key, salt): a hot key's fact rows are spread over
    ``salts`` tasks and the dimension row is copied to each of them.
    """
    if big.isStreaming:
        return big.join(small, on, how)
    fits = is_small(small, max_broadcast) if small_rows is None else small_rows <= max_broadcast
    if fits:
        return big.join(F.broadcast(small), on, how)
    source = F.hash(*[F.col(c) for c in ([salt_by] if salt_by else big.columns)])
    left = big.withColumn("_salt", F.pmod(source, F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
