"""Randomness that is a function of a seed and the row's key.

``rand``/``randn``/``sample`` depend on how rows are partitioned, so a recomputed
partition could draw other values.  These columns depend on the key alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int | str, keys: tuple) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


HASH_TOP = 2**60 - 1


def keyed_hash(seed: int | str, *keys: str | Column) -> Column:
    """60-bit non-negative integer (BIGINT), for ranking rows at random."""
    return F.conv(F.substring(_digest(seed, keys), 1, 15), 16, 10).cast("bigint")


def keyed_uniform(seed: int | str, *keys: str | Column) -> Column:
    """Uniform double strictly inside (0, 1)."""
    bits = F.conv(F.substring(_digest(seed, keys), 1, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


def keyed_normal(seed: int | str, *keys: str | Column) -> Column:
    """Standard normal by Box-Muller on two keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(keyed_uniform(f"{seed}a", *keys)))
    return radius * F.cos(F.lit(2.0 * math.pi) * keyed_uniform(f"{seed}b", *keys))
