"""Counts, means and centred cross products in two aggregation passes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """``cross`` is the p x p matrix of centred cross products."""

    cols: tuple[str, ...]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    @property
    def cov(self) -> np.ndarray:
        return self.cross / max(self.n - 1, 1)

    def minus(self, other: "Moments") -> "Moments":
        """Moments of the rows left when ``other``'s rows are taken out."""
        n = self.n - other.n
        if n <= 0:
            raise ValueError("no rows left")
        mean = (self.mean * self.n - other.mean * other.n) / n
        gap = other.mean - mean
        cross = self.cross - other.cross - np.outer(gap, gap) * (n * other.n / self.n)
        return Moments(self.cols, n, mean, cross)


def means(df: DataFrame, cols: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: (row[c] or 0.0) for c in cols}


def moments(df: DataFrame, cols: list[str], by: str | None = None) -> Moments | dict[int, Moments]:
    """Two-pass moments, for all rows or for each value of a low-cardinality ``by``.

    Values are shifted by their global mean before products are summed, which keeps
    large coordinates from swamping the sums.
    """
    shift = means(df, cols)
    centred = {c: F.col(c) - F.lit(shift[c]) for c in cols}
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(centred[c]).alias(f"s{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(centred[cols[i]] * centred[cols[j]]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    rows = df.groupBy(by).agg(*aggs).collect() if by else df.agg(*aggs).collect()

    def build(row) -> Moments:
        n = row["n"]
        s = np.array([row[f"s{i}"] or 0.0 for i in range(p)])
        prod = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                prod[i, j] = prod[j, i] = row[f"p{i}_{j}"] or 0.0
        base = np.array([shift[c] for c in cols])
        if n == 0:
            return Moments(tuple(cols), 0, base, prod)
        return Moments(tuple(cols), n, base + s / n, prod - np.outer(s, s) / n)

    if by:
        return {row[by]: build(row) for row in rows}
    return build(rows[0])
