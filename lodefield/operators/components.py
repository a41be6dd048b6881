"""Principal components: distributed moments, p x p eigenproblem on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.functions.moments import moments

MAX_FEATURES = 500


@dataclass(frozen=True)
class Components:
    cols: tuple[str, ...]
    mean: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]
    variances: tuple[float, ...]


def fit_components(df: DataFrame, cols: list[str], n_components: int = 5) -> Components | None:
    """Centred, unscaled components; each one's largest loading is positive."""
    if not cols:
        return None
    if len(cols) > MAX_FEATURES:
        raise ValueError("too many features for a driver-side eigenproblem")
    m = moments(df, cols)
    values, vectors = np.linalg.eigh(m.cov)
    order = np.argsort(values)[::-1][: max(1, min(n_components, len(cols)))]
    picked = vectors[:, order].T
    signs = np.sign(picked[np.arange(len(order)), np.abs(picked).argmax(axis=1)])
    picked = picked * signs[:, None]
    return Components(
        tuple(cols), tuple(m.mean.tolist()), tuple(map(tuple, picked.tolist())), tuple(values[order].tolist()))


def apply_components(df: DataFrame, fitted: Components | None) -> DataFrame:
    if fitted is None:
        return df
    out = {}
    for i, loading in enumerate(fitted.loadings, start=1):
        out[f"PC{i}"] = sum(
            ((F.col(c) - F.lit(m)) * F.lit(w) for c, m, w in zip(fitted.cols, fitted.mean, loading)), F.lit(0.0))
    return df.withColumns(out)
