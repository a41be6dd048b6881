"""Ridge fusion of model predictions and stacking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.functions.moments import Moments, moments
from lodefield.operators.split import add_fold
from lodefield.operators.trees import META_PARAMS, TreeParams, fit_trees, score_trees


@dataclass(frozen=True)
class FusionWeights:
    preds: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        return sum((F.col(p) * F.lit(w) for p, w in zip(self.preds, self.weights)), F.lit(0.0)) + F.lit(self.intercept)

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = ", ".join(f"`w_{p}` double" for p in self.preds) + ", intercept double"
        return spark.createDataFrame([(*self.weights, self.intercept)], schema)


def ridge_from_moments(m: Moments, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge with an unpenalised intercept; the last moment column is the target."""
    p = len(m.cols) - 1
    w = np.linalg.solve(m.cross[:p, :p] + alpha * np.eye(p), m.cross[:p, p])
    return w, float(m.mean[p] - w @ m.mean[:p])


def project_weights(w: np.ndarray) -> np.ndarray:
    """Negative weights become 0 and the rest sum to 1; uniform when none is positive."""
    clipped = np.maximum(w, 0.0)
    total = clipped.sum()
    return clipped / total if total > 0 else np.full(len(w), 1.0 / len(w))


def fusion_from_moments(m: Moments, preds: list[str], alpha: float = 1.0, intercept: str = "centred") -> FusionWeights:
    """Projected ridge weights.

    ``centred`` recomputes the intercept for the projected weights, so the fused
    estimate is unbiased; ``raw`` keeps the one of the unprojected fit.
    """
    raw, b = ridge_from_moments(m, alpha)
    w = project_weights(raw)
    if intercept == "centred":
        b = float(m.mean[-1] - w @ m.mean[:-1])
    elif intercept != "raw":
        raise ValueError(f"unknown intercept {intercept!r}")
    return FusionWeights(tuple(preds), tuple(w.tolist()), b)


def fit_fusion(df: DataFrame, preds: list[str], truth: str = "grade", alpha: float = 1.0, intercept: str = "centred") -> FusionWeights:
    return fusion_from_moments(moments(df, [*preds, truth]), preds, alpha, intercept)


def apply_fusion(df: DataFrame, fitted: FusionWeights, out: str = "fusion_pred") -> DataFrame:
    return df.withColumn(out, fitted.column())


def fold_fusions(
    folded: DataFrame, preds: list[str], truth: str = "grade", alpha: float = 1.0, intercept: str = "raw", fold: str = "fold",
) -> tuple[dict[int, FusionWeights], FusionWeights]:
    """Weights fitted without each fold, and on all rows, from one pass of moments per fold."""
    parts = moments(folded, [*preds, truth], by=fold)
    total = None
    for part in parts.values():
        total = part if total is None else _merge(total, part)
    return {f: fusion_from_moments(total.minus(part), preds, alpha, intercept) for f, part in parts.items()}, fusion_from_moments(total, preds, alpha, intercept)


def _merge(a: Moments, b: Moments) -> Moments:
    n = a.n + b.n
    gap = b.mean - a.mean
    return Moments(a.cols, n, (a.mean * a.n + b.mean * b.n) / n, a.cross + b.cross + np.outer(gap, gap) * (a.n * b.n / n))


def out_of_fold_ridge(
    df: DataFrame, preds: list[str], truth: str = "grade", k: int = 5, seed: int = 42, key: str = "sample_id", out: str = "oof_ridge",
    alpha: float = 1.0, intercept: str = "raw",
) -> tuple[DataFrame, FusionWeights]:
    """Each row's ridge estimate from the other folds, and the full fit."""
    folded = add_fold(df, k, seed, key, "fold")
    by_fold, full = fold_fusions(folded, preds, truth, alpha, intercept)
    value = F.coalesce(*[F.when(F.col("fold") == f, w.column()) for f, w in sorted(by_fold.items())])
    return folded.withColumn(out, value), full


def fit_stack(
    df: DataFrame, preds: list[str], truth: str = "grade", k: int = 5, params: TreeParams = META_PARAMS, seed: int = 42, key: str = "sample_id",
) -> tuple[GBTRegressionModel, FusionWeights]:
    """Boosted trees on the out-of-fold ridge column and the predictions."""
    meta, full = out_of_fold_ridge(df, preds, truth, k, seed, key, "_ridge")
    return fit_trees(meta, ["_ridge", *preds], truth, params), full


def apply_stack(df: DataFrame, stack: tuple[GBTRegressionModel, FusionWeights], preds: list[str], out: str = "fusion_pred") -> DataFrame:
    model, full = stack
    return score_trees(apply_fusion(df, full, "_ridge"), model, ["_ridge", *preds], out).drop("_ridge")
