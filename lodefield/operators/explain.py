"""Diagnostics of a fitted tree model as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.functions.keyed import keyed_uniform
from lodefield.functions.quantiles import exact_quantiles
from lodefield.operators.split import add_fold, subsample
from lodefield.operators.trees import TreeParams, bin_values, binned, fit_grouped, fit_trees, grouped_rows, rmse_of, run_parallel, score_trees
from lodefield.sources.staging import staged

# Features in dependence tables, learning-curve sizes.
TOP_FEATURES = 4
CURVE_SIZES = (0.1, 0.28, 0.46, 0.64, 0.82, 1.0)


def top_features(model: GBTRegressionModel, features: list[str], n: int) -> list[tuple[str, float]]:
    gains = model.featureImportances.toArray()
    order = sorted(range(len(features)), key=lambda i: (-gains[i], i))[:n]
    return [(features[i], float(gains[i])) for i in order]


def feature_importance(spark: SparkSession, model: GBTRegressionModel, features: list[str], n: int = 20) -> DataFrame:
    rows = [(i + 1, name, gain) for i, (name, gain) in enumerate(top_features(model, features, n))]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def learning_curve(
    train: DataFrame, features: list[str], label: str = "grade", sizes: tuple[float, ...] = CURVE_SIZES, k: int = 5,
    params: TreeParams = TreeParams(), key: str = "sample_id", parallelism: int = 4,
) -> DataFrame:
    """Mean train and validation RMSE over k folds for nested shares of the training rows.

    All fits share the bins of the features of ``train``; rows of equal bins, fold and size are one weighted row, and their sum of
    squares within completes the errors, which are those of all rows.
    """
    if params.row_share < 1.0:
        return _curve(train.sparkSession, _row_trials(train, features, label, sizes, k, params, key, parallelism))
    values = bin_values(train, features)
    # The least of the sizes that uses a row; rows of equal bins, fold and size are one.
    u = keyed_uniform(f"{params.seed}c", key)
    ordered = sorted(sizes)
    used_from = F.coalesce(*[F.when(u < size, i) for i, size in enumerate(ordered)], F.lit(len(ordered)))
    folded = add_fold(train.select(key, *features, label), k, params.seed, key).withColumn("_from", used_from)
    rows = staged(grouped_rows(folded, values, label, "fold", "_from"), "curve")

    def rmse(df: DataFrame, model) -> float:
        gap = F.col("_p") - F.col(label)
        return score_trees(df, model, features, "_p").agg(F.sqrt(F.sum(F.col("_within") + F.col("_n") * gap * gap) / F.sum("_n"))).first()[0]

    def one(size: float, fold: int):
        used = rows.filter((F.col("fold") != fold) & (F.col("_from") <= ordered.index(size)))
        model = fit_grouped(used, features, label, params)
        return float(size), fold, int(used.agg(F.sum("_n")).first()[0] or 0), rmse(used, model), rmse(rows.filter(F.col("fold") == fold), model)

    return _curve(train.sparkSession, run_parallel(train.sparkSession, [lambda s=s, f=f: one(s, f) for s in sizes for f in range(k)], parallelism))


def _row_trials(train: DataFrame, features: list[str], label: str, sizes: tuple[float, ...], k: int, params: TreeParams, key: str, parallelism: int) -> list:
    """Trials of trees that draw single rows."""
    rows = add_fold(train.select(key, *features, label), k, params.seed, key).withColumn(
        "_u", keyed_uniform(f"{params.seed}c", key)).persist()

    def one(size: float, fold: int):
        used = rows.filter((F.col("fold") != fold) & (F.col("_u") < size))
        model = fit_trees(used, features, label, params)
        n = used.count()
        fit_rmse = rmse_of(score_trees(used, model, features, "_p"), label, "_p")
        held_rmse = rmse_of(score_trees(rows.filter(F.col("fold") == fold), model, features, "_p"), label, "_p")
        return float(size), fold, n, fit_rmse, held_rmse

    try:
        return run_parallel(train.sparkSession, [lambda s=s, f=f: one(s, f) for s in sizes for f in range(k)], parallelism)
    finally:
        rows.unpersist()


def _curve(spark: SparkSession, records: list) -> DataFrame:
    trials = spark.createDataFrame(
        records, "size double, fold int, train_rows bigint, train_rmse double, val_rmse double")
    return trials.groupBy("size").agg(
        F.avg("train_rows").alias("train_rows"), F.avg("train_rmse").alias("train_rmse"), F.avg("val_rmse").alias("val_rmse"),
        F.count(F.lit(1)).alias("folds"))


def partial_dependence(
    df: DataFrame, model: GBTRegressionModel, features: list[str], top: int = TOP_FEATURES, points: int = 100,
) -> DataFrame:
    """Mean prediction with one feature set to each value between its 5 % and 95 % quantiles."""
    chosen = [name for name, _ in top_features(model, features, top)]
    bounds = exact_quantiles(df, chosen, [0.05, 0.95])
    index = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    # Rows that go the same way at every threshold of the model are one row with their number.
    known = leaves_of(model)
    thresholds = {c: sorted({t for path in known.paths for f, *ends in path if features[f] == c for t in ends if np.isfinite(t)}) for c in features}
    marked, names = binned(df.select(*[F.col(c).cast("double").alias(c) for c in features]), thresholds)
    groups = staged(marked.groupBy(*names.values()).agg(*[F.min(c).alias(c) for c in features], F.count(F.lit(1)).alias("_n")), "ways")
    moved = groups.select(*features, "_n").withColumn("feature", F.explode(F.array(*[F.lit(c) for c in chosen]))).withColumn("_i", index)
    value = F.coalesce(*[
        F.when(F.col("feature") == c, F.lit(bounds[c][0]) + F.col("_i") * F.lit((bounds[c][1] - bounds[c][0]) / max(points - 1, 1)))
        for c in chosen])
    moved = moved.withColumn("value", value)
    replaced = moved.withColumns({c: F.when(F.col("feature") == c, F.col("value")).otherwise(F.col(c)) for c in chosen})
    return score_trees(replaced, model, features, "_p").groupBy("feature", "value").agg(
        (F.sum(F.col("_p") * F.col("_n")) / F.sum("_n")).alias("mean_pred"), F.sum("_n").alias("n"))


@dataclass(frozen=True)
class Leaves:
    """Leaves of a boosted model.  Bit j of a leaf's mask is set where a row meets the interval of its j-th path feature."""

    paths: list[tuple[tuple[int, float, float], ...]]  # (feature, above, up to) for each distinct feature of the path
    values: list[float]  # prediction times the tree's weight


def leaves_of(model: GBTRegressionModel) -> Leaves:
    """Leaves of all trees, read from the model's description."""
    paths, values, weight = [], [], 1.0
    # Sides taken on the way down, with the indent of their line: a line replaces those at its indent and below.
    way: list[tuple[int, float, bool, int]] = []
    for line in model.toDebugString.splitlines():
        words = line.replace("(", " ").replace(")", " ").split()
        if words[:1] == ["Tree"]:
            weight, way = float(words[3].rstrip(":")), []
        elif words[:1] in (["If"], ["Else"]):
            indent = len(line) - len(line.lstrip())
            way = [w for w in way if w[3] < indent] + [(int(words[2]), float(words[4]), words[0] == "If", indent)]
        elif words[:1] == ["Predict:"]:
            bounds: dict[int, tuple[float, float]] = {}
            for feature, threshold, left, _ in way:
                low, high = bounds.get(feature, (-np.inf, np.inf))
                bounds[feature] = (low, min(high, threshold)) if left else (max(low, threshold), high)
            paths.append(tuple((f, low, high) for f, (low, high) in bounds.items()))
            values.append(weight * float(words[1]))
    return Leaves(paths, values)


def _masks(x: np.ndarray, path: tuple[tuple[int, float, float], ...]) -> np.ndarray:
    """Mask of every row for one leaf.  NaN goes right at each split, as when the model predicts."""
    out = np.zeros(len(x), np.int64)
    for j, (feature, low, high) in enumerate(path):
        v = x[:, feature]
        inside = ~(v <= low) if np.isinf(high) else ~(v <= low) & (v <= high)
        out |= inside.astype(np.int64) << j
    return out


def background_masks(background: DataFrame, features: list[str], leaves: Leaves) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per leaf the masks that rows of ``background`` have, and the share of rows that have each.

    All rows count; each task sends counts, at most 2 to the number of path features a leaf, so what reaches the driver
    grows with the model only.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            x = batch.to_numpy(float)
            for leaf, path in enumerate(leaves.paths):
                for mask, n in zip(*(a.tolist() for a in np.unique(_masks(x, path), return_counts=True))):
                    seen[leaf, mask] = seen.get((leaf, mask), 0) + n
        if seen:
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["leaf", "mask", "n"])

    rows = background.select(*[F.col(c).cast("double") for c in features]).mapInPandas(count, "leaf int, mask bigint, n bigint")
    found = rows.groupBy("leaf", "mask").agg(F.sum("n").alias("n")).toPandas().sort_values(["leaf", "mask"])
    if found.empty:
        raise ValueError("Shapley values need at least one background row")
    by_leaf = {leaf: part for leaf, part in found.groupby("leaf")}
    return [(by_leaf[i]["mask"].to_numpy(np.int64), by_leaf[i]["n"].to_numpy(float) / by_leaf[i]["n"].sum()) for i in range(len(leaves.paths))]


def _leaf_shares(own: np.ndarray, other: np.ndarray, share: np.ndarray, d: int) -> np.ndarray:
    """Mean Shapley values of the leaf's indicator for each of its ``d`` path features, for rows with masks ``own``.

    Against one background row the leaf is reached by the coalitions that hold all ``u`` features only the row meets and none of
    the ``v`` only the background row meets: a feature of the first kind earns (u-1)! v! / (u+v)!, one of the second loses u! (v-1)! / (u+v)!.
    """
    whole = (1 << d) - 1
    bits = [1 << j for j in range(d)]
    mine, theirs = own[:, None] & ~other[None, :], other[None, :] & ~own[:, None]
    u = sum(((mine & b) > 0).astype(np.int64) for b in bits)
    v = sum(((theirs & b) > 0).astype(np.int64) for b in bits)
    reached = ((own[:, None] | other[None, :]) == whole) * share[None, :]
    fact = np.array([factorial(i) for i in range(2 * d + 1)], float)
    gain = reached * fact[np.maximum(u - 1, 0)] * fact[v] / fact[u + v]
    loss = reached * fact[u] * fact[np.maximum(v - 1, 0)] / fact[u + v]
    return np.column_stack([(gain * ((mine & b) > 0) - loss * ((theirs & b) > 0)).sum(axis=1) for b in bits])


def shapley(
    df: DataFrame, model: GBTRegressionModel, features: list[str], key: str = "sample_id", background: DataFrame | None = None,
    n_rows: int | None = None, seed: int = 42,
) -> DataFrame:
    """Exact interventional Shapley values ``key, feature, value, phi`` of all rows, or of a keyed subsample of ``n_rows``.

    ``background`` (all of ``df`` by default) stands for absent features, every row of it alike.  Over a row the values add up to its
    prediction minus the background's mean prediction.  Leaves are few and known, so a background of any size comes down to
    counts of the masks its rows have in each leaf; each row then needs one pass over the leaves, without a shuffle.
    """
    leaves = leaves_of(model)
    shared = df.sparkSession.sparkContext.broadcast((leaves, background_masks(df if background is None else background, features, leaves)))
    rows = df if n_rows is None else subsample(df, n_rows, seed, key)
    p = len(features)

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known, masks = shared.value
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            phi = np.zeros((len(x), p))
            for path, value, (other, share) in zip(known.paths, known.values, masks):
                if path:
                    own, at = np.unique(_masks(x, path), return_inverse=True)
                    phi[:, [f for f, _, _ in path]] += value * _leaf_shares(own, other, share, len(path))[at]
            yield pd.Series(list(phi))

    cells = F.arrays_zip(
        F.array(*[F.lit(c) for c in features]).alias("feature"), F.array(*[F.col(c).cast("double") for c in features]).alias("value"),
        F.col("_phi").alias("phi"))
    done = rows.select(key, *features).withColumn("_phi", values(*[F.col(c).cast("double") for c in features]))
    return done.select(key, F.inline(cells))


def shapley_summary(values: DataFrame) -> DataFrame:
    return values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"), F.count(F.lit(1)).alias("n"))


def shapley_dependence(values: DataFrame, model: GBTRegressionModel, features: list[str], top: int = TOP_FEATURES) -> DataFrame:
    """(value, phi) pairs of the most important features."""
    return values.filter(F.col("feature").isin([name for name, _ in top_features(model, features, top)]))
