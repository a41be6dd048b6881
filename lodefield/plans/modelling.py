"""Whole workflows: preparation, modelling run, report tables, regression kriging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.operators import balance, clean, contours, explain, fusion, metrics, reports, samples, search, surface, trees
from lodefield.operators.components import apply_components, fit_components
from lodefield.operators.kriging import FAST_ROWS, krige_with_held_out, regression_kriging
from lodefield.operators.split import split_exact, split_fraction, train_test
from lodefield.operators.trees import TreeParams
from lodefield.operators.variogram import Variogram, fit_variogram, lag_table
from lodefield.sources.sinks import export_predictions, export_sets, export_summary, export_trials
from lodefield.sources.staging import staged

BASE = list(clean.BASE_FEATURES)


@dataclass(frozen=True)
class FeatureParams:
    """All fitted preparation parameters; small, and reusable on new points."""

    depth_span: tuple[float, float]
    components: object
    scaler: dict[str, tuple[float, float]]

    @property
    def features(self) -> list[str]:
        return [f"{c}_sc" for c in self.scaler]


def fit_features(train: DataFrame, n_components: int = 5) -> FeatureParams:
    span = clean.fit_depth_norm(train)
    base = clean.apply_depth_norm(clean.add_features(train), span)
    parts = fit_components(base, BASE, n_components) if n_components else None
    names = BASE + ([f"PC{i + 1}" for i in range(len(parts.loadings))] if parts else [])
    return FeatureParams(span, parts, clean.fit_scaler(apply_components(base, parts), names))


def apply_features(df: DataFrame, params: FeatureParams) -> DataFrame:
    """Row-wise, so it also takes a streaming frame."""
    base = clean.apply_depth_norm(clean.add_features(df), params.depth_span)
    return clean.apply_scaler(apply_components(base, params.components), params.scaler)


def prepare(
    collars: DataFrame,
    intervals: DataFrame,
    test_size: float = 0.3,
    seed: int = 42,
    order: str = "split_first",
    attributes: list[str] | None = None,
    keep: tuple[str, ...] = (),
    n_components: int = 5,
) -> tuple[DataFrame, DataFrame, FeatureParams]:
    """Samples to feature frames for training and test.

    ``split_first`` rebalances and fits on training rows only.  ``reference`` does
    both before the split, which lets copies and statistics cross it.
    """
    points = staged(samples.build_samples(collars, intervals, keep=keep), "samples")
    points = clean.remove_outliers(points, list(samples.POINT_COLUMNS))

    def rebalanced(df: DataFrame) -> DataFrame:
        return balance.jitter_extremes(balance.oversample_extremes(df, seed=seed), seed=seed)

    if order == "split_first":
        train, test = train_test(split_exact(points, test_size, seed))
        train = staged(rebalanced(train), "train")
        params = fit_features(train, n_components)
        train, test = apply_features(train, params), apply_features(test, params)
    elif order == "reference":
        both = staged(rebalanced(points), "balanced")
        params = fit_features(both, n_components)
        train, test = train_test(split_exact(apply_features(both, params), test_size, seed))
    else:
        raise ValueError(f"unknown order {order!r}")
    if attributes:
        train, test = (samples.attach_attributes(df, collars, attributes) for df in (train, test))
    return train, test, params


@dataclass
class ModelRun:
    predictions: DataFrame
    metrics: DataFrame
    trials: DataFrame
    trial_stats: DataFrame
    tree_trials: DataFrame
    weights: DataFrame
    variogram: Variogram
    tree_model: object
    features: list[str]
    train: DataFrame


def run_model(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    n_trials: int = 50,
    grid: dict[str, tuple] | None = None,
    residual_params: TreeParams = trees.RESIDUAL_PARAMS,
    meta_params: TreeParams = fusion.META_PARAMS,
    base_params: TreeParams = TreeParams(),
    n_max: int = FAST_ROWS,
    blocks: tuple[int, ...] | str = "auto",
    seed: int = 42,
) -> ModelRun:
    """Kriging, trees, hybrid and fusion; fusion is fitted on held-out training rows.

    Every model sees the same fit rows, fusion learns from the validation rows'
    predictions, and all four are scored on the test rows.  A test row that kriging
    cannot estimate stays, with its status and NULL for every model that needs the
    kriging estimate; the metrics count it as ``not_estimated``.
    """
    table = search.search_variogram(train, n_trials, n_max, seed=seed)
    v = search.best_variogram(table.toPandas())
    fit_rows, valid = train_test(split_fraction(train, 0.25, seed + 3))
    fit_rows = staged(fit_rows, "fit")

    rest = samples.union_sets(valid, test)
    # The residual models learn from training rows that are estimated as the others are: in the same cells, without their fold.
    own, rest = krige_with_held_out(fit_rows, rest, v, n_max=n_max, seed=seed, blocks=blocks)

    tree_trials, tree = trees.grid_search(
        fit_rows, features, grid or {"depth": (4, 6), "step": (0.1, 0.2)}, base_params)
    scored = trees.score_trees(rest, tree, features, "xgb_pred")

    residual = own.withColumn("residual", F.col("grade") - F.col("kriging_pred")).filter("residual is not null")
    clusters = trees.fit_clusters(fit_rows, seed=seed)
    local = trees.fit_cluster_models(
        trees.assign_clusters(residual, clusters), features, clusters.getK(), "residual", residual_params)
    scored = staged(trees.predict_hybrid(scored, clusters, local, features), "scored")

    preds = ["kriging_pred", "xgb_pred", "hybrid_pred"]
    held, final = train_test(scored)
    # A failed or empty block has NULL estimates, which the fusion neither learns from nor completes.
    known = F.col("kriging_pred").isNotNull()
    stack = fusion.fit_stack(held.filter(known), preds, params=meta_params, seed=seed)
    final = fusion.apply_stack(final.filter(known), stack, preds).unionByName(
        final.filter(~known).withColumn("fusion_pred", F.lit(None).cast("double")))
    return ModelRun(
        final, metrics.evaluate(final, [*preds, "fusion_pred"], missing=True), table, search.search_stats(table), tree_trials,
        stack[1].frame(train.sparkSession), v, tree, features, fit_rows)


def diagnose(run: ModelRun, curve_sizes: tuple[float, ...] = explain.CURVE_SIZES, k: int = 5, params: TreeParams = TreeParams()) -> dict[str, DataFrame]:
    """All tables drawn from a modelling run."""
    df, models = run.predictions, ["kriging_pred", "xgb_pred", "hybrid_pred", "fusion_pred"]
    values = explain.shapley(df, run.tree_model, run.features, background=run.train)
    return {
        "compare": metrics.compare_models(run.metrics),
        "pairs": metrics.prediction_pairs(df, models),
        "limits": metrics.axis_limits(df, models),
        "residuals": metrics.residual_histogram(df, models),
        "delta_map": metrics.delta_map(df),
        "delta_histogram": metrics.delta_histogram(df),
        "hexbin": reports.hexbin_error(df, "fusion_pred"),
        "calibration": metrics.calibration(df, ["xgb_pred", "fusion_pred"]),
        "slices": reports.slices_equal(df, "fusion_pred"),
        "importance": explain.feature_importance(df.sparkSession, run.tree_model, run.features),
        "learning_curve": explain.learning_curve(run.train, run.features, sizes=curve_sizes, k=k, params=params),
        "partial_dependence": explain.partial_dependence(df, run.tree_model, run.features),
        "shapley_summary": explain.shapley_summary(values),
        "shapley_dependence": explain.shapley_dependence(values, run.tree_model, run.features),
    }


def export_run(run: ModelRun, path: str) -> None:
    export_predictions(run.predictions, f"{path}/predictions")
    export_trials(run.trials, run.trial_stats, path)
    export_summary(run.metrics, run.weights, path)


def report_tables(
    train: DataFrame, test: DataFrame, dem: DataFrame | None = None, interval: float = 80.0, band: float = 10.0,
    line: str | None = None, layer: str | None = None, contour_cell: float | None = None,
) -> dict[str, DataFrame]:
    """Labelled samples and their slice, section and layer tables; with ``contour_cell`` also isolines of cells of that size.

    A cell should be as wide as holes are apart, since lines run through neighbouring cells that hold points.

    ``line`` and ``layer`` default to the first column whose name marks one; tables
    without such a column are left out.
    """
    both = samples.union_sets(surface.clip_to_surface(train, dem), surface.clip_to_surface(test, dem))
    sliced = reports.slices_regular(both, interval, band)
    line = line or reports.find_column(both, reports.LINE_NAMES)
    layer = layer or reports.find_column(both, reports.LAYER_NAMES)
    out = {
        "all": both,
        "points": reports.points_by_set(both),
        "slice_stats": reports.slice_stats(sliced),
        "slice_points": reports.slice_points(sliced),
        "slice_classes": reports.slice_classes(sliced),
        "contour_cells": reports.contour_cells(sliced),
    }
    if contour_cell:
        out["contour_cells"] = reports.contour_cells(sliced, contour_cell)
        out["contour_segments"] = contours.contour_segments(out["contour_cells"], contour_cell)
        out["contour_lines"] = contours.contour_lines(out["contour_segments"])
    if line:
        out |= {"sections": reports.section_summary(both, line), "section_points": reports.section_points(both, line)}
    if layer:
        out |= {"layers": reports.layer_summary(both, layer), "layer_points": reports.layer_points(both, layer)}
    return out


def export_reports(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    export_sets(tables["all"], f"{path}/all_samples", fmt)


def quick_regression_kriging(
    points: DataFrame, features: list[str], value: str = "z", test_size: float = 0.25, seed: int = 42, params: TreeParams = TreeParams(300, 4, 0.05, 0.9, 0.9),
    lag: float | None = None, n_lags: int = 6, key: str = "sample_id", n_max: int = FAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Trees on attributes plus 2-D kriging of their residual: (predictions, metrics).

    ``points`` has x, y, the features, ``value`` and a key.
    """
    flat = points.withColumn("depth", F.lit(0.0))
    train, test = train_test(split_exact(flat, test_size, seed, key))
    model = trees.fit_trees(train, features, value, params)
    train, test = (staged(trees.score_trees(df, model, features, "ml_pred"), "ml") for df in (train, test))
    residual = train.withColumn("_residual", F.col(value) - F.col("ml_pred"))
    if lag is None:
        row = train.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
        lag = max(row[0], row[1]) / 2 / n_lags
    v, _ = fit_variogram(lag_table(residual, lag, n_lags, (lag / 8, lag / 8, 1e9), "_residual"), ("spherical",))
    out = regression_kriging(train, test, v, "ml_pred", value, "rk_pred", dims=2, blocks="auto", n_max=n_max)
    return out, metrics.evaluate(out, ["ml_pred", "rk_pred"], value)
