"""Error metrics and prediction diagnostics as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.functions.binning import quantile_bin, uniform_bin
from lodefield.functions.quantiles import exact_quantiles

HISTOGRAM_BINS = 40
CALIBRATION_BINS = 15


def evaluate(df: DataFrame, preds: list[str], truth: str = "grade", missing: bool = False) -> DataFrame:
    """``model, n, mae, rmse, r2, evs, mape, bias`` in one pass for any number of models.

    ``missing`` adds ``not_estimated``, the rows with a truth and a NULL estimate.
    """
    aggs = []
    for i, p in enumerate(preds):
        y = F.when(F.col(p).isNotNull(), F.col(truth))
        err = F.col(p) - F.col(truth)
        aggs.append(F.struct(
            F.lit(p).alias("model"),
            F.count(err).alias("n"),
            F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            (1 - F.try_divide(F.avg(err * err), F.var_pop(y))).alias("r2"),
            (1 - F.try_divide(F.var_pop(err), F.var_pop(y))).alias("evs"),
            (F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(1e-9))) * 100).alias("mape"),
            F.avg(err).alias("bias"),
            *([F.count_if(F.col(truth).isNotNull() & F.col(p).isNull()).alias("not_estimated")] if missing else []),
        ).alias(f"m{i}"))
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(preds))])))


def compare_models(metrics: DataFrame) -> DataFrame:
    return metrics.select("model", "rmse", "r2")


def prediction_pairs(df: DataFrame, preds: list[str], truth: str = "grade", keep: tuple[str, ...] = ()) -> DataFrame:
    """Long (model, truth, prediction) rows, one per model and sample."""
    pairs = F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).alias("pred")) for p in preds])
    return df.select(*keep, F.col(truth).alias("truth"), F.explode(pairs).alias("s")).select(*keep, "s.model", "truth", "s.pred")


def axis_limits(df: DataFrame, preds: list[str], truth: str = "grade") -> DataFrame:
    """One row: least value minus 1 and greatest plus 1 over truth and predictions."""
    names = [truth, *preds]
    return df.agg(
        (F.least(*[F.min(c) for c in names]) - 1).alias("lo"), (F.greatest(*[F.max(c) for c in names]) + 1).alias("hi"))


def residual_histogram(df: DataFrame, preds: list[str], truth: str = "grade", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``model, bin, lo, hi, n, mean, std``: equal-width bins over each model's own range."""
    return _histogram(df, {p: F.col(p) - F.col(truth) for p in preds}, bins)


def _histogram(df: DataFrame, values: dict, bins: int) -> DataFrame:
    names = list(values)
    marked = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    stats = marked.agg(*[F.struct(
        F.min(f"v{i}").alias("lo"), F.max(f"v{i}").alias("hi"), F.avg(f"v{i}").alias("mean"), F.stddev_samp(f"v{i}").alias("std"),
    ).alias(f"v{i}") for i in range(len(names))]).first()
    live = [i for i in range(len(names)) if stats[f"v{i}"].lo is not None]
    schema = "model string, bin int, lo double, hi double, n bigint, mean double, std double"
    if not live:
        return df.sparkSession.createDataFrame([], schema)
    slots = F.array(*[F.struct(
        F.lit(i).alias("m"), uniform_bin(F.col(f"v{i}"), stats[f"v{i}"].lo, stats[f"v{i}"].hi, bins).alias("bin")) for i in live])
    counts = marked.select(F.explode(slots).alias("s")).select("s.*").filter("bin is not null").groupBy("m", "bin").agg(
        F.count(F.lit(1)).alias("n"))

    def per_model(pick):
        return F.coalesce(*[F.when(F.col("m") == i, F.lit(pick(i))) for i in live])

    def width(i):
        return (stats[f"v{i}"].hi - stats[f"v{i}"].lo) / bins

    lo, w = per_model(lambda i: stats[f"v{i}"].lo), per_model(width)
    return counts.select(
        per_model(lambda i: names[i]).alias("model"), "bin", (lo + F.col("bin") * w).alias("lo"),
        (lo + (F.col("bin") + 1) * w).alias("hi"), "n", per_model(lambda i: stats[f"v{i}"].mean).alias("mean"),
        per_model(lambda i: stats[f"v{i}"].std).cast("double").alias("std"))


def delta_map(df: DataFrame, a: str = "fusion_pred", b: str = "xgb_pred") -> DataFrame | None:
    """``x, y, delta`` = a - b; None when ``a`` is absent."""
    if a not in df.columns:
        return None
    return df.select("x", "y", (F.col(a) - F.col(b)).alias("delta"))


def delta_histogram(df: DataFrame, a: str = "fusion_pred", b: str = "xgb_pred", bins: int = HISTOGRAM_BINS) -> DataFrame | None:
    if a not in df.columns:
        return None
    return _histogram(df, {"delta": F.col(a) - F.col(b)}, bins)


def calibration(df: DataFrame, preds: list[str], truth: str = "grade", bins: int = CALIBRATION_BINS) -> DataFrame:
    """``model, bin, n, pred_mean, true_mean`` over quantile bins of each prediction.

    Bins are right-closed; equal edges are merged and empty bins are absent.
    """
    found = exact_quantiles(df, preds, [i / bins for i in range(bins + 1)])
    edges = {p: sorted(set(found[p])) for p in preds}
    slots = F.array(*[F.struct(
        F.lit(p).alias("model"), quantile_bin(F.col(p), edges[p]).alias("bin"), F.col(p).alias("pred"), F.col(truth).alias("truth"))
        for p in preds])
    rows = df.select(F.explode(slots).alias("s")).select("s.*").filter("bin is not null")
    return rows.groupBy("model", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("pred_mean"), F.avg("truth").alias("true_mean"))
