"""Writers.  Data goes out in parallel files; only one-row summaries go to one file."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_sets(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All samples partitioned by ``_set``; reading one set prunes to its folder."""
    _writer(df, fmt).partitionBy("_set").save(path)


def export_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    _writer(df, fmt).save(path)


def export_trials(trials: DataFrame, stats: DataFrame, path: str) -> None:
    """Trial scores as CSV and their one-row statistics as JSON."""
    _writer(trials, "csv").save(f"{path}/trials")
    _writer(stats.coalesce(1), "json").save(f"{path}/best")


def export_summary(metrics: DataFrame, weights: DataFrame | None, path: str) -> None:
    """Model metrics as CSV and JSON, fusion weights as JSON (a few rows each)."""
    small = metrics.coalesce(1)
    _writer(small, "csv").save(f"{path}/metrics_csv")
    _writer(small, "json").save(f"{path}/metrics_json")
    if weights is not None:
        _writer(weights.coalesce(1), "json").save(f"{path}/weights")


def _writer(df: DataFrame, fmt: str):
    writer = df.write.mode("overwrite").format(fmt)
    return writer.option("header", True) if fmt == "csv" else writer
