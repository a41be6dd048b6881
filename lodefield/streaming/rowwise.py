"""The row-wise operators over a streaming interval table and a static collar table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.functions.binning import grade_class
from lodefield.operators.samples import build_samples
from lodefield.plans.modelling import FeatureParams, apply_features


def feature_stream(intervals: DataFrame, collars: DataFrame, params: FeatureParams, step: float = 2.0) -> DataFrame:
    """Arriving intervals to classified feature rows; stateless, so append mode works.

    Uniqueness of collars is checked once, on the static side.
    """
    points = build_samples(collars, intervals, step)
    return apply_features(points, params).withColumn("grade_class", grade_class(F.col("grade")))
