"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lodefield.session import checkpoint_folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Later passes scan only the columns they need, the lineage is cut, and a lost
    executor costs a re-read.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/lodefield-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
