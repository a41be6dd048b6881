"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodefield.session import checkpoint_folder, ship_package

# The letters that normalisation lower-cases.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder of the cluster."""
    return f"{checkpoint_folder(spark)}/lodefield-{name}-{uuid.uuid4().hex}"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learned; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def private(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` whose bigint columns come as ``Int64``, so that a null beside them does not turn them into doubles."""
    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for batch in given)
        for frame in run(frames):
            yield pa.RecordBatch.from_pandas(frame, schema=kinds, preserve_index=False)

    return df.mapInArrow(batches, schema)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
