"""Typed readers.  Schemas are explicit; nothing is inferred from the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COLLAR_SCHEMA = T.StructType([
    T.StructField("hole_id", T.StringType()),
    T.StructField("e", T.DoubleType()),
    T.StructField("n", T.DoubleType()),
])

# Interval fields stay text so that bad entries are skipped later, not nulled by the reader.
INTERVAL_SCHEMA = T.StructType([
    T.StructField("hole_id", T.StringType()),
    T.StructField("d_from", T.StringType()),
    T.StructField("d_to", T.StringType()),
    T.StructField("grade", T.StringType()),
])

SURFACE_COLUMNS = ("x", "y", "z")


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    raise ValueError(f"unknown format {fmt!r}")


def read_collars(spark: SparkSession, path: str, fmt: str = "csv", attributes: tuple[str, ...] = ()) -> DataFrame:
    """One row per hole; ``attributes`` are further text columns in file order."""
    schema = T.StructType(COLLAR_SCHEMA.fields + [T.StructField(a, T.StringType()) for a in attributes])
    return _read(spark, path, schema, fmt)


def read_intervals(spark: SparkSession, path: str, fmt: str = "csv", keys: tuple[str, ...] = ()) -> DataFrame:
    """Assay intervals; ``keys`` are further text columns, such as an interval id."""
    schema = T.StructType(INTERVAL_SCHEMA.fields + [T.StructField(k, T.StringType()) for k in keys])
    return _read(spark, path, schema, fmt)


def read_surface(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Optional ``x,y,z`` CSV; None when no path is set, it is missing, or a column is."""
    if not path:
        return None
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return None
    raw = spark.read.csv(path, header=True)
    if not set(SURFACE_COLUMNS) <= set(raw.columns):
        return None
    return raw.select(*[raw[c].try_cast("double").alias(c) for c in SURFACE_COLUMNS]).na.drop()


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a scan over all cores when its files give fewer tasks than cores.

    For a table scan only.  Large tables have more splits than cores and pass
    through unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
