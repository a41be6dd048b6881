"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import pathlib
import shutil
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "lodefield", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; pass ``master`` only for local runs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodefield_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='lodefield-')}/lodefield", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    sc._lodefield_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodefield-work"
