"""Train/test splits, folds and random subsamples by keyed hash."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.functions.keyed import HASH_TOP, keyed_hash, keyed_uniform
from lodefield.functions.quantiles import uniform_rank

MAX_SUBSAMPLE = 100_000


def subsample(df: DataFrame, n: int, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Exactly min(n, rows) rows without replacement (a per-task top-n, then a merge)."""
    if n > MAX_SUBSAMPLE:
        raise ValueError(f"subsample is for at most {MAX_SUBSAMPLE} rows; use split_fraction")
    return df.withColumn("_h", keyed_hash(f"{seed}s", key)).orderBy("_h", key).limit(n).drop("_h")


def split_exact(df: DataFrame, test_size: float = 0.3, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Label ``_set``: the ceil(test_size * n) rows of lowest hash are Test.

    The boundary hash is found by a pass around its expected value, so no global sort is needed.
    """
    n = df.count()
    want = math.ceil(test_size * n)
    if want == 0:
        return df.withColumn("_set", F.lit("Train"))
    hashed = df.withColumn("_h", keyed_hash(f"{seed}p", key))
    edge = uniform_rank(hashed.select("_h"), "_h", want - 1, n, HASH_TOP)
    is_test = F.col("_h") <= F.lit(edge.lo)
    if edge.below + edge.rows > want:
        # Rows sharing the boundary hash are settled by key; with 60 bits there are few.
        ties = hashed.filter(F.col("_h") == F.lit(edge.lo)).select(key).orderBy(key).limit(want - edge.below)
        last = ties.agg(F.max(key)).first()[0]
        is_test = (F.col("_h") < F.lit(edge.lo)) | ((F.col("_h") == F.lit(edge.lo)) & (F.col(key) <= F.lit(last)))
    return hashed.withColumn("_set", F.when(is_test, "Test").otherwise("Train")).drop("_h")


def split_fraction(df: DataFrame, test_size: float = 0.3, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Label ``_set`` by a hash threshold: expected size, no job and no shuffle.

    With ``key="hole_id"`` all points of a hole fall on one side.
    """
    return df.withColumn("_set", F.when(keyed_uniform(f"{seed}p", key) < F.lit(test_size), "Test").otherwise("Train"))


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("_set = 'Train'").drop("_set"), df.filter("_set = 'Test'").drop("_set")


def add_fold(df: DataFrame, k: int = 5, seed: int = 42, key: str = "sample_id", name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(keyed_hash(f"{seed}k", key), F.lit(k)).cast("int"))
