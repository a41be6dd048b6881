import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodefield.operators import balance, split
from lodefield.operators.proxy import rank_chunks, rolling_mean


def rows(spark, n=3000, parts=5):
    return spark.range(n, numPartitions=parts).select(
        F.concat(F.lit("s"), "id").alias("sample_id"), F.pmod(F.hash("id"), F.lit(9973)).cast("double").alias("grade"))


def ids(df):
    return sorted(r.sample_id for r in df.select("sample_id").collect())


@pytest.mark.parametrize("n,size,want", [(10, 0.3, 3), (7, 0.25, 2), (3000, 0.3, 900), (1, 0.3, 1)])
def test_exact_split_size(spark, n, size, want):
    counts = {r._set: r["count"] for r in split.split_exact(rows(spark, n), size).groupBy("_set").count().collect()}
    assert counts["Test"] == want and sum(counts.values()) == n


def test_results_do_not_depend_on_partitions(spark):
    a, b = rows(spark, parts=2), rows(spark, parts=9)
    for step in (lambda d: split.subsample(d, 100), lambda d: split.split_exact(d).filter("_set = 'Test'"), balance.oversample_extremes,
                 lambda d: split.add_fold(d).filter("fold = 2"), lambda d: split.split_fraction(d).filter("_set = 'Test'")):
        assert ids(step(a)) == ids(step(b))
    assert balance.jitter_extremes(a).agg(F.sum("grade")).first()[0] == pytest.approx(balance.jitter_extremes(b).agg(F.sum("grade")).first()[0], rel=1e-13)


def test_oversample_appends_drawn_tail_rows(spark):
    df = rows(spark)
    out = balance.oversample_extremes(df)
    extra = out.filter(F.col("sample_id").contains("+o"))
    limits = np.quantile(df.toPandas().grade, [0.02, 0.98])
    tails = df.filter((F.col("grade") <= limits[0]) | (F.col("grade") >= limits[1])).count()
    assert extra.count() == min(tails, 1000) and out.count() == 3000 + extra.count()
    assert extra.filter((F.col("grade") > limits[0]) & (F.col("grade") < limits[1])).count() == 0
    assert balance.oversample_extremes(df.filter("grade < 0")).count() == 0


def test_oversample_of_large_tails_draws_1000(spark):
    assert balance.oversample_extremes(rows(spark, 30_000)).count() == 31_000


def test_jitter_scale(spark):
    df = rows(spark, 30_000)
    out = balance.jitter_extremes(df).filter(F.col("sample_id").contains("+j"))
    base = df.withColumnsRenamed({"grade": "g0"})
    noise = out.withColumn("sample_id", F.split("sample_id", "\\+").getItem(0)).join(base, "sample_id").select((F.col("grade") - F.col("g0")).alias("d"))
    want = df.agg(F.stddev_samp("grade")).first()[0] * 0.01
    got = noise.agg(F.stddev_samp("d"), F.avg("d")).first()
    assert got[0] == pytest.approx(want, rel=0.1) and abs(got[1]) < want / 5


def test_split_by_hole_keeps_holes_whole(spark):
    df = rows(spark).withColumn("hole_id", F.col("grade").cast("int") % 20)
    sides = split.split_fraction(df, 0.3, key="hole_id").groupBy("hole_id").agg(F.count_distinct("_set").alias("n"))
    assert sides.filter("n > 1").count() == 0


@pytest.mark.parametrize("chunk_rows", [7, 100, 10**6])
def test_rolling_mean_equals_pandas_with_a_hot_hole(spark, chunk_rows):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"hole_id": np.where(rng.random(900) < 0.4, 0, rng.integers(1, 30, 900)), "depth": rng.integers(-60, 0, 900).astype(float),
                        "grade": rng.normal(size=900)})
    pdf["sample_id"] = [f"s{i:04d}" for i in range(900)]
    want = pdf.sort_values(["hole_id", "depth", "sample_id"])
    want = want.assign(p=want.groupby("hole_id").grade.transform(lambda s: s.rolling(3, min_periods=1).mean())).sort_values("sample_id")
    got = rolling_mean(spark.createDataFrame(pdf).repartition(6), chunk_rows=chunk_rows).toPandas().sort_values("sample_id")
    assert len(got) == 900 and np.allclose(got.kriging_pred, want.p)


def test_rolling_mean_spreads_a_hole_of_one_depth(spark):
    n = 200_000
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"hole_id": np.where(np.arange(n) % 40 == 0, 2.0, 1.0), "depth": -5.0, "grade": rng.normal(size=n), "sample_id": rng.permutation(n)})
    df = spark.createDataFrame(pdf).repartition(5)
    sizes = rank_chunks(df, ["hole_id", "depth", "sample_id"], 10_000).groupBy("_chunk").count().toPandas()["count"]
    assert len(sizes) == 20 and sizes.max() < 20_000
    want = pdf.sort_values(["hole_id", "depth", "sample_id"])
    want = want.assign(p=want.groupby("hole_id").grade.transform(lambda s: s.rolling(3, min_periods=1).mean())).sort_values("sample_id")
    got = rolling_mean(df, chunk_rows=10_000).toPandas().sort_values("sample_id")
    assert len(got) == n and np.allclose(got.kriging_pred, want.p)


@pytest.mark.parametrize("chunk_rows", [4, 10**6])
def test_rolling_mean_of_missing_groups_depths_and_values(spark, chunk_rows):
    rows = [(None if i % 3 else "h", None if i % 4 == 0 else float(-i), i, None if i % 5 == 0 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "hole_id string, depth double, sample_id bigint, grade double")
    got = {r.sample_id: r.kriging_pred for r in rolling_mean(df, chunk_rows=chunk_rows).collect()}
    for hole in ("h", None):
        held = sorted((r for r in rows if r[0] == hole), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        for i, r in enumerate(held):
            near = [g for *_, g in held[max(0, i - 2) : i + 1] if g is not None]
            assert got[r[2]] == (pytest.approx(sum(near) / len(near)) if near else None)
    assert rolling_mean(df.limit(0), chunk_rows=chunk_rows).count() == 0
