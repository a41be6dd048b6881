import pytest
from pyspark.sql import functions as F

from lodefield.functions.joins import lookup_join
from lodefield.operators import samples


def points(spark, rows, step=2.0):
    intervals = spark.createDataFrame(rows, "hole_id string, interval_id string, d_from string, d_to string, grade string")
    collars = spark.createDataFrame([("a", 10.0, 20.0), ("unused", 0.0, 0.0)], "hole_id string, e double, n double")
    return samples.build_samples(collars, intervals, step).orderBy("sample_id").collect()


def test_one_and_two_points(spark):
    got = points(spark, [("a", "i", "0", "3", "1.5"), ("a", "j", "0", "4", "2.5")])
    assert [(r.sample_id, r.depth, r.grade) for r in got] == [("i:0", 0.0, 1.5), ("j:0", 0.0, 2.5), ("j:1", -4.0, 2.5)]
    assert {(r.x, r.y) for r in got} == {(10.0, 20.0)}


def test_spacing_is_wider_than_step(spark):
    assert [r.depth for r in points(spark, [("a", "i", "1", "8", "1")])] == [-1.0, -4.5, -8.0]


@pytest.mark.parametrize("bad", [
    ("a", "i", "5", "5", "1"), ("a", "i", "6", "5", "1"), ("a", "i", "0", "3", "n/a"), ("a", "i", "0", "NaN", "1"),
    ("a", "i", "0", "inf", "1"), ("a", "i", None, "3", "1"), ("orphan", "i", "0", "3", "1"), (None, "i", "0", "3", "1")])
def test_skipped_rows(spark, bad):
    assert points(spark, [bad]) == []


def test_repeated_collar_is_an_error(spark):
    collars = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 1.0)], "hole_id string, e double, n double")
    intervals = spark.createDataFrame([("a", 0.0, 3.0, 1.0)], "hole_id string, d_from double, d_to double, grade double")
    with pytest.raises(ValueError):
        samples.join_collars(intervals, collars)


def test_drop_missing_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "v double, k string")
    assert [r.v for r in samples.drop_missing(df).collect()] == [1.0]


def test_two_attribute_values_multiply_points(spark):
    pts = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "hole_id string, v double")
    collars = spark.createDataFrame([("a", "L1"), ("a", "L2"), ("a", "L2")], "hole_id string, line string")
    got = samples.attach_attributes(pts, collars, ["line"]).orderBy("hole_id", "line").collect()
    assert [(r.hole_id, r.line) for r in got] == [("a", "L1"), ("a", "L2"), ("b", None)]
    with pytest.raises(ValueError):
        samples.attach_attributes(pts, collars, ["line"], on_conflict="error")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_plain(spark, how):
    big = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    want = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    got = sorted(map(tuple, lookup_join(big, small, ["k"], how, max_broadcast=0).collect()), key=str)
    assert got == want


def test_union_keeps_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,)], "v int")
    assert samples.union_sets(df, df).groupBy("_set").count().orderBy("_set").collect()[0]["count"] == 2
