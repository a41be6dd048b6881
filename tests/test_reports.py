import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodefield.functions.binning import grade_class
from lodefield.operators import metrics, reports, surface


def test_slice_edges(spark):
    df = spark.createDataFrame([(-100.0,), (-90.0,), (0.0,)], "depth double")
    got = {(r.depth, r.z0) for r in reports.slices_regular(df, 20.0, 10.0).collect()}
    assert got == {(-100.0, -100.0), (-90.0, -100.0), (-90.0, -80.0), (0.0, 0.0)}


@pytest.mark.parametrize("interval,band", [(20.0, 10.0), (80.0, 10.0), (7.0, 20.0)])
def test_slices_equal_a_loop(spark, interval, band):
    depth = np.random.default_rng(1).uniform(-333, 0, 400)
    want = sum((np.abs(depth - z0) <= band).sum() for z0 in np.arange(depth.min(), depth.max() + interval, interval))
    df = spark.createDataFrame([(float(d),) for d in depth], "depth double")
    assert reports.slices_regular(df, interval, band).count() == want


def test_grade_class_edges(spark):
    df = spark.createDataFrame([(29.999,), (30.0,), (40.0,), (50.0,), (None,), (float("nan"),)], "g double")
    assert [r[0] for r in df.select(grade_class(F.col("g"))).collect()] == ["<30", "30-40", "40-50", ">=50", None, None]
    assert [r[0] for r in df.select(grade_class(F.col("g"), ">=50")).collect()][-2:] == [">=50", ">=50"]


def test_metrics_skip_missing_predictions(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (3.0, 3.0, 5.0), (0.0, 1.0, 0.0)], "grade double, a double, b double")
    got = {r.model: r for r in metrics.evaluate(df, ["a", "b"]).collect()}
    assert got["a"].n == 3 and got["b"].n == 2 and got["b"].mae == 1.0 and got["a"].bias == pytest.approx(2 / 3)
    assert got["a"].r2 == pytest.approx(1 - 2 / np.sum((np.array([1, 3, 0]) - 4 / 3) ** 2))


def test_calibration_equals_qcut(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"p": np.round(rng.exponential(2, 700), 1), "grade": rng.normal(size=700)})
    want = pdf.groupby(pd.qcut(pdf.p, 15, duplicates="drop"), observed=True).agg(n=("p", "size"), p=("p", "mean"), t=("grade", "mean"))
    got = metrics.calibration(spark.createDataFrame(pdf), ["p"]).orderBy("bin").toPandas()
    assert got.n.tolist() == want.n.tolist() and np.allclose(got.pred_mean, want.p) and np.allclose(got.true_mean, want.t)


def test_histogram_equals_numpy(spark):
    err = np.random.default_rng(4).normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"grade": np.zeros(500), "p": err}))
    got = metrics.residual_histogram(df, ["p"]).toPandas().set_index("bin").n
    want, _ = np.histogram(err, 40)
    assert [got.get(i, 0) for i in range(40)] == want.tolist()
    assert metrics.delta_histogram(df) is None and metrics.delta_map(df) is None


def test_hexagons_hold_every_row_once(spark):
    pdf = pd.DataFrame(np.random.default_rng(5).uniform(0, 70, (600, 2)), columns=["x", "y"]).assign(grade=0.0, p=1.0)
    got = reports.hexbin_error(spark.createDataFrame(pdf), "p")
    row = got.agg(F.sum("n"), F.min("mean_error"), F.max("mean_error")).first()
    assert tuple(row) == (600, 1.0, 1.0)
    flat = reports.hexbin_error(spark.createDataFrame(pdf.assign(x=3.0)), "p")
    assert flat.select("u").distinct().count() == 1


def test_sections_pick_the_wider_axis(spark):
    rows = [("A", "Train", float(i), 0.0, -1.0, 30.0) for i in range(10)] + [("B", "Test", 0.0, float(i) + 5, -1.0, 30.0) for i in range(12)]
    rows += [("C", "Test", 1.0, 1.0, -1.0, 30.0)] * 9 + [(None, "Test", 1.0, 1.0, -1.0, 30.0)] * 20
    df = spark.createDataFrame(rows, "line string, _set string, x double, y double, depth double, grade double")
    got = {r.line: r for r in reports.section_summary(df, "line").collect()}
    assert set(got) == {"A", "B"} and got["A"].axis == "x" and got["B"].axis == "y" and got["B"].n_test == 12
    along = [r.hcoord_rel for r in reports.section_points(df, "line").filter("line = 'B'").collect()]
    assert sorted(along) == [float(i) for i in range(12)]
    assert reports.layer_points(df, "line").count() == 22
    assert reports.find_column(df, reports.LINE_NAMES) == "line" and reports.find_column(df, reports.LAYER_NAMES) is None


def test_wide_classes_keep_order(spark):
    df = spark.createDataFrame([(0.0, 20.0), (0.0, 20.0), (0.0, 55.0)], "z0 double, grade double")
    row = reports.slice_classes_wide(df).first()
    assert list(row.asDict()) == ["z0", "<30", "30-40", "40-50", ">=50"] and row["<30"] == 2 and row["30-40"] == 0


def test_contour_needs_ten_points(spark):
    df = spark.createDataFrame([(0.0, float(i), 0.0, 1.0) for i in range(10)] + [(20.0, 0.0, 0.0, 1.0)] * 9, "z0 double, x double, y double, grade double")
    assert {r.z0 for r in reports.contour_cells(df).collect()} == {0.0}


@pytest.mark.parametrize("kind", ["even", "dense", "line", "one"])
def test_nearest_surface_equals_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    dem = {"even": rng.uniform(0, 1000, (700, 2)), "one": np.array([[5.0, 5.0]]),
           # A third of the surface sits in one corner of the area.
           "dense": np.r_[rng.uniform(0, 1000, (400, 2)), 900 + rng.uniform(0, 0.5, (300, 2))],
           "line": np.column_stack([np.arange(200.0), np.zeros(200)])}[kind]
    pts = np.r_[rng.uniform(-200, 1200, (150, 2)), 900 + rng.uniform(-1, 1, (50, 2))]
    d2 = ((pts[:, None, :] - dem[None, :, :]) ** 2).sum(2)
    surf = spark.createDataFrame([(float(x), float(y), float(i)) for i, (x, y) in enumerate(dem)], "x double, y double, z double")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = surface.nearest_surface(points, surf).orderBy("id").toPandas()
    assert len(got) == 200 and got.surface_z.tolist() == d2.argmin(1).tolist()


def test_clip(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, -1.0)], "x double, y double, depth double")
    dem = spark.createDataFrame([(1.0, 1.0, 9.0)], "x double, y double, z double")
    assert surface.clip_to_surface(df, None).count() == 3
    assert surface.clip_to_surface(df, dem).count() == 2
    assert {r.surface_z for r in surface.clip_to_surface(df, dem, "surface").collect()} == {9.0}
