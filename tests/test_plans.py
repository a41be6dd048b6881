import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodefield.operators.trees import TreeParams
from lodefield.plans import modelling
from lodefield.plans import views as V
from lodefield.sources import tables
from lodefield.streaming.rowwise import feature_stream

QUICK = TreeParams(n_trees=4, depth=3, step=0.3)


@pytest.fixture(scope="module")
def drilled(spark, sf):
    return V.collars(spark, sf).cache(), V.intervals(spark, sf).cache()


@pytest.fixture(scope="module")
def prepared(drilled):
    return modelling.prepare(*drilled, attributes=["line_no"], keep=("lith",), n_components=3)


def test_split_first_keeps_copies_out_of_test(prepared):
    train, test, params = prepared
    assert test.filter(F.col("sample_id").contains("+")).count() == 0 and train.filter(F.col("sample_id").contains("+")).count() > 0
    assert len(params.features) == 11 and train.filter(F.col("line_no").isNull()).count() == 0
    mean = train.agg(*[F.avg(c) for c in params.features]).first()
    assert all(abs(m) < 1e-6 for m in mean)


def test_reference_order_splits_copies(drilled):
    _, test, _ = modelling.prepare(*drilled, order="reference", n_components=0)
    assert test.filter(F.col("sample_id").contains("+")).count() > 0


def test_modelling_run_and_exports(spark, prepared, tmp_path):
    train, test, params = prepared
    run = modelling.run_model(
        train, test, params.features, n_trials=3, grid={"depth": (2, 3)}, residual_params=QUICK, meta_params=QUICK, base_params=QUICK, n_max=300)
    rows = {r.model: r for r in run.metrics.collect()}
    assert len(rows) == 4 and all(r.n == test.count() and np.isfinite(r.rmse) for r in rows.values())
    assert rows["fusion_pred"].rmse <= max(r.rmse for r in rows.values())
    modelling.export_run(run, str(tmp_path / "run"))
    back = spark.read.csv(str(tmp_path / "run" / "metrics_csv"), header=True, inferSchema=True)
    assert back.count() == 4 and spark.read.json(str(tmp_path / "run" / "weights")).first().w_kriging_pred >= 0
    assert spark.read.csv(str(tmp_path / "run" / "predictions"), header=True).count() == rows["xgb_pred"].n
    assert spark.read.csv(str(tmp_path / "run" / "trials"), header=True).count() == 3
    assert spark.read.json(str(tmp_path / "run" / "best")).first().evals_total == 3
    tables_ = modelling.diagnose(run, curve_sizes=(0.5, 1.0), k=2, params=QUICK)
    assert all(t.limit(1).count() == 1 for t in tables_.values())


def test_modelling_run_keeps_targets_without_an_estimate(spark):
    rng = np.random.default_rng(5)

    def rows(n, name, lo, hi):
        at = pd.DataFrame({"x": rng.uniform(lo, hi, n), "y": rng.uniform(0, 50, n), "depth": -rng.uniform(0, 50, n)})
        return spark.createDataFrame(at.assign(grade=30 + at.x / 10, sample_id=[f"{name}{i}" for i in range(n)]))

    train, test = rows(300, "a", 0, 30), rows(60, "b", 0, 30).unionByName(rows(25, "c", 80, 100))
    run = modelling.run_model(
        train, test, ["x", "y", "depth"], n_trials=1, grid={"depth": (2,)}, residual_params=QUICK, meta_params=QUICK, base_params=QUICK, blocks=(5, 1, 1))
    got = run.predictions.toPandas()
    far = got[got.sample_id.str.startswith("c")]
    assert len(got) == 85 and len(far) == 25 and set(far.kriging_pred_status) == {"no_data"}
    assert far[["kriging_pred", "hybrid_pred", "fusion_pred"]].isna().all().all() and got.xgb_pred.notna().all()
    counts = {r.model: (r.n, r.not_estimated) for r in run.metrics.collect()}
    assert counts == {"kriging_pred": (60, 25), "xgb_pred": (85, 0), "hybrid_pred": (60, 25), "fusion_pred": (60, 25)}


def test_report_tables_and_set_export(spark, prepared, tmp_path):
    train, test, _ = prepared
    out = modelling.report_tables(train, test, V.surface(spark, V_SF), line="line_no")
    assert {"sections", "layers", "slice_classes"} <= set(out) and all(t.limit(1).count() == 1 for t in out.values())
    modelling.export_reports(out, str(tmp_path / "r"), "parquet")
    back = spark.read.parquet(str(tmp_path / "r" / "all_samples"))
    assert back.filter("_set = 'Test'").count() == test.count()


V_SF = "/root/testdata/sf0.001"


def test_quick_regression_kriging_improves_structured_residual(spark):
    # Two attributes without any place in them, and a trough along a diagonal that they cannot explain.
    rng = np.random.default_rng(19)
    n = 400
    x, y = rng.uniform(0, 800, n), rng.uniform(0, 500, n)
    moist, dense = rng.gamma(2.0, 1.0, n), rng.integers(0, 5, n).astype(float)
    trough = -4.0 / (1.0 + ((x - 1.6 * y) / 120.0) ** 2)
    pdf = pd.DataFrame({"x": x, "y": y, "a1": moist, "a2": dense, "z": 0.8 * moist - 0.5 * dense + trough, "sample_id": [f"p{i}" for i in range(n)]})
    out, rows = modelling.quick_regression_kriging(spark.createDataFrame(pdf), ["a1", "a2"], params=TreeParams(20, 3, 0.2))
    rmse = {r.model: r.rmse for r in rows.collect()}
    assert out.count() == 100 and out.filter("rk_pred is null").count() == 0
    assert rmse["rk_pred"] < rmse["ml_pred"]


def test_stream_scores_like_batch(spark, drilled, prepared, tmp_path):
    collars, intervals = drilled
    params = prepared[2]
    source = str(tmp_path / "in")
    intervals.write.parquet(source)
    stream = feature_stream(spark.readStream.schema(intervals.schema).parquet(source), collars, params)
    query = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = feature_stream(intervals, collars, params)
    got, want = (df.agg(F.count(F.lit(1)), F.sum(F.hash("sample_id").cast("double")), F.round(F.sum("x_sc"), 6)).first() for df in (spark.table("scored"), batch))
    assert tuple(got) == tuple(want) and got[0] > 0


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("hole_id,e,n,line\na,1,2,L1\n")
    (tmp_path / "i.csv").write_text("hole_id,d_from,d_to,grade\na,0,4,31.5\na,4,8,n/a\n")
    (tmp_path / "s.csv").write_text("x,y,z\n1,2,3\nbad,2,3\n")
    (tmp_path / "s2.csv").write_text("x,y\n1,2\n")
    collars = tables.read_collars(spark, str(tmp_path / "c.csv"), attributes=("line",))
    intervals = tables.read_intervals(spark, str(tmp_path / "i.csv")).withColumn("interval_id", F.lit("i"))
    assert collars.first().line == "L1" and intervals.count() == 2
    from lodefield.operators.samples import build_samples
    assert [r.depth for r in build_samples(collars, intervals).orderBy("depth").collect()] == [-4.0, 0.0]
    assert [tuple(r) for r in tables.read_surface(spark, str(tmp_path / "s.csv")).collect()] == [(1.0, 2.0, 3.0)]
    assert tables.read_surface(spark, str(tmp_path / "s2.csv")) is None
    assert tables.read_surface(spark, str(tmp_path / "none.csv")) is None and tables.read_surface(spark, None) is None
