import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodefield.operators import blocks, kriging, search, variogram
from lodefield.operators.variogram import MODELS, Variogram

V = Variogram("spherical", 60.0, 4.0, 0.5)


def field(n=400, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.uniform(0, 100, (n, 3)), columns=["x", "y", "depth"])
    pdf["depth"] = -pdf.depth
    pdf["grade"] = 30 + np.sin(pdf.x / 20) * 5 + np.cos(pdf.y / 25) * 3 + pdf.depth / 50
    pdf["sample_id"] = [f"s{i}" for i in range(n)]
    return pdf


def by_id(df):
    return df.toPandas().sort_values("sample_id", ignore_index=True)


@pytest.mark.parametrize("model", MODELS)
@pytest.mark.parametrize("dims", [2, 3])
def test_exact_at_data_points(model, dims):
    pdf = field(60)
    xyz, z = pdf[["x", "y", "depth"]].to_numpy(), pdf.grade.to_numpy()
    system = kriging.solve_kriging(xyz, z, Variogram(model, 40.0, 3.0, 0.7), dims, variance=True)
    pred, var = system.predict(xyz)
    assert system.status == "ok" and np.allclose(pred, z) and np.allclose(var, 0, atol=1e-8)


def test_constant_field_and_weights_sum_to_one():
    pdf = field(50)
    xyz = pdf[["x", "y", "depth"]].to_numpy()
    targets = field(30, 1)[["x", "y", "depth"]].to_numpy()
    pred, _ = kriging.solve_kriging(xyz, np.full(50, 7.0), V).predict(targets)
    assert np.allclose(pred, 7.0)
    # The estimate is linear in the data, so unit vectors give the weights.
    weights = np.array([kriging.solve_kriging(xyz, np.eye(50)[i], V).predict(targets)[0] for i in range(50)])
    assert np.allclose(weights.sum(axis=0), 1.0)


def test_repeated_points_are_averaged():
    xyz = np.array([[0, 0, 0], [0, 0, 0], [10, 0, 0.0]])
    system = kriging.solve_kriging(xyz, np.array([1.0, 3.0, 5.0]), Variogram("spherical", 30, 1, 0))
    assert np.allclose(system.predict(np.array([[0, 0, 0.0], [10, 0, 0]]))[0], [2.0, 5.0])


def test_bad_values_fail_with_a_status(spark):
    assert kriging.solve_kriging(np.zeros((1, 3)), np.array([np.nan]), V) is None
    out = kriging.apply_global(spark.createDataFrame(field(5)), None).collect()
    assert all(r.kriging_pred is None and r.kriging_pred_status == "failed" for r in out)


def test_one_block_equals_global_and_partitions_do_not_matter(spark):
    train, test = field(300), field(120, 1)
    system = kriging.solve_kriging(train[["x", "y", "depth"]].to_numpy(), train.grade.to_numpy(), V)
    want = system.predict(test.sort_values("sample_id")[["x", "y", "depth"]].to_numpy())[0]
    for parts in (1, 16):
        tr, te = (spark.createDataFrame(d).repartition(parts) for d in (train, test))
        one = by_id(kriging.krige_blocks(tr, te, V, (1, 1, 1), 1000))
        whole = by_id(kriging.apply_global(te, kriging.fit_global(tr, V, 1000)))
        assert np.allclose(one.kriging_pred, want) and np.allclose(whole.kriging_pred, want)


def test_blocks_chunks_and_sampling_keep_every_target(spark):
    train, test = spark.createDataFrame(field(900)), spark.createDataFrame(field(500, 1))
    whole = by_id(kriging.krige_blocks(train, test, V, (2, 2, 2), 3000, margin=1.0))
    cut = by_id(kriging.krige_blocks(train, test, V, (2, 2, 2), 3000, margin=1.0, chunk_rows=20))
    assert len(whole) == 500 and (whole.kriging_pred_status == "ok").all() and np.allclose(whole.kriging_pred, cut.kriging_pred)
    near = kriging.neighbourhoods(kriging.distinct_points(train), blocks.fit_grid(train, (2, 1, 1)), 100, 0.25, 42)
    assert {r["count"] for r in near.groupBy("block_id").count().collect()} == {100}
    auto = by_id(kriging.krige_blocks(train, test, V, "auto", 200))
    rmse = np.sqrt(np.mean((auto.kriging_pred - auto.grade) ** 2))
    assert auto.block_id.nunique() > 4 and rmse < auto.grade.std() / 2


def test_block_without_data_reports_it(spark):
    train = spark.createDataFrame(field(50)).filter("x < 20")
    out = kriging.krige_blocks(train, spark.createDataFrame(field(100, 1)), V, (5, 1, 1), 500, margin=0.0)
    far = out.filter("x > 60").collect()
    assert far and all(r.kriging_pred is None and r.kriging_pred_status == "no_data" for r in far)
    assert out.filter("kriging_pred_status = 'ok' and kriging_pred is null").count() == 0 and out.count() == 100


def test_vertical_hole_and_two_dimensions(spark):
    pdf = field(30).assign(x=5.0, y=5.0)
    out = kriging.krige_blocks(spark.createDataFrame(pdf), spark.createDataFrame(pdf), V, (3, 3, 3), 500, margin=1.0)
    assert out.filter("abs(kriging_pred - grade) > 1e-6").count() == 0
    flat = by_id(kriging.apply_global(spark.createDataFrame(pdf), kriging.fit_global(spark.createDataFrame(pdf), V, dims=2)))
    assert np.allclose(flat.kriging_pred, pdf.grade.mean())


def test_system_size_is_bounded(spark):
    with pytest.raises(ValueError):
        kriging.fit_global(spark.createDataFrame(field(5)), V, n_max=10**6)


def test_out_of_fold_ignores_own_value(spark):
    pdf = field(200)
    base = by_id(kriging.krige_out_of_fold(spark.createDataFrame(pdf), V))
    pdf.loc[3, "grade"] += 1000
    moved = by_id(kriging.krige_out_of_fold(spark.createDataFrame(pdf), V))
    at = base.index[base.sample_id == "s3"][0]
    assert np.isclose(base.kriging_pred[at], moved.kriging_pred[at]) and not np.allclose(base.kriging_pred, moved.kriging_pred)


def test_variogram_columns_equal_numpy(spark):
    h = np.array([0.0, 1e-6, 10.0, 60.0, 200.0])
    df = spark.createDataFrame([(float(v),) for v in h], "h double")
    for model in MODELS:
        v = Variogram(model, 60.0, 4.0, 0.5)
        got = np.array([r.g for r in df.select(variogram.gamma_column(F.col("h"), v).alias("g")).collect()])
        assert np.allclose(got, v.gamma(h)) and got[0] == 0.0
    with pytest.raises(ValueError):
        Variogram("spherical", 10.0, 1.0, 2.0)


def test_lag_table_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    xyz = np.column_stack([rng.integers(0, 8, 150) * 10 + 5, rng.integers(0, 8, 150) * 10 + 5, -rng.integers(0, 30, 150) - 0.5]).astype(float)
    z = rng.normal(50, 3, 150)
    df = spark.createDataFrame(pd.DataFrame(xyz, columns=["x", "y", "depth"]).assign(grade=z))
    got = variogram.lag_table(df, 10.0, 4, (10.0, 10.0, 1.0)).orderBy("lag").toPandas()
    i, j = np.triu_indices(150, 1)
    h = np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(1))
    lag = np.floor(h / 10).astype(int)
    for row in got.itertuples():
        at = lag == row.lag
        assert row.pairs == at.sum() and np.isclose(row.h, h[at].mean()) and np.isclose(row.gamma, 0.5 * np.mean((z[i] - z[j])[at] ** 2))
    assert set(got.lag) == {0, 1, 2, 3}


def test_lags_of_random_places_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    xyz = rng.uniform([-300, 0, -200], [500, 700, 0], (3000, 3))
    z = 30 + np.sin(xyz[:, 0] / 60) * 5 + rng.normal(0, 1, 3000)
    df = spark.createDataFrame(pd.DataFrame(xyz, columns=["x", "y", "depth"]).assign(grade=z))
    i, j = np.triu_indices(3000, 1)
    h = np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(1))
    at = [np.floor(h / 60) == k for k in range(5)]
    want = np.array([[a.sum(), h[a].mean(), 0.5 * np.mean((z[i] - z[j])[a] ** 2)] for a in at])

    def error(table):
        got = table.orderBy("lag").toPandas()
        return np.abs(got[["pairs", "h", "gamma"]].to_numpy(float) / want - 1).max(axis=0)

    rms = np.array([np.sqrt(np.mean(h[a] ** 2)) for a in at])
    for cell in ((15.0, 15.0, 2.0), (100.0, 100.0, 10.0), (70.0, 45.0, 130.0)):
        table = variogram.lag_table(df, 60.0, 5, cell)
        off = error(table)
        assert off[0] == 0 and off[1] < 0.02 and off[2] < 1e-9
        assert np.allclose([r.h_rms for r in table.orderBy("lag").collect()], rms, rtol=1e-9)


def test_lags_of_repeats_full_boxes_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(variogram, "_GROUP_PAIRS", 500)
    rng = np.random.default_rng(6)
    xyz = np.round(rng.uniform(0, 60, (400, 3)))
    xyz[:100] = xyz[0]
    xyz[100:160] = [30.0, 30.0, 30.0]
    z = rng.normal(0, 1, 400)
    df = spark.createDataFrame(pd.DataFrame(xyz, columns=["x", "y", "depth"]).assign(grade=z))
    i, j = np.triu_indices(400, 1)
    lag = np.floor(np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(1)) / 5).astype(int)
    got = variogram.lag_table(df, 5.0, 8, (12.0, 7.0, 30.0)).orderBy("lag").collect()
    assert [r.pairs for r in got] == [(lag == k).sum() for k in range(8)]
    assert np.allclose([r.gamma for r in got], [0.5 * np.mean((z[i] - z[j])[lag == k] ** 2) for k in range(8)])
    assert variogram.lag_table(df.limit(0), 5.0, 8, (12.0, 7.0, 30.0)).count() == 0
    assert variogram.lag_table(df.limit(1), 5.0, 8, (12.0, 7.0, 30.0)).count() == 0


def test_fit_recovers_a_variogram(spark):
    truth = Variogram("exponential", 80.0, 5.0, 1.0)
    h = np.arange(5.0, 150.0, 10.0)
    lags = spark.createDataFrame([(float(d), 100, float(g)) for d, g in zip(h, truth.gamma(h))], "h double, pairs bigint, gamma double")
    fitted, error = variogram.fit_variogram(lags)
    assert fitted.model == "exponential" and fitted.range == pytest.approx(80, rel=0.02) and error < 1e-4


def test_search_prefers_a_fitting_range_and_counts(spark):
    df = spark.createDataFrame(field(250))
    trials = search.search_variogram(df, 8, 200, 3)
    pdf = trials.toPandas()
    assert len(pdf) == 8 and (pdf.nugget <= pdf.sill).all() and (pdf.rmse < 1e5).all()
    stats = search.search_stats(trials).first()
    assert stats.best_rmse == pdf.rmse.min() and stats.evals_total == 8 and stats.evals_to_best == pdf.sort_values("trial").rmse.argmin() + 1
    assert stats.std_rmse == pytest.approx(pdf.rmse.std(ddof=0))


def test_edge_rows_and_constant_axis(spark):
    df = spark.createDataFrame([(float(v), 1.0, -1.0) for v in range(6)], "x double, y double, depth double")
    grid = blocks.fit_grid(df, (5, 1, 3))
    half = {r.x: r.bi for r in blocks.assign_blocks(df, grid).collect()}
    assert half[5.0] == 4 and half[1.0] == 1 and {r.bk for r in blocks.assign_blocks(df, grid).collect()} == {0}
    shared = [r.bi for r in blocks.assign_blocks(df, grid, "shared").filter("x = 1").collect()]
    assert sorted(shared) == [0, 1]


def dense_field():
    # A cluster holds most rows, so that blocks of equal width cannot hold equal numbers.
    pdf = field(900)
    pdf.loc[200:, ["x", "y", "depth"]] *= 0.05
    pdf["grade"] = 30 + np.sin(pdf.x / 20) * 5 + np.cos(pdf.y / 25) * 3 + pdf.depth / 50
    return pdf


def test_every_location_is_in_the_system_of_its_cell(spark):
    pdf = dense_field()
    points = kriging.distinct_points(spark.createDataFrame(pdf))
    near, splits = kriging.fit_cells(points, blocks.fit_grid(points, (2, 2, 1)), 100, 0.25)
    rows = near.toPandas()
    own = rows[rows._own]
    assert len(own) == 900 and len(own.drop_duplicates(["x", "y", "depth"])) == 900 and splits
    sizes = rows.groupby(["block_id", "_cell"])._own.agg(["size", "sum"])
    assert sizes["size"].max() <= 100 and sizes["sum"].min() > 0 and (sizes["size"] > sizes["sum"]).any()
    # Kriging is exact at the data, so a training row that enters no system shows.
    train = spark.createDataFrame(pdf)
    out = by_id(kriging.krige_blocks(train, train, V, "auto", 100))
    assert len(out) == 900 and np.allclose(out.kriging_pred, out.grade)
    flat = by_id(kriging.krige_blocks(train, train, V, (1, 1, 1), 100, dims=2, variance=True))
    assert np.allclose(flat.kriging_pred, flat.grade) and np.allclose(flat.depth, out.depth) and np.allclose(flat.kriging_pred_var, 0, atol=1e-6)


def test_out_of_fold_and_search_use_rows_beyond_one_system(spark):
    pdf = dense_field()
    # A location's own twin in another fold gives its value back, unless the location was not sampled.
    twins = pd.concat([pdf.assign(sample_id=[f"s{i}-{j}" for i in range(900)]) for j in range(12)])
    out = by_id(kriging.krige_out_of_fold(spark.createDataFrame(twins), V, n_max=100))
    assert len(out) == 12 * 900 and np.allclose(out.kriging_pred, out.grade)
    # An extreme value moves the score, whichever row it is.
    cells, _ = kriging.fit_cells(kriging.distinct_points(spark.createDataFrame(pdf)), blocks.fit_grid(spark.createDataFrame(pdf), (1, 1, 1)), 100, 0.25)
    cells = cells.cache()
    base = search.cross_validate(cells, [V], k=2).first().rmse
    for at in (0, 899):
        here = (F.col("x") == float(pdf.x[at])) & (F.col("y") == float(pdf.y[at]))
        moved = cells.withColumn("value", F.when(here, F.col("value") + 1000).otherwise(F.col("value")))
        assert search.cross_validate(moved, [V], k=2).first().rmse > base + 5


@pytest.mark.parametrize("model", MODELS)
def test_fold_errors_come_from_factors_and_equal_refits(model, monkeypatch):
    """No system is inverted as a whole, and a stack that cannot be factored is solved trial by trial."""
    pdf = field(90)
    xyz, z, folds = pdf[["x", "y", "depth"]].to_numpy(), pdf.grade.to_numpy(), np.arange(90) % 5
    trials = [Variogram(model, 60.0, 4.0, 0.5), Variogram(model, 20.0, 2.0, 1.0)]
    with monkeypatch.context() as m:
        m.setattr(kriging, "inverse_system", lambda *_: pytest.fail("a whole inverse"))
        found = kriging.fold_estimates_of(xyz, z, folds, trials)
    monkeypatch.setattr(kriging, "covariance_factors", lambda *_: None)
    for v, estimates, slow in zip(trials, found, kriging.fold_estimates_of(xyz, z, folds, trials)):
        assert np.allclose(estimates, slow, atol=1e-8)
        for f in range(5):
            out = folds == f
            refit = kriging.solve_kriging(xyz[~out], z[~out], v).predict(xyz[out])[0]
            assert np.allclose(estimates[out], refit, atol=1e-8)


def test_estimates_of_a_reach_equal_all_points_and_skip_the_far_ones(monkeypatch):
    rng = np.random.default_rng(4)
    points, targets = rng.uniform(0, 1000, (800, 3)), rng.uniform(-300, 1300, (700, 3))
    targets[0], targets[1] = points[0], [np.nan, 0, 0]
    for dims in (2, 3):
        system = kriging.solve_kriging(points, rng.normal(40, 5, 800), Variogram("spherical", 120.0, 6.0, 1.0), dims)
        with monkeypatch.context() as m:
            m.setattr(kriging, "distances", lambda *_: pytest.fail("all points were met"))
            near = system.predict(targets)[0]
        far = system.variogram.gamma(kriging.distances(targets[:, :dims], system.points)) @ system.weights + system.level
        assert np.allclose(near, far, rtol=1e-9, atol=1e-9, equal_nan=True) and np.isnan(near[1]) and not np.isnan(near[0])


def test_two_dimensions_estimate_a_place_once(spark, monkeypatch):
    train = field(200)
    targets = pd.concat([field(30, 1).assign(depth=-float(d), sample_id=[f"t{d}-{i}" for i in range(30)]) for d in range(40)])
    met = []
    plain = kriging._krige_cells
    monkeypatch.setattr(kriging, "_krige_cells", lambda p, t, *a, **k: met.append(t.count()) or plain(p, t, *a, **k))
    out = by_id(kriging.krige_blocks(spark.createDataFrame(train), spark.createDataFrame(targets), V, (2, 2, 1), 150, dims=2, variance=True))
    assert met == [30] and len(out) == 1200 and set(targets.depth) == set(out.depth)
    first = out.groupby(["x", "y"]).kriging_pred.agg(["min", "max"])
    assert len(first) == 30 and (first["min"] == first["max"]).all() and (out.kriging_pred_status == "ok").all()
    missing = spark.createDataFrame([("n", None, 5.0, -1.0)], "sample_id string, x double, y double, depth double")
    kept = kriging.krige_blocks(spark.createDataFrame(train), missing, V, (1, 1, 1), 300, dims=2).first()
    assert kept.sample_id == "n" and kept.kriging_pred is None and kept.kriging_pred_status is not None


def test_out_of_fold_systems_are_factored_not_inverted(spark, monkeypatch):
    """Folds and targets use one Cholesky factor; without one they come from the whole inverse, with the same results."""
    pdf = field(60)
    table = pa.Table.from_pydict({**{a: pdf[a] for a in ("x", "y", "depth")}, "_sums": [
        [{"_fold": i % 5, "s": float(g), "n": 1}] + ([{"_fold": 3, "s": 31.0, "n": 1}] if i % 7 == 0 and i % 5 != 3 else []) for i, g in enumerate(pdf.grade)]})
    wanted = pa.Table.from_pydict({**{a: [*pdf[a], *field(9, 1)[a]] for a in ("x", "y", "depth")}, "_fold": [i % 5 for i in range(60)] + [-1] * 9})
    with monkeypatch.context() as m:
        m.setattr(kriging, "inverse_system", lambda *_: pytest.fail("a whole inverse"))
        pred, _, status = kriging._score_folds(table, wanted, V, 5)
    monkeypatch.setattr(kriging, "covariance_factors", lambda *_: None)
    slow, _, slow_status = kriging._score_folds(table, wanted, V, 5)
    assert np.isfinite(pred).all() and np.allclose(pred, slow, atol=1e-8) and list(status) == list(slow_status) == ["ok"] * 69


@pytest.mark.parametrize("n", [1, 7, 400])
def test_covariances_are_made_in_tiles(monkeypatch, n):
    rng = np.random.default_rng(n)
    points, values = rng.uniform(0, 200, (n, 3)), rng.normal(30, 5, n)
    monkeypatch.setattr(kriging, "_TILE_CELLS", 1000)
    largest = []
    apart = kriging.distances
    monkeypatch.setattr(kriging, "distances", lambda a, b: largest.append(len(a) * len(b)) or apart(a, b))
    for model in ("spherical", "exponential", "gaussian"):
        v = Variogram(model, 120.0, 9.0, 1.5)
        assert (kriging.covariances(points, v) == v.sill - v.gamma(apart(points, points))).all()
        tiled = kriging.covariance_factors(None, values, [v, v], points)
        whole = kriging.covariance_factors(apart(points, points), values, [v, v])
        assert np.array_equal(tiled.half, whole.half) and np.array_equal(tiled.u, whole.u)
    assert max(largest) <= 1000
