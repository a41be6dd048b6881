import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodefield.operators import blocks, cells, kriging, search
from lodefield.operators.variogram import MODELS, Variogram

V = Variogram("spherical", 60.0, 4.0, 0.5)


def places(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, 100, (n, 3))
    xyz[n // 3:] *= 0.1  # two thirds of the points in a thousandth of the space
    xyz[:5, 0] = 50.0
    return pd.DataFrame(xyz, columns=["x", "y", "depth"]).assign(value=xyz[:, 0], sample_id=[f"s{i}" for i in range(n)], big=2**53 + 1)


def checked(spark, counts, n_max=80, margin=0.25, own_share=4):
    pdf = places()
    df = spark.createDataFrame(pdf).withColumn("big", F.col("big").cast("bigint"))
    grid = blocks.fit_grid(df, counts)
    near, found = cells.fit_cells(df, grid, n_max, margin, own_share)
    rows = near.toPandas()
    own = rows[rows._own]
    # Every location is own once, no cell is over a system's size, and other columns stay as they are.
    assert sorted(own.sample_id) == sorted(pdf.sample_id) and set(rows.big) == {2**53 + 1}
    sizes = rows.groupby(["block_id", "_cell"])._own.agg(["size", "sum"])
    assert sizes["size"].max() <= n_max and not rows.duplicated(["block_id", "_cell", "sample_id"]).any()
    # A place is looked for in the cell that owns it.
    placed = cells.place_in_cells(blocks.assign_blocks(df, grid), found).select("sample_id", "block_id", "_cell").toPandas()
    both = placed.merge(own[["sample_id", "block_id", "_cell"]], on=["sample_id", "block_id", "_cell"])
    assert len(both) == len(pdf) == len(placed)
    return rows, found


@pytest.mark.parametrize("counts", [(1, 1, 1), (3, 2, 1)])
def test_cells_of_blocks(spark, counts):
    rows, found = checked(spark, counts)
    assert not found.shards and (rows.groupby(["block_id", "_cell"])._own.mean() < 1).any()


@pytest.mark.parametrize("counts", [(1, 1, 1), (3, 2, 1)])
def test_cells_of_shards_and_overfull_shards(spark, counts, monkeypatch):
    monkeypatch.setattr(cells, "SHARD", 200)
    rows, found = checked(spark, counts, own_share=2)
    assert found.shards
    # A tiny sample promises too little, so shards are cut again until a task takes them.
    monkeypatch.setattr(cells, "LARGEST_SHARD", 300)
    monkeypatch.setattr(cells, "SAMPLE", 400)
    monkeypatch.setattr(cells, "_PER_SHARD", 100)
    _, again = checked(spark, counts)
    assert sum(len(c.axis) for c in again.shards.values()) > 8


def test_shards_do_not_change_who_is_near(spark, monkeypatch):
    whole, _ = checked(spark, (1, 1, 1), n_max=5000)
    assert len(whole) == 3000
    monkeypatch.setattr(cells, "SHARD", 500)
    parts, found = checked(spark, (1, 1, 1), n_max=5000, margin=0.3)
    # With room for all, a shard is one cell with every point within its margin.
    xyz = places()[["x", "y", "depth"]].to_numpy()
    boxes = found.shards[0].boxes(xyz.min(axis=0), xyz.max(axis=0))
    for cell, rows in parts.groupby("_cell"):
        lo, hi = boxes[cell >> 24]
        assert (rows._own | cells._near(rows[["x", "y", "depth"]].to_numpy(), lo, hi, 0.3)).all()
        assert cells._near(xyz, lo, hi, 0.3).sum() <= len(rows)


def test_the_nearest_stay_when_a_margin_is_full():
    xyz = places(500)[["x", "y", "depth"]].to_numpy()
    own = (xyz < 5).all(axis=1)
    lo, hi = np.zeros(3), np.full(3, 5.0)
    room = int(own.sum()) + 20
    _, ((_, rows, mine),) = cells.grow(xyz, own, lo, hi, room, 50.0, own_share=1)
    off = cells._outside(xyz, lo, hi).max(axis=1)
    assert mine.sum() == own.sum() and len(rows) == room and np.sort(off[rows[~mine]]).tolist() == np.sort(off[~own])[:20].tolist()


def test_repeated_single_and_no_points(spark):
    schema = "x double, y double, depth double, value double"
    one = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], schema)
    near, found = cells.fit_cells(one, blocks.fit_grid(one, (2, 2, 2)), 1, 0.5)
    assert near.count() == 1 and cells.place_in_cells(blocks.assign_blocks(one, found.grid), found).first()._cell == 0
    near, _ = cells.fit_cells(one.limit(0), found.grid, 5, 0.5)
    assert near.count() == 0


@pytest.mark.parametrize("model", MODELS)
def test_fold_errors_equal_refitting(model):
    rng = np.random.default_rng(5)
    xyz, folds = rng.uniform(0, 100, (150, 3)), rng.integers(0, 5, 150)
    z = 30 + np.sin(xyz[:, 0] / 20) * 5
    trials = [Variogram(model, r, 4.0, nugget) for r in (15.0, 60.0) for nugget in (0.2, 2.0)]
    for v, stacked in zip(trials, kriging.fold_estimates_of(xyz, z, folds, trials)):
        want = np.empty(150)
        for f in range(5):
            want[folds == f] = kriging.solve_kriging(xyz[folds != f], z[folds != f], v).predict(xyz[folds == f])[0]
        assert np.abs(kriging.fold_estimates(xyz, z, folds, v) - want).max() < 1e-8 and np.abs(stacked - want).max() < 1e-8


def test_folds_of_singular_systems_and_of_all_points():
    xyz = np.array([[0, 0, 0], [0, 0, 0], [9, 0, 0], [0, 9, 0.0]])
    z = np.array([1.0, 3.0, 5.0, 7.0])
    # Repeated places make the whole system singular; it is regularised, or solved fold by fold.
    (found,) = kriging.fold_estimates_of(xyz, z, np.array([0, 0, 1, 1]), [V])
    assert np.isfinite(found).all() and np.allclose(found[2:], 2.0, atol=1e-3)
    (none,) = kriging.fold_estimates_of(xyz[2:], z[2:], np.zeros(2, int), [V])
    assert np.isnan(none).all()


def test_search_equals_refitting_in_its_cells(spark):
    pdf = places(400).assign(value=lambda d: np.sin(d.x / 9) + d.y / 50)
    df = spark.createDataFrame(pdf)
    near, _ = kriging.fit_cells(df, blocks.fit_grid(df, (1, 1, 1)), 60, 0.25)
    near = near.cache()
    trials = [V, Variogram("exponential", 20.0, 2.0, 0.3)]
    got = search.cross_validate(near, trials, k=3, seed=42).orderBy("trial").toPandas().rmse
    rows = near.withColumn("held", F.pmod(F.xxhash64(F.lit(43), "x", "y", "depth"), F.lit(3))).toPandas()
    for trial, v in enumerate(trials):
        errors = []
        for f in range(3):
            squares = []
            for _, cell in rows.groupby(["block_id", "_cell"]):
                xyz, out = cell[["x", "y", "depth"]].to_numpy(), (cell.held == f).to_numpy()
                wanted = out & cell._own.to_numpy()
                if wanted.any():
                    pred = kriging.solve_kriging(xyz[~out], cell.value.to_numpy()[~out], v).predict(xyz[wanted])[0]
                    squares += ((pred - cell.value.to_numpy()[wanted]) ** 2).tolist()
            errors.append(np.sqrt(np.mean(squares)))
        assert got[trial] == pytest.approx(np.mean(errors), rel=1e-8)


def test_training_rows_and_targets_have_one_estimator(spark):
    rng = np.random.default_rng(9)
    xyz = rng.uniform(0, 100, (2400, 3))
    pdf = pd.DataFrame(xyz, columns=["x", "y", "depth"]).assign(
        grade=30 + np.sin(xyz[:, 0] / 15) * 5 + np.cos(xyz[:, 1] / 12) * 3 + rng.normal(0, 0.3, 2400), sample_id=[f"s{i}" for i in range(2400)])
    train, test = pdf[:1600], pdf[1600:].assign(only_here=2**53 + 1)
    own, rest = kriging.krige_with_held_out(spark.createDataFrame(train), spark.createDataFrame(test), V, n_max=200)
    own, rest = own.toPandas(), rest.toPandas()
    assert len(own) == 1600 and len(rest) == 800 and set(rest.only_here) == {2**53 + 1} and set(own.kriging_pred_status) == {"ok"}
    # Errors of held-out training rows are distributed like those of the targets; a fold's rows know a fifth less.
    a, b = ((d.kriging_pred - d.grade).to_numpy() for d in (own, rest))
    assert abs(a.std() / b.std() - 1) < 0.2 and np.abs(np.quantile(a, [0.1, 0.5, 0.9]) - np.quantile(b, [0.1, 0.5, 0.9])).max() < 0.25 * b.std()
    # One cell: equal to plain systems.
    own, rest = kriging.krige_with_held_out(spark.createDataFrame(train[:200]), spark.createDataFrame(test[:50]), V, n_max=5000)
    want = kriging.solve_kriging(train[:200][["x", "y", "depth"]].to_numpy(), train[:200].grade.to_numpy(), V)
    rest = rest.toPandas()
    assert np.allclose(rest.kriging_pred, want.predict(rest[["x", "y", "depth"]].to_numpy())[0])
    alone = kriging.krige_out_of_fold(spark.createDataFrame(train[:200]), V).toPandas().set_index("sample_id").kriging_pred
    assert np.allclose(own.toPandas().set_index("sample_id").kriging_pred.sort_index(), alone.sort_index())


def test_rows_without_a_value_are_estimated_too(spark):
    rows = [(f"s{i}", float(i), float(i % 7), 0.0, float(i % 5)) for i in range(60)] + [("none", 3.5, 2.5, 0.0, None)]
    out = kriging.krige_out_of_fold(spark.createDataFrame(rows, "sample_id string, x double, y double, depth double, grade double"), V).toPandas()
    assert len(out) == 61 and out.kriging_pred.notna().all()
