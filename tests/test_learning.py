from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lodefield.functions.moments import moments
from lodefield.operators import boosting, explain, fusion, trees
from lodefield.operators.split import split_fraction
from lodefield.operators.trees import TreeParams

QUICK = TreeParams(n_trees=5, depth=3, step=0.3)
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.uniform(-1, 1, (600, 3)), columns=FEATURES)
    pdf["grade"] = 10 * pdf.a + np.where(pdf.b > 0, 4.0, 0.0)
    pdf["sample_id"] = [f"s{i}" for i in range(600)]
    pdf["x"], pdf["y"], pdf["depth"] = pdf.a * 100, pdf.b * 100, pdf.c * 10
    return spark.createDataFrame(pdf).repartition(3).cache()


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(50, 5, 300)
    p = np.column_stack([y + rng.normal(0, s, 300) for s in (1, 2, 3)])
    df = spark.createDataFrame(pd.DataFrame(np.c_[p, y], columns=["p1", "p2", "p3", "grade"]))
    w, b = fusion.ridge_from_moments(moments(df, ["p1", "p2", "p3", "grade"]))
    xc, yc = p - p.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(w, want) and np.isclose(b, y.mean() - want @ p.mean(0))
    fitted = fusion.fit_fusion(df, ["p1", "p2", "p3"])
    assert sum(fitted.weights) == pytest.approx(1) and min(fitted.weights) >= 0
    fused = fusion.apply_fusion(df, fitted).agg(F.avg(F.col("fusion_pred") - F.col("grade"))).first()[0]
    assert abs(fused) < 1e-9


def test_projection():
    assert np.allclose(fusion.project_weights(np.array([-1.0, -2.0, -3.0])), 1 / 3)
    assert np.allclose(fusion.project_weights(np.array([3.0, -2.0, 1.0])), [0.75, 0, 0.25])


def test_out_of_fold_equals_direct_fits(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(1000, 1, (400, 2)), columns=["p1", "p2"])
    pdf["grade"], pdf["sample_id"] = pdf.p1 * 0.7 + pdf.p2 * 0.3 + rng.normal(size=400), [f"s{i}" for i in range(400)]
    df = spark.createDataFrame(pdf)
    out, _ = fusion.out_of_fold_ridge(df, ["p1", "p2"])
    got = out.toPandas()
    for f in range(5):
        fitted = fusion.fit_fusion(spark.createDataFrame(got[got.fold != f]), ["p1", "p2"], intercept="raw")
        part = got[got.fold == f]
        assert np.allclose(part.oof_ridge, part[["p1", "p2"]] @ np.array(fitted.weights) + fitted.intercept)


def test_trees_learn_and_rank_features(spark, data):
    model = trees.fit_trees(data, FEATURES, params=TreeParams(20, 4, 0.3))
    assert trees.rmse_of(trees.score_trees(data, model, FEATURES, "p"), "grade", "p") < 1.5
    top = explain.feature_importance(spark, model, FEATURES).orderBy("rank").collect()
    assert top[0].feature == "a" and sum(r.importance for r in top) == pytest.approx(1)


def test_grid_keeps_the_best_trial(data):
    table, model = trees.grid_search(data, FEATURES, {"depth": (1, 4), "column_share": (0.8, 1.0)}, QUICK)
    pdf = table.toPandas()
    assert len(pdf) == 4 and sorted(pdf.column_share.unique()) == [0.8, 1.0]
    best = pdf.sort_values(["rmse", "trial"]).iloc[0]
    assert model.getMaxDepth() == best.depth == 4


def test_hybrid_adds_the_cluster_model(data):
    clusters = trees.fit_clusters(data, 3, 2)
    marked = trees.assign_clusters(data, clusters).withColumn("kriging_pred", F.lit(5.0)).withColumn("residual", F.col("grade") - 5.0)
    models = trees.fit_cluster_models(marked, FEATURES, 3, params=QUICK)
    out = trees.predict_hybrid(data.withColumn("kriging_pred", F.lit(5.0)), clusters, models, FEATURES)
    for c in range(3):
        part = out.filter(F.col("cluster") == c)
        direct = trees.score_trees(part, models[c], FEATURES, "r").filter("abs(hybrid_pred - 5 - r) > 1e-9")
        assert part.count() > 0 and direct.count() == 0


def test_small_clusters_share_one_model(data):
    marked = data.withColumn("cluster", F.when(F.col("a") > 0.97, 1).otherwise(0)).withColumn("residual", F.col("grade"))
    models = trees.fit_cluster_models(marked, FEATURES, 3, params=QUICK)
    assert models[1] is models[2] and models[0] is not models[1]


def test_grid_trials_equal_separate_fits(data):
    table, model = trees.grid_search(data, FEATURES, {"n_trees": (2, 6, 4), "row_share": (0.7, 1.0), "column_share": (0.67, 1.0)}, QUICK)
    got = table.orderBy("trial").collect()
    assert len(got) == 12
    parts = split_fraction(data, 0.25, QUICK.seed + 7)
    fit_rows, valid = parts.filter("_set = 'Train'"), parts.filter("_set = 'Test'")
    for r in got:
        alone = trees.fit_trees(fit_rows, FEATURES, params=TreeParams(r.n_trees, r.depth, r.step, r.row_share, r.column_share))
        assert r.rmse == pytest.approx(trees.rmse_of(trees.score_trees(valid, alone, FEATURES, "p"), "grade", "p"), rel=1e-9)
    best = min(got, key=lambda r: r.rmse)
    assert model.getNumTrees == best.n_trees
    assert trees.rmse_of(trees.score_trees(valid, model, FEATURES, "p"), "grade", "p") == pytest.approx(best.rmse, rel=1e-9)


def test_grid_with_a_shorter_winner(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "grade": rng.normal(size=300), "sample_id": [f"s{i}" for i in range(300)]})
    table, model = trees.grid_search(spark.createDataFrame(pdf), ["a"], {"n_trees": (1, 15)}, TreeParams(depth=5, step=1.0))
    rmse = {r.n_trees: r.rmse for r in table.collect()}
    assert rmse[1] < rmse[15] and model.getNumTrees == 1


def test_shapley_adds_up(data):
    model = trees.fit_trees(data, FEATURES, params=QUICK)
    values = explain.shapley(data, model, FEATURES)
    scored = trees.score_trees(data, model, FEATURES, "p").select("sample_id", "p")
    base = scored.agg(F.avg("p")).first()[0]
    total = values.groupBy("sample_id").agg(F.sum("phi").alias("s"), F.count(F.lit(1)).alias("n")).join(scored, "sample_id").collect()
    assert len(total) == 600 and all(r.n == 3 and r.s == pytest.approx(r.p - base) for r in total)
    summary = {r.feature: r.mean_abs_phi for r in explain.shapley_summary(values).collect()}
    assert max(summary, key=summary.get) == "a" and summary["c"] < 0.2
    assert explain.shapley_dependence(values, model, FEATURES, 2).count() == 1200
    assert explain.shapley(data, model, FEATURES, n_rows=50).count() == 150


def test_shapley_equals_all_subsets(spark):
    """Eight features, every subset, every background row, scored by the model itself; one row has a NaN, some rows repeat."""
    rng = np.random.default_rng(4)
    names = [f"f{i}" for i in range(8)]
    x = rng.integers(-3, 4, (400, 8)).astype(float)
    pdf = pd.DataFrame(x, columns=names)
    pdf["grade"] = x[:, 0] * x[:, 1] + 3 * (x[:, 2] > 0) * (x[:, 3] < 1) + x[:, 4] - x[:, 5] * (x[:, 6] > x[:, 7])
    pdf["sample_id"] = [f"s{i}" for i in range(400)]
    model = trees.fit_trees(spark.createDataFrame(pdf), names, params=TreeParams(6, 5, 0.4))
    rows, others = pdf.iloc[:3].copy(), pdf.iloc[[10, 11, 11, 12]]
    rows.loc[2, "f2"] = np.nan
    got = explain.shapley(spark.createDataFrame(rows), model, names, background=spark.createDataFrame(others)).toPandas()
    # Every mixture of an explained and a background row.
    subsets = np.array([[s >> i & 1 for i in range(8)] for s in range(256)], bool)
    mixed = np.where(subsets[None, None], rows[names].to_numpy()[:, None, None], others[names].to_numpy()[None, :, None])
    flat = spark.createDataFrame(pd.DataFrame(mixed.reshape(-1, 8), columns=names).assign(at=np.arange(3 * 4 * 256)))
    assembled = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep").transform(flat)
    score = model.transform(assembled).select("at", "_prediction").toPandas().sort_values("at")["_prediction"].to_numpy()
    worth = score.reshape(3, 4, 256).mean(axis=1)
    size = subsets.sum(axis=1)
    for r, sample in enumerate(rows.sample_id):
        for i, name in enumerate(names):
            without = np.flatnonzero(~subsets[:, i])
            weight = np.array([factorial(k) * factorial(7 - k) / factorial(8) for k in size[without]])
            want = (weight * (worth[r, without | 1 << i] - worth[r, without])).sum()
            phi = got[(got.sample_id == sample) & (got.feature == name)].phi.item()
            assert phi == pytest.approx(want, abs=1e-9)


def test_shapley_of_stumps_and_empty_tables(spark, data):
    flat = trees.fit_trees(data.withColumn("grade", F.lit(3.0)), FEATURES, params=QUICK)  # no splits at all
    assert {r.phi for r in explain.shapley(data, flat, FEATURES).collect()} == {0.0}
    model = trees.fit_trees(data, FEATURES, params=QUICK)
    assert explain.shapley(data.limit(0), model, FEATURES, background=data).count() == 0
    with pytest.raises(ValueError, match="background"):
        explain.shapley(data, model, FEATURES, background=data.limit(0))


def test_partial_dependence_is_a_mean_over_rows(data):
    model = trees.fit_trees(data, FEATURES, params=QUICK)
    got = explain.partial_dependence(data, model, FEATURES, top=2, points=5).toPandas()
    assert len(got) == 10 and (got.n == 600).all()
    row = got[got.feature == "a"].iloc[0]
    direct = trees.score_trees(data.withColumn("a", F.lit(float(row.value))), model, FEATURES, "p").agg(F.avg("p")).first()[0]
    assert direct == pytest.approx(row.mean_pred)
    slope = got[got.feature == "a"].sort_values("value").mean_pred
    assert slope.is_monotonic_increasing


def test_learning_curve_sizes(data):
    got = explain.learning_curve(data, FEATURES, sizes=(0.3, 1.0), k=2, params=QUICK).orderBy("size").collect()
    assert [r.folds for r in got] == [2, 2] and got[0].train_rows < got[1].train_rows == pytest.approx(300)


def test_drawn_trees_equal_mllib_where_all_rows_are_drawn(spark, data):
    thresholds = {c: trees.middles(held) for c, held in trees.bin_values(data, FEATURES).items()}
    params = TreeParams(n_trees=6, depth=4, step=0.2)
    fit = boosting.fit_drawn(data, thresholds, "grade", [params])[0]
    own = boosting.as_model(spark, fit.trees, thresholds, trees._regressor(params, "grade"))
    other = trees.fit_trees(data, FEATURES, params=params)
    both = trees.score_trees(trees.score_trees(data, own, FEATURES, "p"), other, FEATURES, "q")
    assert both.filter("abs(p - q) > 1e-9").count() == 0
    assert np.allclose(own.featureImportances.toArray(), other.featureImportances.toArray())
    assert own.getNumTrees == 6 and own.getMaxDepth() == 4 and own.totalNumNodes == other.totalNumNodes


def test_drawn_trees_depend_on_rows_not_on_partitions(spark, data, monkeypatch):
    """Also with many tasks that draw, groups dealt by their labels, and few trees and fits at a time."""
    rows = data.withColumn("a", F.when(F.col("b") > 0, 0.5).otherwise(F.col("a"))).withColumn("b", F.lit(0.0)).withColumn("c", F.round("c"))
    rows = rows.unionByName(rows.withColumn("grade", F.col("grade") + 1)).select(*FEATURES, "grade")
    params = TreeParams(n_trees=5, depth=3, step=0.2, row_share=0.6, column_share=0.5)

    def fits(parts: int):
        cuts = {c: trees.middles(held) for c, held in trees.bin_values(rows, FEATURES).items()}
        held = rows.withColumn("_held", F.col("a") > 0.9).repartition(parts)
        return boosting.fit_drawn(held, cuts, "grade", [params, TreeParams(3, 2, 0.1, 0.9)], "_held")

    first = fits(1)
    assert [len(f.errors) for f in first] == [5, 3]
    assert [[round(e, 9) for e in f.errors] for f in fits(5)] == [[round(e, 9) for e in f.errors] for f in first]
    monkeypatch.setattr(boosting, "_SUM_BYTES", 1)
    assert [[round(e, 9) for e in f.errors] for f in fits(2)] == [[round(e, 9) for e in f.errors] for f in first]
    monkeypatch.setattr(boosting, "_DRAW_ROWS", 100)
    for f in fits(3):
        n = sum(t.stats[0, 0] for t in f.trees) / len(f.trees) / rows.filter("a <= 0.9").count()
        assert n == pytest.approx(f.params.row_share, abs=0.04)


def test_drawn_trees_of_many_groups_go_to_mllib(data, monkeypatch):
    monkeypatch.setattr(boosting, "MOST_GROUPS", 10)
    model = trees.fit_trees(data, FEATURES, params=TreeParams(4, 3, 0.3, 0.8))
    assert model.getNumTrees == 4 and trees.rmse_of(trees.score_trees(data, model, FEATURES, "p"), "grade", "p") < 4


def test_grid_query_has_the_full_settings(spark, sf, monkeypatch):
    from lodefield.plans import registry

    asked = {}

    class Asked(Exception):
        pass

    def grid_search(train, features, grid=trees.FULL_GRID, *rest, **more):
        asked["grid"] = grid
        raise Asked

    monkeypatch.setattr(trees, "grid_search", grid_search)
    with pytest.raises(Asked):
        registry.QUERIES["grid"](spark, sf)
    assert asked["grid"] == trees.FULL_GRID and max(asked["grid"]["n_trees"]) == 400 and max(asked["grid"]["depth"]) == 10


def test_stack_query_has_the_full_settings(spark, sf, monkeypatch):
    from lodefield.plans import registry

    asked = {}

    class Asked(Exception):
        pass

    def fit_trees(train, features, label="grade", params=TreeParams()):
        asked["stack"] = params
        raise Asked

    monkeypatch.setattr(fusion, "fit_trees", fit_trees)
    with pytest.raises(Asked):
        registry.QUERIES["stack"](spark, sf)
    assert asked["stack"] == trees.META_PARAMS and (asked["stack"].n_trees, asked["stack"].depth) == (200, 4)
