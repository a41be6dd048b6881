"""Steps that many queries share: rows made once, equal rows handled as one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from lodefield.functions import quantiles
from lodefield.operators import explain, kriging, split, trees, variogram
from lodefield.operators.trees import TreeParams
from lodefield.plans import registry
from lodefield.plans import views as V


def test_samples_and_predictions_are_made_once(spark, sf):
    """Fits scan the written samples, not the source tables and their join."""
    assert all("lodefield-samples" in f for f in V.cleaned(spark, sf).inputFiles())
    assert all("lodefield-predicted" in f for f in registry.QUERIES["oof_ridge"](spark, sf).inputFiles())


def test_quantiles_stay_exact_with_wide_brackets(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("cast(hash(id) as double) as v")
    want = df.selectExpr("percentile(v, array(0.02, 0.25, 0.5, 0.98))").first()[0]
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 5)
    assert quantiles.exact_quantiles(df, ["v"], [0.02, 0.25, 0.5, 0.98])["v"] == want


def test_columns_of_locations_give_the_lags_of_all_pairs(spark):
    """Vertical holes with repeats, equal depths and pairs exactly on a lag's edge, for any number of groups a box."""
    rng = np.random.default_rng(11)
    hole = rng.integers(0, 12, 900)
    pdf = pd.DataFrame({"x": -20.0 + 12 * (hole % 4), "y": 9.0 * (hole // 4), "depth": -rng.integers(0, 400, 900) / 5, "grade": rng.normal(40, 9, 900)})
    df = spark.createDataFrame(pdf)
    places = pdf.groupby(["x", "y", "depth"]).grade.agg(n="count", s="sum", q=lambda g: (g * g).sum()).reset_index().astype(float)
    xyz, g = pdf[["x", "y", "depth"]].to_numpy(), pdf.grade.to_numpy()
    i, j = np.triu_indices(len(g), 1)
    h = np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(1))
    lag = np.floor(h / 6).astype(int)
    for groups in (0, 1, 3):
        if groups:
            got = variogram._lag_means(variogram._column_meetings(spark.createDataFrame(places), 6.0, 5, groups)).toPandas()
        else:
            got = variogram.lag_table(df, 6.0, 5, (3.0, 3.0, 1.0)).toPandas()
        got = got.sort_values("lag")
        assert got.pairs.tolist() == [(lag == k).sum() for k in range(5)]
        assert np.allclose(got.gamma, [((g[i] - g[j]) ** 2)[lag == k].mean() / 2 for k in range(5)], rtol=1e-9)
        assert np.allclose(got.h_rms, [np.sqrt((h[lag == k] ** 2).mean()) for k in range(5)], rtol=1e-9)
        assert np.allclose(got.h, [h[lag == k].mean() for k in range(5)], rtol=1e-2)


def test_vertical_holes_meet_as_columns(spark, monkeypatch):
    def nodes(*_):
        raise AssertionError("columns were reduced to nodes")

    monkeypatch.setattr(variogram, "_meetings", nodes)
    df = spark.range(400).selectExpr("cast(id % 4 as double) as x", "0.0D as y", "-cast(id div 4 as double) as depth", "cast(id % 7 as double) as grade")
    assert variogram.lag_table(df, 5.0, 2, (2.0, 2.0, 2.0)).count() == 2


def test_rows_of_equal_bins_give_the_trees_of_all_rows(spark):
    """MLlib over the single rows, repeats and all, makes the same trees; the fit itself has a row for each place."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"a": rng.integers(0, 20, 3000) / 4, "b": rng.integers(-5, 6, 3000) * 1.0})
    pdf["grade"] = pdf.a * pdf.b + 3 * (pdf.b > 1) + rng.normal(size=3000)
    df = spark.createDataFrame(pdf)
    params = TreeParams(4, 3, 0.3)
    direct = trees._regressor(params, "grade").fit(trees.assemble(df, ["a", "b"]))
    model = trees.fit_trees(df, ["a", "b"], params=params)
    assert trees.grouped_rows(df, trees.bin_values(df, ["a", "b"]), "grade").count() == 220
    one, other = (trees.score_trees(df, m, ["a", "b"], "p").select("p").toPandas().p.to_numpy() for m in (model, direct))
    assert np.allclose(one, other, rtol=1e-9, atol=1e-9)
    assert np.allclose(model.featureImportances.toArray(), direct.featureImportances.toArray(), atol=1e-9)


def test_bins_of_many_values_are_cut_as_the_model_cuts(spark):
    """Raw values fall on the side of each threshold on which their bin's value is; a value most rows share leaves the rest their bins."""
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"a": rng.normal(size=2000), "b": np.where(rng.uniform(size=2000) < 0.98, 0.0, rng.uniform(1, 9, 2000))})
    pdf["grade"] = np.sin(3 * pdf.a) + 5 * (pdf.b > 4)
    df = spark.createDataFrame(pdf)
    values = trees.bin_values(df, ["a", "b"])
    assert len(values["a"]) == 32 and len(values["b"]) > 8
    model = trees.fit_trees(df, ["a", "b"], params=TreeParams(10, 4, 0.3))
    middles = {i: np.array(trees.middles(values[c])) for i, c in enumerate("ab")}
    ends = [(f, t) for path in explain.leaves_of(model).paths for f, *ends in path for t in ends if np.isfinite(t)]
    assert {f for f, _ in ends} == {0, 1} and all(np.abs(middles[f] - t).min() < 1e-12 for f, t in ends)
    assert trees.rmse_of(trees.score_trees(df, model, ["a", "b"], "p"), "grade", "p") < 0.35


def test_clusters_weigh_a_place_by_its_rows(spark):
    """Centres are the means of the rows, and the fit's cost is that of all rows."""
    rng = np.random.default_rng(14)
    places = np.r_[rng.normal(0, 1, (10, 3)), rng.normal(50, 1, (10, 3))]
    pdf = pd.DataFrame(places[rng.integers(0, 20, 500) // (1 + (np.arange(500) % 2))], columns=["x", "y", "depth"])
    model = trees.fit_clusters(spark.createDataFrame(pdf), 2, 2)
    want = np.array([part.mean() for _, part in pdf.groupby(pdf.x > 25)])
    assert np.allclose(sorted(map(tuple, model.clusterCenters())), sorted(map(tuple, want)))
    assert "_n" == model.getWeightCol() and model.summary.trainingCost > 0


def test_split_finds_its_edge_in_one_pass(spark, monkeypatch):
    """Uniform hashes need one pass; others, as when the rank lies elsewhere, are searched as a whole."""
    plain, searched = quantiles.order_statistics, []
    monkeypatch.setattr(quantiles, "order_statistics", lambda *a: searched.append(a) or plain(*a))
    df = spark.range(20_000).selectExpr("concat('s', id) as sample_id", "id")
    hashes = np.sort(df.select(split.keyed_hash("42p", "sample_id").alias("h")).toPandas().h.to_numpy())
    test = split.split_exact(df, 0.3).filter("_set = 'Test'").select(split.keyed_hash("42p", "sample_id").alias("h")).toPandas().h
    assert not searched and len(test) == 6000 and test.max() == hashes[5999]
    crowded = spark.range(1000).selectExpr("id * id as h")
    found = quantiles.uniform_rank(crowded, "h", 700, 1000, 2**60 - 1)
    assert searched and (found.lo, found.below, found.rows) == (490_000, 700, 1)
    ties = spark.range(900).selectExpr("(id % 3) * cast(pow(2, 58) as bigint) as h")
    found = quantiles.uniform_rank(ties, "h", 450, 900, 2**59)
    assert (found.lo, found.below, found.rows) == (2**58, 300, 300)


def test_hybrid_kriges_points_without_their_features(spark, sf, monkeypatch):
    """The tables that kriging writes and shuffles hold the points' own columns, and no copy of the features is kept."""
    met, kept = [], []
    krige, fit = kriging.krige_with_held_out, trees.fit_cluster_models
    monkeypatch.setattr(kriging, "krige_with_held_out", lambda train, test, *a, **k: met.extend([train.columns, test.columns]) or krige(train, test, *a, **k))

    def watched(train, *a, **k):
        kept.append(type(train).persist)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(type(train), "persist", lambda df, *_: kept.append(df.columns) or df)
            return fit(train, *a, **k)

    monkeypatch.setattr(trees, "fit_cluster_models", watched)
    found = registry.QUERIES["hybrid"](spark, sf)
    assert met == [["sample_id", "x", "y", "depth", "grade"]] * 2
    assert kept and all("_n" in columns for columns in kept[1:])
    assert found.filter("hybrid_pred is null").count() == 0


def test_cluster_restarts_move_together_and_equal_mllib(spark, monkeypatch):
    rng = np.random.default_rng(12)
    # Neighbouring parts overlap, so that rounds are needed, but the best of some restarts is the same whatever the first centres.
    middle = np.array([[0, 0, 0], [400, 0, 0], [0, 400, 0], [400, 400, 0]])[rng.integers(0, 4, 900)]
    pdf = pd.DataFrame(middle + rng.normal(size=(900, 3)).round(1) * 90, columns=["x", "y", "depth"])
    df = spark.createDataFrame(pdf).repartition(3)
    together, moved = [], trees._moved
    monkeypatch.setattr(trees, "_moved", lambda packed, starts: together.append(len(starts)) or moved(packed, starts))
    own = trees.fit_clusters(df, 4, 6)
    places = trees.assemble(df.groupBy("x", "y", "depth").count().withColumn("_n", F.col("count").cast("double")), ["x", "y", "depth"])
    alone = [
        KMeans(k=4, seed=42 + s, maxIter=50, featuresCol="_features", predictionCol="cluster", weightCol="_n").fit(places) for s in range(6)]
    assert own.summary.trainingCost == pytest.approx(min(m.summary.trainingCost for m in alone), rel=1e-3)
    best = min(alone, key=lambda m: m.summary.trainingCost)
    assert np.allclose(sorted(map(tuple, own.clusterCenters())), sorted(map(tuple, best.clusterCenters())), rtol=0, atol=3)
    assert together[0] == 6 and together == sorted(together, reverse=True) and len(together) <= 50
    marked = trees.assign_clusters(df, own)
    assert marked.groupBy("cluster").agg(*[F.avg(a).alias(a) for a in ("x", "y", "depth")]).count() == 4 and own.getK() == 4
