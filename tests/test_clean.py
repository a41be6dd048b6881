import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodefield.functions import quantiles
from lodefield.functions.moments import moments
from lodefield.operators import clean
from lodefield.operators.components import apply_components, fit_components

PROBS = [0.0, 0.02, 0.25, 1 / 3, 0.5, 0.98, 1.0]


def frame(spark, values, parts=4):
    return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(parts)


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(size=3001), np.repeat(5.0, 50), np.r_[np.repeat(7.0, 700), np.random.default_rng(2).uniform(-1e6, 1e6, 1400)],
    np.exp(np.random.default_rng(3).uniform(-30, 30, 2000)), [3.0], [1.0, 2.0]], ids=["normal", "constant", "hot", "wide", "one", "two"])
@pytest.mark.parametrize("finish", [50_000, 20])
def test_quantiles_equal_numpy(spark, monkeypatch, values, finish):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", finish)
    got = quantiles.exact_quantiles(frame(spark, values), ["v"], PROBS)["v"]
    assert np.allclose(got, np.quantile(values, PROBS), rtol=1e-12, atol=0)


def test_quantiles_of_wide_values_take_three_scans(spark, monkeypatch):
    # Log-normal of sigma 20 spans over 70 powers of ten; the first two scans are the sketches and the counts of their brackets.
    values = np.exp(20 * np.random.default_rng(4).normal(size=200_000))
    passes, one_pass = [], quantiles._one_pass
    monkeypatch.setattr(quantiles, "_one_pass", lambda *a: passes.append(1) or one_pass(*a))
    df = spark.createDataFrame(pd.DataFrame({"v": values, "w": values[::-1]})).repartition(7)
    got = quantiles.exact_quantiles(df, ["v", "w"], [0.001, 0.25, 0.5, 0.75, 0.999])
    want = np.quantile(values, [0.001, 0.25, 0.5, 0.75, 0.999])
    assert np.allclose(got["v"], want, rtol=1e-12, atol=0) and np.allclose(got["w"], want, rtol=1e-12, atol=0)
    assert len(passes) == 1


@pytest.mark.parametrize("finish", [50_000, 20])
def test_quantiles_leave_out_nan_and_keep_infinities(spark, monkeypatch, finish):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", finish)
    values = np.r_[np.random.default_rng(5).normal(size=900), np.repeat(np.inf, 60), np.repeat(-np.inf, 40), np.repeat(np.nan, 100), 1.7e308, -1.7e308]
    kept = np.sort(values[~np.isnan(values)])
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(frame(spark, values), ["v"], probs)["v"]
    for p, v in zip(probs, got):
        at = p * (len(kept) - 1)
        lo, hi = kept[int(np.floor(at))], kept[int(np.ceil(at))]
        assert v == lo == hi or np.isclose(v, lo + (hi - lo) * (at % 1), rtol=1e-12, atol=0)
    assert got[0] == -np.inf and got[-1] == np.inf


def test_a_wrong_bracket_is_left(spark):
    df = frame(spark, range(100))
    found = quantiles.order_statistics(df, {"v": {10, 90}}, {"v": (100, 0.0, 99.0)}, {("v", 10): (5.0, 12.0), ("v", 90): (20.0, 30.0)})
    assert [found[("v", r)].lo for r in (10, 90)] == [10.0, 90.0]


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(frame(spark, [1.0]).filter("v > 2"), ["v"], PROBS)["v"] == []


def test_integer_ranks_keep_all_bits(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 10)
    values = [2**59 + 3 * i for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "h bigint")
    got = quantiles.order_statistics(df, {"h": {0, 250, 499}}, {"h": (500, 0, 2**60 - 1)})
    assert [got[("h", r)].lo for r in (0, 250, 499)] == [values[0], values[250], values[499]]
    assert got[("h", 250)].below == 250


def test_outliers_equal_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=800), "b": rng.exponential(size=800)})
    keep = pd.Series(True, index=pdf.index)
    for c in pdf:
        q1, q3 = pdf[c].quantile([0.25, 0.75])
        keep &= (abs((pdf[c] - pdf[c].mean()) / (pdf[c].std() + 1e-9)) <= 4) & pdf[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    got = clean.remove_outliers(spark.createDataFrame(pdf), ["a", "b"]).toPandas()
    assert len(got) == keep.sum() and np.isclose(got.a.sum(), pdf[keep].a.sum())


def test_outliers_of_one_row_and_constant(spark):
    assert clean.remove_outliers(frame(spark, [1.0]), ["v"]).count() == 0
    assert clean.remove_outliers(frame(spark, [2.0] * 9), ["v"]).count() == 9


def test_scaler_zero_spread_and_depth_norm(spark):
    df = spark.createDataFrame([(5.0, -1.0), (5.0, -3.0)], "c double, depth double")
    got = clean.scale_features(df, ["c", "depth"]).orderBy("depth").collect()
    assert [r.c_sc for r in got] == [0.0, 0.0] and [r.depth_sc for r in got] == [-1.0, 1.0]
    flat = clean.apply_depth_norm(df.withColumn("depth", F.lit(-4.0)), (-4.0, -4.0))
    assert flat.first().depth_norm == 0.0


def test_constant_target_is_in_both_tails(spark):
    df = frame(spark, [3.0] * 5)
    got = clean.select_tails(df, clean.fit_tails(df, "v"), "v").groupBy("tail").count().collect()
    assert {r.tail: r["count"] for r in got} == {"low": 5, "high": 5}


def test_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) @ np.array([[3.0, 0.2, 0.1], [0.0, 1.0, 0.3], [0.0, 0.0, 0.1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(3)
    fitted = fit_components(df, ["a", "b", "c"], 2)
    scores = apply_components(df, fitted).select("PC1", "PC2").toPandas().to_numpy()
    cov = np.cov(scores.T)
    assert abs(cov[0, 1]) < 1e-9 and np.allclose(np.diag(cov), fitted.variances) and fitted.variances[0] >= fitted.variances[1]
    assert np.allclose(fitted.variances, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2])
    assert all(max(w, key=abs) > 0 for w in fitted.loadings)
    assert fit_components(df, []) is None and apply_components(df, None) is df


def test_moments_by_fold_subtract(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(1e6, 2.0, size=(300, 2))
    rows = [(int(i % 3), float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "f int, a double, b double")
    total, parts = moments(df, ["a", "b"]), moments(df, ["a", "b"], by="f")
    rest = total.minus(parts[1])
    kept = np.array([r[1:] for r in rows if r[0] != 1])
    assert rest.n == 200 and np.allclose(rest.mean, kept.mean(0)) and np.allclose(rest.cov, np.cov(kept.T))


def test_many_quantiles_are_found_in_passes_of_few_intervals(spark, monkeypatch):
    q, rng = quantiles, np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(20_000, 3)), columns=list("abc"))
    sizes, one_pass = [], q._one_pass
    monkeypatch.setattr(q, "_one_pass", lambda df, ivs, types: sizes.append(len(ivs)) or one_pass(df, ivs, types))
    probs = [i / 15 for i in range(16)]
    got = q.exact_quantiles(spark.createDataFrame(pdf), list(pdf.columns), probs)
    assert all(got[c] == pytest.approx(np.quantile(pdf[c], probs), abs=1e-12) for c in pdf.columns)
    # Passes over many more intervals are far slower.
    assert len(sizes) > 1 and max(sizes) <= q.PASS_INTERVALS
