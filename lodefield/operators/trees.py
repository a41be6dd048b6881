"""Boosted trees on MLlib: fits, grid search, clusters and the residual hybrid."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import product
from math import inf, nextafter, sqrt
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefield.operators import boosting
from lodefield.operators.blocks import AXES
from lodefield.operators.split import split_fraction

# The full search grid (tree count, depth, step, row and column share).
FULL_GRID = {
    "n_trees": (200, 300, 400),
    "depth": (6, 8, 10),
    "step": (0.05, 0.1, 0.2),
    "row_share": (0.7, 0.9),
    "column_share": (0.8, 1.0),
}
# Spatial clusters, their k-means restarts and the smallest cluster with its own model.
CLUSTERS = 5
RESTARTS = 10
K_MEANS_ROUNDS = 50
MIN_CLUSTER_ROWS = 50
# Places whose distances to the centres are held at once, so that they stay in the processor's cache.
_PLACES = 8_192


@dataclass(frozen=True)
class TreeParams:
    n_trees: int = 20
    depth: int = 5
    step: float = 0.1
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42


# Settings of the cluster residual models and of the stacking model.
RESIDUAL_PARAMS = TreeParams(200, 6, 0.05, 0.8, 0.8)
META_PARAMS = TreeParams(200, 4, 0.08, 0.8, 0.9)


def run_parallel(spark, jobs: Iterable[Callable], parallelism: int = 4) -> list:
    """Submit independent Spark fits from a few threads; results keep their order."""
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), list(jobs))


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df)


def _regressor(params: TreeParams, label: str) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="_features", labelCol=label, predictionCol="_prediction", maxIter=params.n_trees, maxDepth=params.depth,
        stepSize=params.step, subsamplingRate=params.row_share, featureSubsetStrategy=_columns(params.column_share), seed=params.seed)


def _columns(share: float) -> str:
    return "all" if share >= 1.0 else str(share)


# Values that a feature has for the trees: MLlib tries splits between as many bins, halfway between neighbouring values.
BINS = 32
BIN_ROWS = 50_000


def bin_values(train: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """At most ``BINS`` values per feature: its own, or the middles of equal shares of the rows where it has more.

    Like MLlib's own candidates for splits they come from drawn rows (five times as many) where there are more; the fit has all rows.
    """
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in features])
    n = rows.count()
    drawn = (rows if n <= BIN_ROWS else rows.sample(BIN_ROWS / n, 42)).toArrow()
    found = {}
    for c in features:
        v = drawn.column(c).to_numpy()
        v = np.sort(v[~np.isnan(v)])
        own = np.unique(v)
        if len(own) > BINS:
            held = np.unique(v[((np.arange(BINS) + 0.5) / BINS * len(v)).astype(int)])
            # A value that many rows share leaves room for others, the ends first.
            rest = np.setdiff1d(own, held)
            own = np.union1d(held, rest[np.linspace(0, len(rest) - 1, BINS - len(held)).astype(int)])
        found[c] = own.tolist()
    return found


def middles(held: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(held, held[1:])]


def binned(df: DataFrame, thresholds: dict[str, list[float]]) -> tuple[DataFrame, dict[str, str]]:
    """Add for each feature the number of thresholds below its value (a NaN has one more), under the names returned."""
    names = {c: f"_bin_{i}" for i, c in enumerate(thresholds)}
    if not names:
        return df, names
    # A bin begins behind its threshold, because a row at a threshold goes left.
    cuts = [[-inf, *(sorted({nextafter(t, inf) for t in held}) or [nextafter(inf, 0)]), inf] for held in thresholds.values()]
    return Bucketizer(splitsArray=cuts, inputCols=list(names), outputCols=list(names.values()), handleInvalid="keep").transform(df), names


def value_of(bin_name: str, held: list[float]):
    """The value that a bin stands for; NULL for rows that have none."""
    return F.try_element_at(F.array(*[F.lit(v) for v in held]).cast("array<double>"), F.col(bin_name).cast("int") + 1)


def grouped_rows(train: DataFrame, values: dict[str, list[float]], label: str, *keys: str) -> DataFrame:
    """Rows of equal bins (and ``keys``) as one: the features' values, the mean label, the sum of squares about it and the rows ``_n``.

    A NULL label makes its group's NULL.
    """
    marked, names = binned(train.withColumns({c: F.col(c).cast("double") for c in values}), {c: middles(held) for c, held in values.items()})
    grouped = marked.groupBy(*names.values(), *keys).agg(
        F.when(F.count(label) == F.count(F.lit(1)), F.avg(label)).alias(label), (F.var_pop(label) * F.count(label)).alias("_within"),
        F.count(F.lit(1)).cast("double").alias("_n"))
    return grouped.select(*[value_of(names[c], values[c]).alias(c) for c in values], *keys, label, "_within", "_n")


def fit_grouped(rows: DataFrame, features: list[str], label: str, params: TreeParams) -> GBTRegressionModel:
    """Boosting over the groups of ``grouped_rows``, each of the weight of its rows."""
    return _regressor(params, label).setWeightCol("_n").fit(assemble(rows, features).select("_features", label, "_n"))


def fit_trees(train: DataFrame, features: list[str], label: str = "grade", params: TreeParams = TreeParams()) -> GBTRegressionModel:
    """Squared-error boosting over all rows of ``train``.

    Trees see of a row only the bins of its features, so rows of equal bins are one row with their mean label and their number as
    weight: gains and leaves are those of all rows, and the repeated passes are over the bins that occur.  Trees that draw
    their rows (``row_share``) get the number and the label sum of each bin's drawn rows (``boosting``), or, where too many bins occur, the single rows.
    """
    if params.row_share < 1.0:
        thresholds = {c: middles(held) for c, held in bin_values(train, features).items()}
        drawn = boosting.fit_drawn(train, thresholds, label, [params])
        if drawn is not None:
            return boosting.as_model(train.sparkSession, drawn[0].trees, thresholds, _regressor(params, label))
        rows = assemble(train.select(*features, label), features).select("_features", label)
        return _regressor(params, label).fit(rows)
    rows = grouped_rows(train.select(*features, label), bin_values(train, features), label).persist()
    try:
        return fit_grouped(rows, features, label, params)
    finally:
        rows.unpersist()


def score_trees(df: DataFrame, model: GBTRegressionModel, features: list[str], out: str) -> DataFrame:
    return model.copy().setPredictionCol(out).transform(assemble(df.drop(out), features)).drop("_features")


def rmse_of(df: DataFrame, truth: str, pred: str) -> float:
    gap = F.col(pred) - F.col(truth)
    return df.agg(F.sqrt(F.avg(gap * gap))).first()[0]


def grid_search(
    train: DataFrame,
    features: list[str],
    grid: dict[str, tuple] = FULL_GRID,
    base: TreeParams = TreeParams(),
    label: str = "grade",
    valid_size: float = 0.25,
    key: str = "sample_id",
    parallelism: int = 4,
) -> tuple[DataFrame, GBTRegressionModel]:
    """Trial table and the model of the first lowest validation RMSE.

    Trials that differ in the number of trees only are one fit of the largest number: a boosted model's first trees are those of
    the shorter fit, and one pass over the validation rows gives the error after each tree.  All fits that draw rows run side by side
    (``boosting``).  A shorter winner among the others is fitted once more.
    """
    spark = train.sparkSession
    parts = split_fraction(train.select(key, *features, label), valid_size, base.seed + 7, key)
    plain = parts.select(*features, label, "_set")
    rows = assemble(plain, features).select("_features", label, "_set", F.lit(1.0).alias("_n")).persist()
    names = ("n_trees", "depth", "step", "row_share", "column_share")
    lengths = [int(n) for n in grid.get("n_trees", (base.n_trees,))]
    others = [name for name in grid if name != "n_trees"]
    settings = [replace(base, n_trees=max(lengths), **dict(zip(others, chosen))) for chosen in product(*(grid[name] for name in others))]
    drawing = [p for p in settings if p.row_share < 1.0]
    try:
        fit_rows, valid_rows = rows.filter("_set = 'Train'"), rows.filter("_set = 'Test'")
        thresholds, fits = {}, None
        if drawing:
            thresholds = {c: middles(held) for c, held in bin_values(plain.filter("_set = 'Train'"), features).items()}
            fits = boosting.fit_drawn(plain.withColumn("_held", F.col("_set") == "Test"), thresholds, label, drawing, "_held")
        drawn = dict(zip(drawing, fits or []))

        def fit(params: TreeParams):
            return fit_trees(plain.filter("_set = 'Train'"), features, label, params) if params.row_share >= 1.0 else _regressor(params, label).fit(fit_rows)

        def prefixes(params: TreeParams):
            if params in drawn:
                return None, [drawn[params].errors[n - 1] for n in lengths]
            model = fit(params)
            errors = model.evaluateEachIteration(valid_rows, "squared")
            return model, [sqrt(errors[n - 1]) for n in lengths]

        done = run_parallel(spark, [lambda p=p: prefixes(p) for p in settings], parallelism)
        trials = [(replace(params, n_trees=n), rmse, model) for params, (model, rmses) in zip(settings, done) for n, rmse in zip(lengths, rmses)]
        best, _, model = min(trials, key=lambda t: t[1])
        if model is None:
            model = boosting.as_model(spark, drawn[replace(best, n_trees=max(lengths))].trees[: best.n_trees], thresholds, _regressor(best, label))
        elif best.n_trees < max(lengths):
            model = fit(best)
    finally:
        rows.unpersist()
    records = [(i, *(getattr(params, name) for name in names), rmse) for i, (params, rmse, _) in enumerate(trials)]
    table = spark.createDataFrame(
        records, "trial int, n_trees int, depth int, step double, row_share double, column_share double, rmse double")
    return table, model


def _packed_places(places: DataFrame) -> DataFrame:
    """The places of each task, their coordinates and weights, as one row of bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*([batch.column(i).to_numpy() for i in range(4)] for batch in batches))]
        if columns and len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array([np.stack(columns).tobytes()], pa.binary())], ["places"])

    return places.select(*[F.col(a).cast("double").alias(a) for a in AXES], "_n").mapInArrow(pack, "places binary")


def _moved(packed: DataFrame, starts: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """One step of k-means for several sets of centres in one pass: the means of the places nearest to each centre, and the sets' costs before it."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros((len(c), 5)) for s, c in starts.items()}
        for batch in batches:
            for raw in batch.column(0):
                places = np.frombuffer(raw.as_buffer()).reshape(4, -1)
                for at in range(0, places.shape[1], _PLACES):
                    part = places[:, at : at + _PLACES]
                    xyz, w = part[:3], part[3]
                    for s, centres in starts.items():
                        apart = sum((xyz[i] - centres[:, i, None]) ** 2 for i in range(3))
                        to = apart.argmin(axis=0)
                        sums = [np.bincount(to, w * v, len(centres)) for v in (*xyz, np.ones(len(w)), apart[to, np.arange(len(to))])]
                        total[s] += np.stack(sums, axis=1)
        rows = [(s, i, *v) for s, t in total.items() for i, v in enumerate(t.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["start", "centre", "x", "y", "z", "n", "cost"])

    found = packed.mapInArrow(near, "start bigint, centre bigint, x double, y double, z double, n double, cost double").toPandas()
    sums = found.groupby(["start", "centre"]).sum()
    moved, costs = {}, {}
    for s, centres in starts.items():
        part = sums.loc[s].sort_index()
        n = part["n"].to_numpy()[:, None]
        moved[s] = np.where(n > 0, part[["x", "y", "z"]].to_numpy() / np.where(n > 0, n, 1.0), centres)
        costs[s] = float(part["cost"].sum())
    return moved, costs


def _as_clusters(rows: DataFrame, centres: np.ndarray, start: KMeansModel, rounds: int, cost: float) -> KMeansModel:
    """MLlib's model of the centres, with the settings of ``start`` and a summary of the fit."""
    sc = rows.sparkSession.sparkContext
    jvm, vectors = sc._jvm, sc._jvm.java.util.ArrayList()
    for centre in centres.tolist():
        values = sc._gateway.new_array(jvm.double, len(centre))
        for i, v in enumerate(centre):
            values[i] = v
        vectors.add(jvm.org.apache.spark.mllib.linalg.Vectors.dense(values))
    plain = jvm.org.apache.spark.mllib.clustering.KMeansModel(vectors)
    model = KMeansModel(jvm.org.apache.spark.ml.clustering.KMeansModel(start.uid, plain))
    model = model._set(k=start.getK(), seed=start.getSeed(), maxIter=K_MEANS_ROUNDS, featuresCol="_features", predictionCol="cluster", weightCol="_n")
    summary = jvm.org.apache.spark.ml.clustering.KMeansSummary(model.transform(rows)._jdf, "cluster", "_features", start.getK(), rounds, cost)
    model._java_obj.setSummary(jvm.scala.Option.apply(summary))
    return model


def fit_clusters(train: DataFrame, k: int = CLUSTERS, restarts: int = RESTARTS, seed: int = 42) -> KMeansModel:
    """K-means on the raw coordinates; the restart of least cost wins.  Rows of one place are one point of their weight.

    MLlib chooses the restarts' first centres (``k-means||``); then all restarts move their centres in the same passes, by MLlib's rules: until no
    centre of a restart moves by more than its tolerance.
    """
    spark = train.sparkSession
    places = train.groupBy(*AXES).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    rows = assemble(places, list(AXES)).select(*AXES, "_features", "_n").persist()
    packed = _packed_places(rows).persist()
    try:
        fits = run_parallel(spark, [
            lambda s=s: KMeans(k=k, seed=seed + s, maxIter=0, featuresCol="_features", predictionCol="cluster", weightCol="_n").fit(rows)
            for s in range(restarts)])
        centres = {s: np.array(m.clusterCenters()) for s, m in enumerate(fits)}
        costs, rounds, moving = {}, dict.fromkeys(centres, 0), dict(centres)
        for _ in range(K_MEANS_ROUNDS):
            moved, found = _moved(packed, moving)
            costs |= found
            rounds |= {s: rounds[s] + 1 for s in moved}
            centres |= moved
            moving = {s: c for s, c in moved.items() if (((c - moving[s]) ** 2).sum(axis=1) > fits[s].getTol() ** 2).any()}
            if not moving:
                break
        best = min(costs, key=lambda s: costs[s])
        return _as_clusters(rows.select("_features", "_n"), centres[best], fits[best], rounds[best], costs[best])
    finally:
        packed.unpersist()
        rows.unpersist()


def assign_clusters(df: DataFrame, clusters: KMeansModel) -> DataFrame:
    return clusters.transform(assemble(df, list(AXES))).drop("_features")


def fit_cluster_models(
    train: DataFrame, features: list[str], k: int = CLUSTERS, residual: str = "residual", params: TreeParams = RESIDUAL_PARAMS,
    min_rows: int = MIN_CLUSTER_ROWS,
) -> list[GBTRegressionModel]:
    """One residual model per ``cluster``; clusters under ``min_rows`` share one fitted on all rows."""
    rows = train.select(*features, residual, "cluster")
    # Trees of all rows keep the groups of their bins; only those that draw rows scan the single rows for each tree.
    if params.row_share < 1.0:
        rows = rows.persist()
    try:
        sizes = {r.cluster: r["count"] for r in rows.groupBy("cluster").count().collect()}
        own = [c for c in range(k) if sizes.get(c, 0) >= min_rows]
        jobs = [lambda c=c: fit_trees(rows.filter(F.col("cluster") == c), features, residual, params) for c in own]
        if len(own) < k:
            jobs.append(lambda: fit_trees(rows, features, residual, params))
        fitted = run_parallel(train.sparkSession, jobs)
    finally:
        if params.row_share < 1.0:
            rows.unpersist()
    by_cluster = dict(zip(own, fitted))
    return [by_cluster.get(c, fitted[-1]) for c in range(k)]


def predict_hybrid(
    df: DataFrame, clusters: KMeansModel, models: list[GBTRegressionModel], features: list[str], kriging: str = "kriging_pred",
    out: str = "hybrid_pred",
) -> DataFrame:
    """Kriging plus the residual model of the row's cluster, in one pass over ``df``."""
    scored = assemble(assign_clusters(df, clusters), features)
    for c, model in enumerate(models):
        scored = model.copy().setPredictionCol(f"_res{c}").transform(scored)
    residual = F.coalesce(*[F.when(F.col("cluster") == c, F.col(f"_res{c}")) for c in range(len(models))])
    return scored.withColumn(out, F.col(kriging) + residual).drop("_features", *[f"_res{c}" for c in range(len(models))])
