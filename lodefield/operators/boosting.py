"""Boosted trees that draw rows, over groups of rows of equal feature bins.

Trees see of a row only the bins of its features, and rows of equal bins always go the same way.  So a tree needs of the rows it draws
only their number and the sum of their labels in each group.  Spark draws: all rows are dealt to tasks by group, and a task makes
these sums for its groups and for a run of trees.  A fit is then a task over the groups, and fits of a grid run side by side and
share the draws.  The method is MLlib's: gains of variance over all bins, features drawn for each node, labels doubled from the second tree on
(its gradient of the squared error), and the result is a model of MLlib.

Rows are drawn by seed, tree and the rows' order by group and label, so draws do not depend on the partitioning, nor on how many trees follow.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.session import checkpoint_folder
from lodefield.sources.staging import staged

#: Groups that a fit holds at most; more are fitted by MLlib.
MOST_GROUPS = 1_000_000
#: Rows of a task that draws, and bytes of drawn sums (and of the fits' estimates) that are held at once.
_DRAW_ROWS = 100_000
_SUM_BYTES = 48_000_000


@dataclass(frozen=True)
class Groups:
    """Distinct bins of all rows, ``codes`` by feature, and the error parts of the rows to be scored."""

    codes: np.ndarray
    scored: np.ndarray  # rows to be scored, by group
    mean: np.ndarray  # their mean label
    within: float  # their sum of squares about these means


@dataclass(frozen=True)
class Tree:
    """Nodes in the order of MLlib's files (a node, its left side, its right side); ``feature`` is -1 at a leaf, ``cut`` the last bin on the left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    stats: np.ndarray  # number, sum and sum of squares


@dataclass
class Fit:
    """A fit under way: its settings, trees, the groups' estimates and the error after each tree."""

    params: object
    trees: list[Tree]
    estimate: np.ndarray
    errors: list[float]


def _keyed(rows: DataFrame, thresholds: dict[str, list[float]], label: str, scored: str | None) -> DataFrame:
    """``key`` (a byte a feature: the thresholds below its value), ``label`` and ``scored``."""
    features, cuts = list(thresholds), [np.array(held) for held in thresholds.values()]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, y = batch.num_rows, batch.column("_label").to_numpy(zero_copy_only=False).astype(float)
            codes = np.empty((n, len(features)), np.uint8)
            for i in range(len(features)):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                if np.isnan(x).any():
                    raise ValueError(f"feature {features[i]} holds NULL or NaN")
                codes[:, i] = np.searchsorted(cuts[i], x)
            if not np.isfinite(y).all():
                raise ValueError("labels must be finite numbers")
            offsets = pa.array(np.arange(n + 1) * len(features), pa.int32())
            keys = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([keys, pa.array(y), batch.column("_scored")], ["key", "label", "scored"])

    given = rows.select(
        *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("_label"),
        (F.col(scored) if scored else F.lit(False)).alias("_scored"))
    return given.mapInArrow(key, "key binary, label double, scored boolean")


def _codes(keys: list[bytes], features: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), features)


def _packed(keyed: DataFrame, counts: DataFrame, ids: np.ndarray) -> DataFrame:
    """Rows to be drawn by group: one row a task with its number, its groups, their lengths and all their labels."""
    drawn = counts.filter("not scored")
    total = drawn.agg(F.sum("n")).first()[0] or 0
    if not total:
        raise ValueError("there are no rows to fit")
    tasks = math.ceil(total / _DRAW_ROWS)
    # A group of many rows is dealt by its labels, too.
    hot = [bytes(r.key) for r in drawn.filter(F.col("n") > max(_DRAW_ROWS, total / tasks) / 4).select("key").collect()]
    spot = F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("label"), F.lit(64))).otherwise(F.lit(0)) if hot else F.lit(0)
    part = F.pmod(F.xxhash64("key", spot), F.lit(tasks)).cast("int")
    shared = keyed.sparkSession.sparkContext.broadcast(ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts that share a task come one after the other, each in the order of its groups and labels.
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        parts, known = table.column("part").to_numpy(), shared.value
        keys = np.array(table.column("key").to_pylist(), known.dtype)
        labels = table.column("label").to_numpy()
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(parts)]):
            group = np.searchsorted(known, keys[a:b])
            first = np.flatnonzero(np.diff(group, prepend=-1))
            n = np.diff(np.append(first, b - a))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(parts[a])], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (
                    group[first].astype(np.int32), n.astype(np.int64), labels[a:b].astype(float))]], ["part", "groups", "lengths", "labels"])

    dealt = keyed.filter("not scored").select("key", "label", part.alias("part")).repartition(tasks, "part").sortWithinPartitions("part", "key", "label")
    return dealt.mapInArrow(pack, "part int, groups binary, lengths binary, labels binary")


def _draw(packed: DataFrame, n_groups: int, shares: list[float], seed: int, first: int, last: int) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """Number and sum of the rows drawn, trees by groups, for each share and the trees from ``first`` to before ``last``."""
    trees = last - first

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths, labels = np.frombuffer(r["lengths"], np.int64), np.frombuffer(r["labels"])
                starts = np.cumsum(lengths) - lengths
                n, s = np.empty((len(shares), trees, len(lengths)), np.int32), np.empty((len(shares), trees, len(lengths)))
                for t in range(trees):
                    u = np.random.default_rng([seed, first + t, r["part"]]).random(len(labels))
                    for k, share in enumerate(shares):
                        taken = u < share
                        n[k, t] = np.add.reduceat(taken, starts, dtype=np.int32)
                        s[k, t] = np.add.reduceat(np.where(taken, labels, 0.0), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]], pa.int32()), *[pa.array([v], pa.binary()) for v in (r["groups"], n.tobytes(), s.tobytes())]], ["part", "groups", "n", "s"])

    counts, sums = np.zeros((len(shares), trees, n_groups), np.int32), np.zeros((len(shares), trees, n_groups))
    found = packed.mapInArrow(draw, "part int, groups binary, n binary, s binary").toArrow()
    # In the order of the parts, so that sums of a group that is in several are always added alike.
    for i in np.argsort(found.column("part").to_numpy()).tolist():
        groups, n, s = (found.column(c)[i].as_buffer() for c in ("groups", "n", "s"))
        at = np.frombuffer(groups, np.int32)
        counts[:, :, at] += np.frombuffer(n, np.int32).reshape(len(shares), trees, -1)
        sums[:, :, at] += np.frombuffer(s).reshape(len(shares), trees, -1)
    return {share: (counts[k], sums[k]) for k, share in enumerate(shares)}


def _taken(rng: np.random.Generator, nodes: int, features: int, share: float) -> np.ndarray | None:
    """Features that each node may split, ``features x nodes``; None for all."""
    most = math.ceil(share * features)
    if most >= features:
        return None
    order = rng.random((features, nodes)).argsort(axis=0)
    return order.argsort(axis=0) < most


def grow(codes: np.ndarray, n: np.ndarray, s: np.ndarray, depth: int, column_share: float, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """A tree of the groups' drawn rows (``n`` and the sums ``s`` of their labels), and each group's estimate."""
    features, bins = len(codes), int(codes.max(initial=0)) + 1
    square = np.divide(s * s, n, out=np.zeros(len(n)), where=n > 0)
    feature, cut, left, right, gains, value, stats = [], [], [], [], [], [], []
    node = np.zeros(len(n), np.int64)  # place in the level
    estimate, at = np.zeros(len(n)), np.arange(len(n))
    level, made = 1, 0
    for d in range(depth + 1):
        total = np.stack([np.bincount(node, v, level) for v in (n, s, square)], axis=1)
        mean = total[:, 1] / total[:, 0]
        best, f_best, c_best = np.full(level, -np.inf), np.full(level, -1), np.full(level, -1)
        if d < depth:
            allowed = _taken(rng, level, features, column_share)
            base = node * bins
            for f in range(features):
                key = base + codes[f]
                below = np.bincount(key, n, level * bins).reshape(level, bins).cumsum(axis=1)[:, :-1]
                summed = np.bincount(key, s, level * bins).reshape(level, bins).cumsum(axis=1)[:, :-1]
                above, rest = total[:, :1] - below, total[:, 1:2] - summed
                sound = (below > 0.5) & (above > 0.5)
                if allowed is not None:
                    sound &= allowed[f][:, None]
                score = np.full(below.shape, -np.inf)
                np.divide(summed * summed, below, out=score, where=sound)
                score += np.divide(rest * rest, above, out=np.zeros(below.shape), where=sound)
                if not score.shape[1]:
                    continue
                c = score.argmax(axis=1)
                found = score[np.arange(level), c]
                better = found > best
                best[better], f_best[better], c_best[better] = found[better], f, c[better]
        base = total[:, 1] * mean
        gain = (best - base) / total[:, 0]
        # A part of equal labels is a leaf; so is one whose best gain is an error of rounding.
        split = np.isfinite(best) & (best - base > 1e-12 * (np.abs(base) + total[:, 2])) & (total[:, 2] - base > 1e-15 * total[:, 2])
        place = np.cumsum(split) - 1
        first = made + level
        feature.append(np.where(split, f_best, -1))
        cut.append(np.where(split, c_best, -1))
        left.append(np.where(split, first + 2 * place, -1))
        right.append(np.where(split, first + 2 * place + 1, -1))
        gains.append(np.where(split, gain, -1.0))
        value.append(mean)
        stats.append(total)
        made = first
        ended = ~split[node]
        estimate[at[ended]] = mean[node[ended]]
        if not split.any():
            break
        stay = np.flatnonzero(~ended)
        if len(stay) < len(node):
            codes, n, s, square, at, node = codes[:, stay], n[stay], s[stay], square[stay], at[stay], node[stay]
        node = 2 * place[node] + (codes[f_best[node], np.arange(len(node))] > c_best[node])
        level = 2 * int(split.sum())
    parts = [np.concatenate(p) for p in (feature, cut, left, right, value, gains, stats)]
    return _in_order(Tree(*parts)), estimate


def _in_order(tree: Tree) -> Tree:
    order, todo = [], [0]
    while todo:
        at = todo.pop()
        order.append(at)
        if tree.feature[at] >= 0:
            todo += [tree.right[at], tree.left[at]]
    order = np.array(order)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    follow = lambda side: np.where(side[order] >= 0, back[side[order]], -1)
    return Tree(tree.feature[order], tree.cut[order], follow(tree.left), follow(tree.right), tree.value[order], tree.gain[order], tree.stats[order])


def _more_trees(fit: Fit, groups: Groups, counts: np.ndarray, sums: np.ndarray, first: int) -> Fit:
    p = fit.params
    rows = groups.scored.sum()
    for t in range(len(counts)):
        n = counts[t].astype(float)
        if not n.any():  # no row was drawn
            tree, estimate = Tree(*[np.array([v]) for v in (-1, -1, -1, -1, 0.0, -1.0)], np.zeros((1, 3))), np.zeros(len(n))
        else:
            target = sums[t] if first + t == 0 else 2 * (sums[t] - n * fit.estimate)
            tree, estimate = grow(groups.codes, n, target, p.depth, p.column_share, np.random.default_rng([p.seed, first + t]))
        fit.trees.append(tree)
        fit.estimate = fit.estimate + (1.0 if first + t == 0 else p.step) * estimate
        gap = groups.mean - fit.estimate
        fit.errors.append(math.sqrt((groups.within + (groups.scored * gap * gap).sum()) / rows) if rows else math.nan)
    return fit


def fit_drawn(rows: DataFrame, thresholds: dict[str, list[float]], label: str, settings: list, scored: str | None = None) -> list[Fit] | None:
    """A fit for each of the ``settings``, which have one seed; None when the rows have too many distinct bins.

    ``thresholds`` are each feature's candidates for splits; a row at one goes left.  Rows for which ``scored`` holds are not fitted; they give the root mean square error after each tree.
    """
    spark = rows.sparkSession
    keyed = staged(_keyed(rows, thresholds, label, scored), "binned")
    counts = staged(keyed.groupBy("key", "scored").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"), (F.var_pop("label") * F.count(F.lit(1))).alias("within")), "bins")
    if counts.select("key").distinct().count() > MOST_GROUPS:
        return None
    keys = sorted(k.as_py() for k in counts.select("key").distinct().toArrow().column("key"))
    ids = np.array(keys, f"S{max(1, len(thresholds))}")
    held = counts.filter("scored").toArrow()
    at = np.searchsorted(ids, np.array(held.column("key").to_pylist(), ids.dtype))
    number, mean = np.zeros(len(ids)), np.zeros(len(ids))
    number[at], mean[at] = held.column("n").to_numpy(), held.column("mean").to_numpy()
    groups = Groups(np.ascontiguousarray(_codes(keys, len(thresholds)).T), number, mean, float(held.column("within").to_numpy().sum()))
    packed = _packed(keyed, counts, ids).persist()
    most = max(1, _SUM_BYTES // (8 * len(ids)))
    try:
        done: list[Fit] = []
        for lo in range(0, len(settings), most):
            done += _fit_together(spark, packed, groups, settings[lo : lo + most])
        return done
    finally:
        packed.unpersist()


def _fit_together(spark: SparkSession, packed: DataFrame, groups: Groups, settings: list) -> list[Fit]:
    sc, size = spark.sparkContext, groups.codes.shape[1]
    shares = sorted({p.row_share for p in settings})
    run = max(1, _SUM_BYTES // (12 * size * len(shares)))
    shape = sc.broadcast(groups)
    fits = [Fit(p, [], np.zeros(size), []) for p in settings]
    longest = max(p.n_trees for p in settings)
    for first in range(0, longest, run):
        last = min(first + run, longest)
        drawn = sc.broadcast(_draw(packed, size, shares, settings[0].seed, first, last))

        def more(job: tuple[int, Fit], first=first, drawn=drawn) -> tuple[int, Fit]:
            i, fit = job
            counts, sums = drawn.value[fit.params.row_share]
            left = max(0, fit.params.n_trees - first)
            return i, _more_trees(fit, shape.value, counts[:left], sums[:left], first)

        # The trees so far stay here; deep fits, which take longest, begin first.
        jobs = [(i, Fit(f.params, [], f.estimate, [])) for i, f in enumerate(fits) if f.params.n_trees > first]
        jobs.sort(key=lambda job: -job[1].params.depth)
        for i, part in sc.parallelize(jobs, len(jobs)).map(more).collect():
            fits[i] = Fit(part.params, fits[i].trees + part.trees, part.estimate, fits[i].errors + part.errors)
        drawn.destroy()
    shape.destroy()
    return fits


def as_model(spark: SparkSession, trees: list[Tree], thresholds: dict[str, list[float]], regressor) -> GBTRegressionModel:
    """MLlib's model of the trees, with the settings of ``regressor``, through MLlib's file format."""
    path = f"{checkpoint_folder(spark)}/lodefield-model-{uuid4().hex}"
    cuts = list(thresholds.values())
    given = {p.name: v for p, v in regressor.extractParamMap().items()}
    own = {p.name: v for p, v in regressor.extractParamMap().items() if regressor.isSet(p)}

    def about(kind: str, uid: str, names, **more) -> str:
        return json.dumps({
            "class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
            "paramMap": {k: v for k, v in own.items() if k in names}, "defaultParamMap": {k: v for k, v in given.items() if k in names}, **more})

    single = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain",
              "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed"}
    spark.createDataFrame(
        [(about("GBTRegressionModel", regressor.uid, given, numFeatures=len(thresholds), numTrees=len(trees)),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(
        [(i, about("DecisionTreeRegressionModel", f"dtr_{uuid4().hex[:12]}", single), 1.0 if i == 0 else float(own["stepSize"])) for i in range(len(trees))],
        "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = []
    for i, t in enumerate(trees):
        n, s, q = t.stats.T
        impurity = np.maximum(0.0, np.divide(q - t.value * s, n, out=np.zeros(len(n)), where=n > 0))
        nodes += [
            (i, (k, v, im, st, int(st[0]), g, le, ri, (f, [float(cuts[f][c])] if f >= 0 else [], -1)))
            for k, (v, im, st, g, le, ri, f, c) in enumerate(zip(*[
                a.tolist() for a in (t.value, impurity, t.stats, t.gain, t.left, t.right, t.feature, t.cut)]))]
    kind = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, "
            "rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")
    spark.createDataFrame(nodes, kind).write.parquet(f"{path}/data")
    return GBTRegressionModel.load(path)
