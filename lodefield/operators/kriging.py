"""Ordinary kriging with bounded systems.

The dense solve is a small NumPy helper that never sees more than ``n_max`` data
points; Spark decides which points meet which targets.  Two forms:

* ``fit_global`` / ``apply_global``: the fast mode.  One system on all locations while
  there are at most ``n_max``, else on a keyed subsample; targets are scored where they
  are, without a shuffle.
* ``krige_blocks``, ``krige_out_of_fold``: one system per cell from the points in and
  around it.  A cell is a block, or a part of one (``cells``): blocks with too many points
  for a system are cut until their own points fit, so every training location is used in
  the cell that holds it, with the nearest ones around it.  Cells with many targets are
  split into chunks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefield.functions.joins import lookup_join
from lodefield.operators import cells
from lodefield.operators.blocks import AXES, DEFAULT_BLOCKS, Grid, assign_blocks, fit_grid, spread_to_blocks
from lodefield.operators.cells import place_in_cells
from lodefield.operators.split import add_fold
from lodefield.operators.variogram import Variogram
from lodefield.sources.staging import staged

# Default size of a system (and of fast mode's subsample) and its greatest size.
FAST_ROWS = 3000
FAST_THRESHOLD = 5000
TARGET_CHUNK = 50_000
# Distances held at once, so that a batch stays in the processor's cache.
_BATCH_CELLS = 200_000
# Elements of the systems that are factored together, so that they stay in the processor's cache.
_STACK_CELLS = 60_000
# Size up to which triangles are inverted directly.
_LEAF = 24
# Elements of a covariance matrix that are made at once, so that the steps to them stay in the processor's cache.
_TILE_CELLS = 32_768
_REGULARISERS = (0.0, 1e-10, 1e-8, 1e-6)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


@dataclass(frozen=True)
class KrigingSystem:
    """A solved system: prediction is ``gamma(target, points) @ weights + level``."""

    points: np.ndarray
    weights: np.ndarray
    level: float
    variogram: Variogram
    status: str
    inverse: np.ndarray | None = None

    def predict(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pred, var = np.empty(len(targets)), np.full(len(targets), np.nan)
        dims = self.points.shape[1]
        near = self._from_near(targets[:, :dims]) if self.inverse is None and self.variogram.model == "spherical" else None
        if near is not None:
            return near, var
        size = max(16, _BATCH_CELLS // len(self.points))
        for at in range(0, len(targets), size):
            gamma = self.variogram.gamma(distances(targets[at:at + size, :dims], self.points))
            pred[at:at + size] = gamma @ self.weights + self.level
            if self.inverse is not None:
                right = np.column_stack([gamma, np.ones(len(gamma))])
                var[at:at + size] = np.einsum("ij,ij->i", right @ self.inverse, right)
        return pred, var

    def _from_near(self, targets: np.ndarray) -> np.ndarray | None:
        """Estimates of a model that is level beyond its range: only points within it are met one by one; None when they are most.

        Points are sorted by cubes as wide as the range, so those that a target meets are one run of each column of cubes next to it.
        """
        reach, low = self.variogram.range, self.points.min(axis=0)
        counts = np.floor((self.points.max(axis=0) - low) / reach) + 6
        if not np.isfinite(counts).all() or counts.prod() > 2**62 or (counts <= 8).all():
            return None
        steps = np.append(np.cumprod(counts[:0:-1].astype(np.int64))[::-1], 1)

        def cube(xyz: np.ndarray) -> np.ndarray:
            return (np.clip(np.floor((xyz - low) / reach), -2, counts - 4).astype(np.int64) + 2) @ steps

        sound = ~np.isnan(targets).any(axis=1)
        home, known = cube(np.where(sound[:, None], targets, low)), cube(self.points)
        order = np.argsort(known, kind="stable")
        points, weights, known = self.points[order], self.weights[order], known[order]
        sides = [np.array(o) @ steps[:-1] for o in itertools.product((-1, 0, 1), repeat=len(steps) - 1)]
        first = np.stack([np.searchsorted(known, home + o - 1) for o in sides], axis=1)
        n = np.stack([np.searchsorted(known, home + o + 1, "right") for o in sides], axis=1) - first
        if n.sum() > 0.3 * len(targets) * len(points):
            return None
        pred = np.full(len(targets), self.variogram.sill * self.weights.sum() + self.level)
        upto = np.cumsum(n.sum(axis=1))
        cuts = np.searchsorted(upto, np.arange(_BATCH_CELLS, (upto[-1] if len(upto) else 0) + _BATCH_CELLS, _BATCH_CELLS))
        for a, b in zip([0, *cuts], [*cuts, len(targets)]):
            some, runs = n[a:b].ravel(), first[a:b].ravel()
            at = np.arange(some.sum()) + np.repeat(runs - np.cumsum(some) + some, some)
            of = np.repeat(np.arange(b - a), n[a:b].sum(axis=1))
            gap = targets[a:b][of] - points[at]
            below = (self.variogram.gamma(np.sqrt(np.einsum("ij,ij->i", gap, gap))) - self.variogram.sill) * weights[at]
            pred[a:b] += np.bincount(of, below, minlength=b - a)
        pred[~sound] = np.nan
        return pred


def _merge_repeats(points: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places, which = np.unique(points, axis=0, return_inverse=True)
    which = which.ravel()
    return places, np.bincount(which, values) / np.bincount(which)


def solve_kriging(points: np.ndarray, values: np.ndarray, v: Variogram, dims: int = 3, variance: bool = False) -> KrigingSystem | None:
    """Solve on all axes; regularise when singular, then fall back to x and y; None when all fail."""
    attempts = [(dims, "ok")] + ([(2, "xy")] if dims > 2 else [])
    for use, plain in attempts:
        places, z = _merge_repeats(points[:, :use], values)
        n = len(places)
        if n == 0 or not (np.isfinite(places).all() and np.isfinite(z).all()):
            return None
        system = np.ones((n + 1, n + 1))
        system[:n, :n] = v.gamma(distances(places, places))
        system[n, n] = 0.0
        right = np.append(z, 0.0)
        for extra in _REGULARISERS:
            trial = system if extra == 0.0 else system - np.diag(np.append(np.full(n, extra * max(v.sill, 1e-12)), 0.0))
            try:
                solution = np.linalg.solve(trial, right)
                off = np.abs(trial @ solution - right).max()
                if not np.isfinite(off) or off > 1e-6 * max(1.0, np.abs(z).max()):
                    continue
                inverse = np.linalg.inv(trial) if variance else None
            except np.linalg.LinAlgError:
                continue
            status = plain if extra == 0.0 else f"{plain}_regularised"
            return KrigingSystem(places, solution[:n], float(solution[n]), v, status, inverse)
    return None


def inverse_system(points: np.ndarray, values: np.ndarray, v: Variogram, apart: np.ndarray | None = None) -> tuple[np.ndarray, str] | None:
    """Inverse of the system of distinct points and its status, regularised when singular; None when it does not solve for ``values``.

    ``apart`` are the points' distances, where the caller has them.
    """
    n = len(points)
    if n == 0 or not (np.isfinite(points).all() and np.isfinite(values).all()):
        return None
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = v.gamma(distances(points, points) if apart is None else apart)
    system[n, n] = 0.0
    right = np.append(values, 0.0)
    for extra in _REGULARISERS:
        trial = system if extra == 0.0 else system - np.diag(np.append(np.full(n, extra * max(v.sill, 1e-12)), 0.0))
        try:
            inverse = np.linalg.inv(trial)
        except np.linalg.LinAlgError:
            continue
        off = np.abs(trial @ (inverse @ right) - right).max()
        if np.isfinite(off) and off <= 1e-6 * max(1.0, np.abs(values).max()):
            return inverse, "ok" if extra == 0.0 else "ok_regularised"
    return None


def held_out_estimates(inverse: np.ndarray, values: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Estimates of the points ``out`` (a mask) from the other points, from the inverse of the system of all.

    With B the inverse, the errors of a held-out set F are ``inv(B[F, F]) @ (B @ (values, 0))[F]``, whatever the values at F are, so one
    factorisation serves every fold.
    """
    n = len(values)
    given = np.where(out, 0.0, values)
    seen = inverse[:n, :n] @ given
    return -np.linalg.solve(inverse[np.ix_(np.flatnonzero(out), np.flatnonzero(out))], seen[out])


def fold_estimates(
    points: np.ndarray, values: np.ndarray, folds: np.ndarray, v: Variogram, apart: np.ndarray | None = None,
) -> np.ndarray | None:
    """Every point's estimate from the points of the other folds; NaN in a fold that has all; None when a system fails.

    Systems that cannot be inverted are solved fold by fold, with what ``solve_kriging`` falls back to.
    """
    found = np.full(len(values), np.nan)
    inverted = inverse_system(points, values, v, apart)
    for fold in np.unique(folds):
        out = folds == fold
        if out.all():
            continue
        if inverted is not None:
            found[out] = held_out_estimates(inverted[0], values, out)
        if inverted is None or not np.isfinite(found[out]).all():
            system = solve_kriging(points[~out], values[~out], v)
            if system is None:
                return None
            found[out] = system.predict(points[out])[0]
    return found


def _lower_inverse(lower: np.ndarray) -> np.ndarray:
    """Inverses of a stack of lower triangles, by halves, so that nearly all of the work is products."""
    n = lower.shape[-1]
    if n <= _LEAF:
        return np.linalg.inv(lower)
    h = n // 2
    out = np.zeros(lower.shape)
    out[:, :h, :h], out[:, h:, h:] = _lower_inverse(lower[:, :h, :h]), _lower_inverse(lower[:, h:, h:])
    out[:, h:, :h] = -(out[:, h:, h:] @ (lower[:, h:, :h] @ out[:, :h, :h]))
    return out


@dataclass(frozen=True)
class CovarianceFactors:
    """Systems of the same points in covariances ``sill - gamma``, as inverses ``half`` of their Cholesky factors.

    The inverse of a system's upper left part is ``-B`` with ``B = inv(C) - u u' / total``, ``u = inv(C) 1``: a third of the work of
    inverting the whole, and only the parts of it that folds need are made.
    """

    half: np.ndarray
    u: np.ndarray
    total: np.ndarray
    sound: np.ndarray

    def solve(self, right: np.ndarray) -> np.ndarray:
        """``inv(C) @ right`` of each system."""
        return self.half.transpose(0, 2, 1) @ (self.half @ right)

    def weighted(self, values: np.ndarray) -> np.ndarray:
        """``B @ values`` of each system."""
        centred = values - values.mean()
        return self.solve(centred[:, None])[:, :, 0] - self.u * ((self.u @ centred) / self.total)[:, None]

    def level(self, values: np.ndarray) -> np.ndarray:
        """The estimated mean of each system."""
        return self.u @ values / self.total

    def held_out(self, values: np.ndarray, out: slice) -> np.ndarray:
        """Estimates of the points of a slice from the others, by system; see ``held_out_estimates``."""
        given = values - values.mean()
        given[out] = 0.0
        part = self.half[:, out.start :, out]
        block = part.transpose(0, 2, 1) @ part - self.u[:, out, None] * (self.u[:, None, out] / self.total[:, None, None])
        seen = self.solve(given[:, None])[:, out, 0] - self.u[:, out] * ((self.u @ given) / self.total)[:, None]
        return values.mean() - np.linalg.solve(block, seen[:, :, None])[:, :, 0]


def covariances(points: np.ndarray, v: Variogram) -> np.ndarray:
    """Covariances of the points, made in rows that stay in the processor's cache; the upper half is a copy of the lower one."""
    n = len(points)
    out, size = np.empty((n, n)), max(1, _TILE_CELLS // max(n, 1))
    for at in range(0, n, size):
        to = min(at + size, n)
        np.subtract(v.sill, v.gamma(distances(points[at:to], points[:to])), out=out[at:to, :to])
        out[:at, at:to] = out[at:to, :at].T
    return out


def covariance_factors(
    apart: np.ndarray | None, values: np.ndarray, trials: list[Variogram], points: np.ndarray | None = None,
) -> CovarianceFactors | None:
    """Factors of the systems of points at distances ``apart`` (or of ``points``); None when one has none.  Unsound ones do not solve for ``values``."""
    n = len(values)
    if apart is None:
        cov = np.stack([covariances(points, v) for v in trials]) if len(trials) > 1 else covariances(points, trials[0])[None]
    else:
        cov = np.empty((len(trials), n, n))
        for i, v in enumerate(trials):
            np.subtract(v.sill, v.gamma(apart), out=cov[i])
    try:
        half = _lower_inverse(np.linalg.cholesky(cov))
    except np.linalg.LinAlgError:
        return None
    right = np.column_stack((np.ones(n), values - values.mean()))
    solution = half.transpose(0, 2, 1) @ (half @ right)
    off = np.abs(cov @ solution - right).max(axis=(1, 2))
    u = np.ascontiguousarray(solution[:, :, 0])
    return CovarianceFactors(half, u, u.sum(axis=1), off <= 1e-6 * max(1.0, np.abs(values).max()))


def fold_estimates_of(
    points: np.ndarray, values: np.ndarray, folds: np.ndarray, trials: list[Variogram],
) -> list[np.ndarray | None]:
    """``fold_estimates`` for several variograms, whose systems are factored as one stack while they are small."""
    n, out = len(points), []
    if n == 0 or not (np.isfinite(points).all() and np.isfinite(values).all()):
        return [fold_estimates(points, values, folds, v) for v in trials]
    order = np.argsort(folds, kind="stable")
    places, z, apart = points[order], values[order], distances(points[order], points[order])
    starts = np.flatnonzero(np.diff(folds[order], prepend=folds.min() - 1))
    spans = [slice(a, b) for a, b in zip(starts, [*starts[1:], n]) if b - a < n]
    size = max(1, _STACK_CELLS // (n * n))

    def estimates(some: list[Variogram]) -> list[np.ndarray | None]:
        found, sound = np.full((len(some), n), np.nan), np.zeros(len(some), bool)
        try:
            factors = covariance_factors(apart, z, some)
            if factors is not None:
                sound = factors.sound.copy()
                for span in spans:
                    found[:, span] = factors.held_out(z, span)
                    sound &= np.isfinite(found[:, span]).all(axis=1)
        except np.linalg.LinAlgError:
            sound[:] = False
        if not sound.any() and len(some) > 1:  # one of the stack is singular: each is solved by itself
            return [e for v in some for e in estimates([v])]
        kept = [found[i] if sound[i] else fold_estimates(places, z, folds[order], v, apart) for i, v in enumerate(some)]
        back = np.argsort(order, kind="stable")
        return [e if e is None else e[back] for e in kept]

    for lo in range(0, len(trials), size):
        out += estimates(trials[lo : lo + size])
    return out


def distinct_points(train: DataFrame, value: str = "grade", dims: int = 3) -> DataFrame:
    """One row per location with the mean value (repeats make a system singular).

    With two dimensions a location is (x, y) and its depth is given as 0.
    """
    places = train.groupBy(*AXES[:dims]).agg(F.avg(value).alias("value"))
    return places if dims == 3 else places.withColumn("depth", F.lit(0.0))


def _point_hash(seed: int, axes: tuple[str, ...] | list[str] = AXES):
    """Uniform in [0, 1) from a point's coordinates."""
    return F.pmod(F.xxhash64(F.lit(seed), *axes), F.lit(2**53)).cast("double") / F.lit(float(2**53))


def sample_points(train: DataFrame, n_max: int = FAST_ROWS, seed: int = 42, value: str = "grade", dims: int = 3) -> pd.DataFrame:
    """At most ``n_max`` distinct locations by keyed hash, as a driver-side frame of bounded size.

    The hash is a function of the location, so a threshold taken from an approximate
    count drops nearly all rows before the grouping shuffle; should it leave too few
    locations, all are grouped.
    """
    if n_max > FAST_THRESHOLD:
        raise ValueError(f"one system may hold at most {FAST_THRESHOLD} points")
    axes = list(AXES[:dims])
    u = _point_hash(seed, axes)
    about = train.agg(F.approx_count_distinct(F.struct(*axes), 0.02)).first()[0]
    share = 1.15 * (n_max + 8 * math.sqrt(n_max) + 32) / max(about, 1)
    for part in (train.filter(u < F.lit(share)), train) if share < 1 else (train,):
        found = distinct_points(part, value, dims).orderBy(u, *axes).limit(n_max).toPandas()
        if len(found) == n_max:
            break
    return found


def fit_global(
    train: DataFrame, v: Variogram, n_max: int = FAST_ROWS, dims: int = 3, seed: int = 42, value: str = "grade", variance: bool = False,
) -> KrigingSystem | None:
    """Fast mode's system: beyond ``n_max`` locations it is a sample; ``krige_blocks`` uses all of them."""
    points = sample_points(train, n_max, seed, value, dims)
    return solve_kriging(points[list(AXES)].to_numpy(float), points["value"].to_numpy(float), v, dims, variance)


def _scored_schema(df: DataFrame, out: str) -> str:
    extra = f"{out} double, {out}_var double, {out}_status string"
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + extra


Scores = tuple[np.ndarray, np.ndarray, np.ndarray]


def _failed(n: int, status: str) -> Scores:
    return np.full(n, np.nan), np.full(n, np.nan), np.full(n, status, object)


def _scores(xyz: np.ndarray, system: KrigingSystem | None) -> Scores:
    if system is None:
        return _failed(len(xyz), "failed")
    return *system.predict(xyz), np.full(len(xyz), system.status, object)


def _places(table: pa.Table) -> np.ndarray:
    return np.column_stack([table.column(a).to_numpy().astype(float) for a in AXES])


def _score(frame: pd.DataFrame, system: KrigingSystem | None, out: str) -> pd.DataFrame:
    pred, var, status = _scores(frame[list(AXES)].to_numpy(float), system)
    return frame.assign(**{out: pred, f"{out}_var": var, f"{out}_status": status})


def _null_nan(df: DataFrame, out: str) -> DataFrame:
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in (out, f"{out}_var")})


def apply_global(targets: DataFrame, system: KrigingSystem | None, out: str = "kriging_pred") -> DataFrame:
    """Score each partition in place; the solved system (bounded) travels with the task."""
    shared = targets.sparkSession.sparkContext.broadcast(system)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _score(batch, shared.value, out)

    return _null_nan(targets.mapInPandas(score, _scored_schema(targets, out)), out)


def _fold_sums(rows: DataFrame, value: str) -> DataFrame:
    """Locations with their sum and number of rows by fold (at most one entry per fold)."""
    sums = rows.groupBy(*AXES, "_fold").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return staged(sums.groupBy(*AXES).agg(F.collect_list(F.struct("_fold", "s", "n")).alias("_sums")), "points")


def _score_folds(known: pa.Table, wanted: pa.Table, v: Variogram, k: int) -> Scores:
    """Estimates of rows with a fold from the rows of the other folds, and of rows with fold -1 from all; one inverse serves all."""
    points, targets = _places(known), _places(wanted)
    folds = wanted.column("_fold").to_numpy().astype(int)
    s, n = np.zeros((len(points), k)), np.zeros((len(points), k))
    sums = known.column("_sums").combine_chunks()
    parts, at = sums.flatten(), pc.list_parent_indices(sums).to_numpy()
    fold = parts.field("_fold").to_numpy().astype(int)
    s[at, fold], n[at, fold] = pc.fill_null(parts.field("s"), 0.0).to_numpy(), parts.field("n").to_numpy()
    some = n.sum(axis=1) > 0
    points, s, n = points[some], s[some], n[some]
    pred, var, status = _failed(len(targets), "no_data")
    if not len(points):
        return pred, var, status
    # Points that only one fold has come together, in the order of the folds.
    order = np.argsort(np.where((n > 0).sum(axis=1) == 1, n.argmax(axis=1), k), kind="stable")
    points, s, n = points[order], s[order], n[order]
    mean = s.sum(axis=1) / n.sum(axis=1)
    factors = covariance_factors(None, mean, [v], points) if np.isfinite(points).all() and np.isfinite(mean).all() else None
    if factors is not None and not factors.sound[0]:
        factors = None
    inverted = inverse_system(points, mean, v) if factors is None else None
    place = {p: i for i, p in enumerate(map(tuple, points))}
    for fold in np.unique(folds):
        rows = np.flatnonzero(folds == fold)
        left = n.sum(axis=1) - (n[:, fold] if fold >= 0 else 0)
        gone = left == 0
        if gone.all():
            continue
        z = np.divide(s.sum(axis=1) - (s[:, fold] if fold >= 0 else 0), left, out=np.zeros(len(left)), where=~gone)
        if factors is not None and fold < 0:
            system = KrigingSystem(points, -factors.weighted(z)[0], float(factors.level(z)[0]), v, "ok")
        elif factors is None and inverted is None:
            system = solve_kriging(points[~gone], z[~gone], v)
        elif fold < 0:
            solution = inverted[0] @ np.append(z, 0.0)
            system = KrigingSystem(points, solution[:-1], float(solution[-1]), v, inverted[1])
        else:
            # A location with rows in other folds has their mean, because kriging is exact at its points.
            if gone.any() and factors is not None:
                first = int(gone.argmax())
                z[gone] = factors.held_out(z, slice(first, first + int(gone.sum())))[0]
            elif gone.any():
                z[gone] = held_out_estimates(inverted[0], z, gone)
            at = np.array([place.get(p, -1) for p in map(tuple, targets[rows])])
            pred[rows], status[rows] = np.where(at >= 0, z[at], np.nan), "ok" if factors is not None else inverted[1]
            rows = rows[at < 0]
            if not len(rows):
                continue
            # Rows without a value of their own, at a place where no row has one.
            system = solve_kriging(points[~gone], z[~gone], v)
        pred[rows], var[rows], status[rows] = _scores(targets[rows], system)
    return pred, np.full(len(pred), np.nan), status


def krige_out_of_fold(
    train: DataFrame, v: Variogram, k: int = 5, n_max: int = FAST_ROWS, seed: int = 42, value: str = "grade",
    out: str = "kriging_pred", key: str = "sample_id", margin: float = 0.25, chunk_rows: int = TARGET_CHUNK,
) -> DataFrame:
    """Kriging estimate of each training row from all rows of the other folds in and around its cell."""
    folded = add_fold(train, k, seed, key, "_fold")
    points = _fold_sums(folded, value)
    grid = fit_grid(points, (1, 1, 1))
    return _krige_cells(
        points, folded, grid, n_max, margin, lambda known, wanted: _score_folds(known, wanted, v, k), folded.columns, out, chunk_rows).drop("_fold")


def krige_with_held_out(
    train: DataFrame, targets: DataFrame, v: Variogram, k: int = 5, n_max: int = FAST_ROWS, seed: int = 42, value: str = "grade",
    out: str = "kriging_pred", key: str = "sample_id", margin: float = 0.25, chunk_rows: int = TARGET_CHUNK,
    blocks: tuple[int, ...] | str = "auto",
) -> tuple[DataFrame, DataFrame]:
    """One estimator for training rows and targets: both are estimated in the same cells from the same systems.

    A training row is estimated without the rows of its fold, a target from all training rows.  Returns the training rows and the targets,
    with ``block_id``, estimate, variance (NULL) and status.
    """
    folded = add_fold(train, k, seed, key, "_fold")
    points = _fold_sums(folded, value)
    both = folded.unionByName(targets.withColumn("_fold", F.lit(-1).cast(folded.schema["_fold"].dataType)), allowMissingColumns=True)
    grid = plan_grid(points, both, n_max, margin, blocks)
    found = staged(_krige_cells(
        points, both, grid, n_max, margin, lambda known, wanted: _score_folds(known, wanted, v, k), [*both.columns, "block_id"], out, chunk_rows),
        "estimated")
    added = ["block_id", out, f"{out}_var", f"{out}_status"]
    return (found.filter("_fold >= 0").select(*train.columns, *added), found.filter("_fold < 0").select(*targets.columns, *added))


def plan_grid(train: DataFrame, targets: DataFrame, n_max: int, margin: float, blocks: tuple[int, ...] | str) -> Grid:
    """Grid over train and targets; ``"auto"`` scales the block count with the data."""
    both = train.select(*AXES).unionByName(targets.select(*AXES))
    if blocks != "auto":
        return fit_grid(both, blocks)
    grid = fit_grid(both, (1, 1, 1))
    want = train.count() * (1 + 2 * margin) ** 3 / n_max
    extents = [hi - lo for lo, hi in grid.spans]
    solid = [e for e in extents if e > 0]
    if want <= 1 or not solid:
        return grid
    size = (math.prod(solid) / want) ** (1 / len(solid))
    return Grid(grid.spans, tuple(max(1, math.ceil(e / size)) if e > 0 else 1 for e in extents))


def neighbourhoods(points: DataFrame, grid: Grid, n_max: int, margin: float, seed: int) -> DataFrame:
    """Fast mode: points per block, own and within the margin; a keyed subsample where more than ``n_max``.

    Block counts give a hash threshold that leaves just over ``n_max`` rows of a full
    block, so the ranking below never gathers a hot block.
    """
    spread = spread_to_blocks(points, grid, margin).withColumn("_u", _point_hash(seed))
    sizes = spread.groupBy("block_id").agg(F.count(F.lit(1)).alias("_n"))
    full = sizes.filter(F.col("_n") > n_max).select(
        "block_id", (F.lit(n_max + 8 * math.sqrt(n_max) + 32) / F.col("_n")).alias("_share"))
    thinned = lookup_join(spread, full, ["block_id"], "left").filter("_share is null or _u < _share")
    rank = F.row_number().over(W.partitionBy("block_id").orderBy("_u", *AXES))
    return thinned.withColumn("_rank", rank).filter(F.col("_rank") <= n_max).drop("_u", "_share", "_rank")


def fit_cells(points: DataFrame, grid: Grid, n_max: int, margin: float, own_share: int = cells.OWN_SHARE) -> tuple[DataFrame, cells.Cells]:
    """``cells.fit_cells`` for systems of an allowed size."""
    if n_max > FAST_THRESHOLD:
        raise ValueError(f"one system may hold at most {FAST_THRESHOLD} points")
    return cells.fit_cells(points, grid, n_max, margin, own_share)


def _krige_cells(
    points: DataFrame, targets: DataFrame, grid: Grid, n_max: int, margin: float, score: Callable[[pa.Table, pa.Table], Scores],
    result: list[str], out: str, chunk_rows: int, edges: str = "half_open", fast: bool = False, seed: int = 42,
) -> DataFrame:
    """``result`` columns of the targets with ``score(points, targets)`` of their cell; without points the status is ``no_data``.

    The targets' columns stay as Arrow has them, so that no type changes on the way.
    """
    if fast:
        near, found = neighbourhoods(points, grid, n_max, margin, seed).withColumn("_cell", F.lit(0).cast("bigint")), None
    else:
        near, found = fit_cells(points, grid, n_max, margin)
        near = near.drop("_own")
    keys = ["block_id", "_cell"]
    placed = assign_blocks(targets, grid, edges).drop("bi", "bj", "bk")
    placed = staged(place_in_cells(placed, found), "placed") if found else placed.withColumn("_cell", F.lit(0).cast("bigint"))
    chunks = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk_rows)).cast("int").alias("_chunks"))
    # Only cells over one chunk need a lookup; the rest are chunk 0.
    many = chunks.filter("_chunks > 1")
    spot = F.pmod(F.xxhash64(*targets.columns), F.coalesce("_chunks", F.lit(1)))
    left = lookup_join(placed, many, keys, "left").withColumn("_chunk", spot).drop("_chunks")
    right = lookup_join(near, many, keys, "left").select(
        F.col("block_id").alias("_block"),
        F.col("_cell").alias("_near"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_chunks", F.lit(1)).cast("bigint") - 1)).alias("_part"),
        *points.columns,
    )

    schema = T.StructType([
        *[placed.schema[c] for c in result], T.StructField(out, T.DoubleType()), T.StructField(f"{out}_var", T.DoubleType()),
        T.StructField(f"{out}_status", T.StringType())])

    def solve(known: pa.Table, wanted: pa.Table) -> pa.Table:
        n = wanted.num_rows
        pred, var, status = score(known, wanted) if n and known.num_rows else _failed(n, "no_data")
        added = [pa.array(pred, pa.float64(), from_pandas=True), pa.array(var, pa.float64(), from_pandas=True), pa.array(status, pa.string())]
        kept = wanted.select(result)
        return pa.Table.from_arrays([*kept.columns, *added], names=[*result, out, f"{out}_var", f"{out}_status"])

    # In fast mode the points are no written table; counting them would thin them twice.
    rows = 0 if fast else near.count()
    ours, theirs = ["_block", "_near", "_part"], [*keys, "_chunk"]
    return cells.spread(right, ours, rows).groupBy(*ours).cogroup(cells.spread(left, theirs, rows).groupBy(*theirs)).applyInArrow(solve, schema)


def krige_blocks(
    train: DataFrame,
    targets: DataFrame,
    v: Variogram,
    blocks: tuple[int, ...] | str = DEFAULT_BLOCKS,
    n_max: int = FAST_ROWS,
    margin: float = 0.25,
    dims: int = 3,
    seed: int = 42,
    value: str = "grade",
    out: str = "kriging_pred",
    variance: bool = False,
    chunk_rows: int = TARGET_CHUNK,
    edges: str = "half_open",
    fast: bool = False,
) -> DataFrame:
    """Block-wise kriging: targets with ``block_id``, estimate, variance and status.

    Blocks with more points than a system holds are solved in cells; only
    ``fast`` thins them instead.  A block without points, or a cell whose system cannot be
    solved, keeps its targets with a NULL estimate and a status.  ``margin`` is in block
    widths, or cell widths in a split block.  With two dimensions blocks are columns over
    all depths.
    """
    if n_max > FAST_THRESHOLD:
        raise ValueError(f"one system may hold at most {FAST_THRESHOLD} points")
    points = staged(distinct_points(train, value, dims), "points")

    def solve(known: pa.Table, wanted: pa.Table) -> Scores:
        return _scores(_places(wanted), solve_kriging(_places(known), known.column("value").to_numpy().astype(float), v, dims, variance))

    if dims == 2:
        # Targets above one another have one estimate.
        places = staged(targets.select("x", "y").distinct().withColumn("depth", F.lit(0.0)), "places")
        grid = plan_grid(points, places, n_max, margin, blocks)
        result = ["x", "y", "block_id"]
        found = staged(_krige_cells(points, places, grid, n_max, margin, solve, result, out, chunk_rows, edges, fast, seed), "estimated")
        named = found.withColumnsRenamed({"x": "_x", "y": "_y"})
        met = lookup_join(targets.withColumns({"_x": F.col("x"), "_y": F.col("y")}), named, ["_x", "_y"], "left").drop("_x", "_y")
        return met.withColumn(f"{out}_status", F.coalesce(f"{out}_status", F.lit("no_data")))
    grid = plan_grid(points, targets, n_max, margin, blocks)
    result = [*targets.columns, "block_id"]
    return _krige_cells(points, targets, grid, n_max, margin, solve, result, out, chunk_rows, edges, fast, seed)


def regression_kriging(
    train: DataFrame, targets: DataFrame, v: Variogram, ml_pred: str = "ml_pred", value: str = "grade", out: str = "rk_pred", **options,
) -> DataFrame:
    """Krige the model's training residual and add it to the model's estimate."""
    residual = train.withColumn("_residual", F.col(value) - F.col(ml_pred))
    kriged = krige_blocks(residual, targets, v, value="_residual", out="residual_pred", **options)
    return kriged.withColumn(out, F.col(ml_pred) + F.col("residual_pred"))
