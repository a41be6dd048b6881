"""Variogram models, the experimental variogram and its fit."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefield.functions.joins import lookup_join
from lodefield.operators.cells import spread
from lodefield.sources.staging import staged

# Fixed value: the model names.
MODELS = ("spherical", "exponential", "gaussian")


@dataclass(frozen=True)
class Variogram:
    model: str
    range: float
    sill: float
    nugget: float

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"unknown model {self.model!r}")
        if self.range <= 0 or not 0 <= self.nugget <= self.sill:
            raise ValueError("need range > 0 and 0 <= nugget <= sill")

    def gamma(self, h: np.ndarray) -> np.ndarray:
        """Semivariance at distances ``h``; zero at distance zero."""
        apart = h > 0
        t = h / self.range
        if self.model == "spherical":
            np.minimum(t, 1.0, out=t)
            t *= 1.5 - 0.5 * t * t
        else:
            if self.model == "gaussian":
                t *= t
            t *= -3.0 if self.model == "exponential" else -(1.75**2)
            np.negative(np.expm1(t, out=t), out=t)
        t *= self.sill - self.nugget
        t += self.nugget
        t *= apart
        return t


def gamma_column(h: Column, v: Variogram) -> Column:
    """The same semivariance as a column expression."""
    t = h / F.lit(v.range)
    if v.model == "spherical":
        shape = F.when(t <= 1.0, 1.5 * t - 0.5 * t * t * t).otherwise(F.lit(1.0))
    elif v.model == "exponential":
        shape = 1.0 - F.exp(-3.0 * t)
    else:
        shape = 1.0 - F.exp(-(1.75 * t) * (1.75 * t))
    return F.when(h > 0, F.lit(v.nugget) + F.lit(v.sill - v.nugget) * shape).otherwise(F.lit(0.0))


# Node pairs held at once, and those that one group compares at most (about).
_MEET_CELLS = 1_000_000
_GROUP_PAIRS = 20_000_000
# Node pairs that count as one row when groups are dealt to tasks.
_PAIRS_PER_ROW = 400
# Halvings of the cells before straddling nodes are taken apart into locations.
_HALVINGS = 4
#: Locations a column (one x and y) at which columns meet by running sums, and the most locations of a group of columns.
_COLUMN_ROWS = 8
_BOX_ROWS = 4_000_000
# Parts of a lag whose distances count as equal in the mean distance of columns.
_PER_LAG = 4
_AXES = ("x", "y", "depth")
_SUMS = ("p", "hp", "h2p", "sq")


def _nodes(rows: DataFrame, keys: list[Column], z: Column) -> DataFrame:
    """Per node: count, sum and sum of squares of the value, mean place, spread, and the middle and half diagonal of its box."""
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("q"),
        *[F.avg(a).alias(f"m_{a}") for a in _AXES], sum((F.var_pop(a) for a in _AXES), F.lit(0.0)).alias("v"),
        *[((F.min(a) + F.max(a)) / 2).alias(f"c_{a}") for a in _AXES],
        (F.sqrt(sum(((F.max(a) - F.min(a)) * (F.max(a) - F.min(a)) for a in _AXES), F.lit(0.0))) / 2).alias("r"))
    # The mean of equal numbers need not be that number.
    return grouped.withColumns({f"m_{a}": F.when(F.col("r") == 0, F.col(f"c_{a}")).otherwise(F.col(f"m_{a}")) for a in _AXES})


def _edge_lags(d, r, lag: float):
    """Least and greatest lag of the pairs of nodes at distance ``d`` with half diagonals that add up to ``r``; for arrays."""
    slack = np.where(r > 0, r + 1e-9 * (1 + d), 0.0)
    return np.floor(np.maximum(d - slack, 0.0) / lag), np.floor((d + slack) / lag)


def _meetings(nodes: DataFrame, cell: tuple[float, float, float], lag: float, n_lags: int) -> DataFrame:
    """Sums of the node pairs that lie within one lag (``lag, p, hp, h2p, sq``), and the keys ``a, b`` of those across a lag's edge."""
    reach = float(lag * n_lags)
    # Nodes so many cells apart are beyond the last lag.
    span = [math.floor(reach / c) + 1 for c in cell]
    ahead = [o for o in itertools.product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(v).alias(k) for v, k in zip(o, ("oi", "oj", "ok"))]) for o in ahead])
    box = ["bi", "bj", "bk"]
    boxes = nodes.withColumn("o", F.explode(offsets)).select(
        *[(F.floor(F.col(k) / F.lit(s)) - F.col(f"o.o{k}")).cast("bigint").alias(f"b{k}") for k, s in zip("ijk", span)],
        F.expr("o.oi = 0 and o.oj = 0 and o.ok = 0").alias("home"), *nodes.columns)
    # The own nodes of a full box are dealt to several groups, each of which meets all nodes of the box and those next to it.
    sizes = boxes.groupBy(*box).agg(F.count_if("home").alias("own"), F.count(F.lit(1)).alias("all"))
    full = staged(sizes.withColumn("parts", F.ceil(F.col("own") * F.col("all") / F.lit(_GROUP_PAIRS)).cast("int")).filter("parts > 1").drop("own", "all"), "lag-parts")
    dealt = lookup_join(boxes, full, box, "left", small_rows=full.count()).withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("i", "j", "k"), F.col("parts")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("asks", F.col("home") & (F.col("mine") == F.col("part")))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        total, across = np.zeros((4, n_lags)), []
        # The nodes that ask come first, then the box's others, then those next to it.
        rows = rows.sort_values(["asks", "home", "i", "j", "k"], ascending=[False, False, True, True, True], kind="stable")
        keys = rows[["i", "j", "k"]].to_numpy(np.int64)
        n, s, q, v, r = (rows[c].to_numpy(float) for c in ("n", "s", "q", "v", "r"))
        mean, middle = (rows[[f"{p}_{a}" for a in _AXES]].to_numpy(float) for p in ("m", "c"))
        home = rows["home"].to_numpy(bool)
        # Two nodes of the box meet where the one with the smaller key asks, whichever group has it.
        order = np.empty(len(rows), np.int64)
        order[np.lexsort(keys.T[::-1])] = np.arange(len(rows))
        asking = int(rows["asks"].sum())

        def add(a: np.ndarray, b: np.ndarray, lags: np.ndarray, same: np.ndarray) -> None:
            h2 = ((mean[a] - mean[b]) ** 2).sum(axis=1) + v[a] + v[b]
            pairs = np.where(same, n[a] * (n[a] - 1) / 2, n[a] * n[b])
            h2 = np.where(same, h2 * n[a] / np.maximum(n[a] - 1, 1), h2)
            squares = np.where(same, n[a] * q[a] - s[a] ** 2, n[b] * q[a] + n[a] * q[b] - 2 * s[a] * s[b])
            for row, weight in enumerate((pairs, pairs * np.sqrt(h2), pairs * h2, squares)):
                total[row] += np.bincount(lags, weight, n_lags)

        size = max(1, _MEET_CELLS // max(len(rows), 1))
        for lo in range(0, asking, size):
            a = np.arange(lo, min(asking, lo + size))[:, None]
            b = np.arange(len(rows))[None, :]
            d = (middle[a, 0] - middle[b, 0]) ** 2
            for axis in (1, 2):
                d = d + (middle[a, axis] - middle[b, axis]) ** 2
            d = np.sqrt(d)
            wide = np.where(r[a] + r[b] > 0, r[a] + r[b] + 1e-9 * (1 + d), 0.0)
            wanted = (d - wide < reach) & (~home[b] | (order[b] >= order[a]))
            wanted &= (a != b) | (n[a] > 1)
            ia, ib = np.nonzero(wanted)
            d, one, two = d[ia, ib], a[ia, 0], b[0, ib]
            same = one == two
            first, last = _edge_lags(d, np.where(same, 2 * r[one], r[one] + r[two]), lag)
            within = first == last
            inside = within & (first < n_lags)
            add(one[inside], two[inside], first[inside].astype(int), same[inside])
            if not within.all():
                across.append(np.column_stack((keys[one[~within]], keys[two[~within]])))
        sums = pd.DataFrame({"lag": np.arange(n_lags), **dict(zip(_SUMS, total))})
        sums = sums[sums.p > 0].assign(ai=None, aj=None, ak=None, bi=None, bj=None, bk=None)
        split = np.concatenate(across) if across else np.empty((0, 6), np.int64)
        rest = pd.DataFrame(split, columns=["ai", "aj", "ak", "bi", "bj", "bk"]).assign(lag=-1, **dict.fromkeys(_SUMS, 0.0))
        return pd.concat([sums, rest[sums.columns]]) if len(rest) and len(sums) else rest[sums.columns] if len(rest) else sums

    schema = "lag int, p double, hp double, h2p double, sq double, ai bigint, aj bigint, ak bigint, bi bigint, bj bigint, bk bigint"
    meeting = sizes.agg(F.sum(F.col("own") * F.col("all"))).first()[0] or 0
    return spread(dealt, [*box, "part"], meeting // _PAIRS_PER_ROW).groupBy(*box, "part").applyInPandas(meet, schema)


def _refined(pairs: DataFrame, parts: DataFrame, lag: float, n_lags: int) -> DataFrame:
    """Pairs of the parts of straddling nodes: their sums and their least and greatest lag (``first``, ``last``)."""
    def side(name: str) -> DataFrame:
        return parts.select(F.col("up").alias(name), F.struct(*[F.col(c) for c in parts.columns if c != "up"]).alias(f"{name}_part"))

    met = spread(pairs, ["a"], pairs.count()).join(side("a"), "a").join(side("b"), "b").filter("a <> b or a_part.key <= b_part.key")
    a, b = (lambda c: F.col(f"a_part.{c}")), (lambda c: F.col(f"b_part.{c}"))
    same = (F.col("a") == F.col("b")) & (a("key") == b("key"))

    def squared(p: str) -> Column:
        gaps = [a(f"{p}_{x}") - b(f"{p}_{x}") for x in _AXES]
        return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]

    d, r = F.sqrt(squared("c")), F.when(same, 2 * a("r")).otherwise(a("r") + b("r"))
    slack = F.when(r > 0, r + 1e-9 * (1 + d)).otherwise(0.0)
    h2 = squared("m") + a("v") + b("v")
    pairs_of = F.when(same, a("n") * (a("n") - 1) / 2).otherwise(a("n") * b("n"))
    h2 = F.when(same, h2 * a("n") / F.greatest(a("n") - 1, F.lit(1.0))).otherwise(h2)
    squares = F.when(same, a("n") * a("q") - a("s") * a("s")).otherwise(b("n") * a("q") + a("n") * b("q") - 2 * a("s") * b("s"))
    found = met.select(
        F.floor(F.greatest(d - slack, F.lit(0.0)) / lag).cast("int").alias("first"), F.floor((d + slack) / lag).cast("int").alias("last"),
        pairs_of.alias("p"), (pairs_of * F.sqrt(h2)).alias("hp"), (pairs_of * h2).alias("h2p"), squares.alias("sq"),
        a("key").alias("a"), b("key").alias("b"))
    return found.filter((F.col("first") < n_lags) & (F.col("p") > 0))


def _column_meetings(places: DataFrame, lag: float, n_lags: int, parts: int = 1) -> DataFrame:
    """Sums by lag (``lag, p, hp, h2p, sq``) of all pairs of locations, which lie in columns of one x and y.

    The partners of a location in another column that are within a distance are a run of that column's depths, so
    running sums along the column give the sums of all its pairs; a pair of columns costs its depths, not their pairs.
    A column meets those of its box, as wide as the last lag, and of the boxes next to it.
    """
    reach = float(lag * n_lags)
    ahead = F.array(*[F.struct(F.lit(i).alias("oi"), F.lit(j).alias("oj")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    boxes = places.withColumn("o", F.explode(ahead)).select(
        *[(F.floor(F.col(a) / F.lit(reach)) - F.col(f"o.o{k}")).cast("bigint").alias(f"b{k}") for a, k in (("x", "i"), ("y", "j"))],
        F.expr("o.oi = 0 and o.oj = 0").alias("home"), *places.columns)
    dealt = boxes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn(
        "asks", F.col("home") & (F.pmod(F.xxhash64("x", "y"), F.lit(parts)) == F.col("part")))
    edges = np.arange(n_lags * _PER_LAG + 1) * (lag / _PER_LAG)

    def runs(za: np.ndarray, zb: np.ndarray, flat: float, first: np.ndarray | None) -> np.ndarray:
        """Where the depths at or above ``za`` begin to be as far as each edge; depths as near as an edge of a lag are tested one by one."""
        wide = np.sqrt(np.maximum(edges * edges - flat, 0.0))
        slack = 1e-9 * (1 + wide + np.abs(za).max())
        at = np.searchsorted(zb, za[None, :] + wide[:, None])
        start = np.searchsorted(zb, za) if first is None else first
        for k in range(_PER_LAG, len(edges), _PER_LAG):
            if edges[k] * edges[k] <= flat * (1 - 1e-12):
                continue
            at[k] = np.searchsorted(zb, za + wide[k] - slack[k])
            stop = np.searchsorted(zb, za + wide[k] + slack[k])
            open_ = np.flatnonzero(at[k] < stop)
            while len(open_):
                gap = za[open_] - zb[at[k, open_]]
                open_ = open_[np.floor(np.sqrt(flat + gap * gap) / lag) < k // _PER_LAG]
                at[k, open_] += 1
                open_ = open_[at[k, open_] < stop[open_]]
        at[edges * edges <= flat * (1 - 1e-12)] = 0
        return np.maximum.accumulate(np.maximum(at, start[None, :]), axis=0)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((4, n_lags))
        rows = rows.sort_values(["x", "y", "depth"], ignore_index=True)
        xy, z, n, s, q = rows[["x", "y"]].to_numpy(float), *(rows[c].to_numpy(float) for c in ("depth", "n", "s", "q"))
        starts = np.flatnonzero(np.r_[True, (xy[1:] != xy[:-1]).any(axis=1)]) if len(rows) else np.empty(0, np.int64)
        columns = [slice(a, b) for a, b in zip(starts, np.r_[starts[1:], len(rows)])]
        place, home, asks = xy[starts], rows["home"].to_numpy(bool)[starts], rows["asks"].to_numpy(bool)[starts]
        middle = (z.min() + z.max()) / 2
        sums = [np.column_stack([np.r_[0.0, np.cumsum(v)] for v in (n[c], s[c], q[c], n[c] * (z[c] - middle), n[c] * (z[c] - middle) ** 2)]) for c in columns]

        def add(a: slice, flat: float, at: np.ndarray, upto: np.ndarray) -> None:
            run = np.diff(upto[at], axis=0)
            size, s_b, q_b, z1, z2 = (run[:, :, i] for i in range(5))
            up, pairs = z[a] - middle, n[a] * size
            h2 = np.maximum(n[a] * (flat * size + up * up * size - 2 * up * z1 + z2), 0.0)
            for row, weight in enumerate((pairs, np.sqrt(pairs * h2), h2, size * q[a] + n[a] * q_b - 2 * s[a] * s_b)):
                total[row] += weight.sum(axis=1).reshape(n_lags, _PER_LAG).sum(axis=1)

        for i in np.flatnonzero(asks):
            a = columns[i]
            total[0, 0] += (n[a] * (n[a] - 1) / 2).sum()
            total[3, 0] += (n[a] * q[a] - s[a] ** 2)[n[a] > 1].sum()
            add(a, 0.0, runs(z[a], z[a], 0.0, np.arange(1, a.stop - a.start + 1)), sums[i])
            gap = place[i] - place
            flat = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1]
            # Of two columns of the box the one that comes first asks.
            for j in np.flatnonzero((flat < reach * reach) & (~home | (np.arange(len(place)) > i))):
                up, back = z[columns[j]], -z[columns[j]][::-1]
                above = runs(z[a], up, flat[j], None)
                add(a, flat[j], above, sums[j])
                # Depths below, from the column turned over; an equal depth has been counted above.
                under = runs(-z[a], back, flat[j], np.searchsorted(back, -z[a], side="right"))
                add(a, flat[j], len(up) - under, -sums[j])
        return pd.DataFrame({"lag": np.arange(n_lags), **dict(zip(_SUMS, total))})

    meeting = places.count() * len(edges)
    return spread(dealt, ["bi", "bj", "part"], meeting // _PAIRS_PER_ROW).groupBy("bi", "bj", "part").applyInPandas(
        meet, "lag int, p double, hp double, h2p double, sq double")


def _column_parts(places: DataFrame, reach: float) -> int:
    """Groups that share a box's columns, for locations that lie in long columns; 0 for others."""
    columns = places.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    # Locations in a box and those next to it, at most: nine times the fullest box.
    boxes = columns.groupBy(F.floor(F.col("x") / reach).alias("i"), F.floor(F.col("y") / reach).alias("j")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("columns"))
    most = boxes.agg(F.sum("rows").alias("rows"), F.sum("columns").alias("columns"), F.max("rows").alias("full"), F.max("columns").alias("wide")).first()
    if not most.rows or most.rows < _COLUMN_ROWS * most.columns or 9 * most.full > _BOX_ROWS:
        return 0
    return min(32, math.ceil(9 * most.full * most.wide / _GROUP_PAIRS))


def lag_table(
    df: DataFrame, lag: float, n_lags: int, cell: tuple[float, float, float], value: str = "grade",
) -> DataFrame:
    """Experimental variogram ``lag, h, pairs, gamma, h_rms`` over all point pairs within the last lag.

    Points are first reduced to nodes of a grid of ``cell`` size.  Two nodes whose boxes leave their
    pairs only one lag are added by their sums: the squared differences and squared distances of all their
    pairs follow from these.  Nodes across a lag's edge are taken apart into nodes of half the size, and
    after some halvings into locations, so ``pairs``, ``gamma`` and ``h_rms`` (root mean square distance)
    are those of all pairs of points for any cell; ``h`` takes a node pair's distances as equal.  Nodes meet in boxes as wide
    as the last lag and the boxes next to them; a full box is dealt to several groups.

    Locations that lie in long columns (vertical holes) are not reduced: whole columns meet, by running sums along their depths.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*_AXES, F.col(value).alias("_z"))
    # Centring keeps n*sum(z^2) from cancelling against the squared sum.
    mean = rows.agg(F.avg("_z")).first()[0] or 0.0
    z = F.col("_z") - F.lit(mean)
    places = staged(rows.groupBy(*_AXES).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("q")), "lag-places")
    parts = _column_parts(places, float(lag * n_lags))
    if parts:
        return _lag_means(_column_meetings(places, lag, n_lags, parts))

    def keys(halvings: int) -> list[Column]:
        return [F.floor(F.col(a) / F.lit(float(c) / 2**halvings)).cast("bigint").alias(k) for a, c, k in zip(_AXES, cell, "ijk")]

    met = staged(_meetings(_nodes(rows, keys(0), z), cell, lag, n_lags), "lag-pairs")
    sums = [met.filter("lag >= 0").select("lag", *_SUMS)]
    key = F.struct("i", "j", "k")
    pairs = met.filter("lag < 0").select(F.struct(*[F.col(f"a{k}").alias(k) for k in "ijk"]).alias("a"), F.struct(*[F.col(f"b{k}").alias(k) for k in "ijk"]).alias("b"))
    for level in range(1, _HALVINGS + 2):
        if pairs.isEmpty():
            break
        if level <= _HALVINGS:
            parts = _nodes(rows, keys(level), z)
            up = F.struct(*[F.floor(F.col(k) / 2).cast("bigint").alias(k) for k in "ijk"])
        else:
            # Locations, which have no extent: no pair of them straddles an edge.
            parts = _nodes(rows, [F.col(a).alias(k) for a, k in zip(_AXES, "ijk")], z)
            up = F.struct(*[F.floor(F.col(k) / F.lit(float(c) / 2**_HALVINGS)).cast("bigint").alias(k) for k, c in zip("ijk", cell)])
        parts = parts.select(up.alias("up"), key.alias("key"), *[c for c in parts.columns if c not in "ijk"])
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("up")).distinct()
        found = staged(_refined(pairs, parts.join(wanted, "up", "left_semi"), lag, n_lags), "lag-refined")
        sums.append(found.filter("first = last").select(F.col("first").alias("lag"), *_SUMS))
        pairs = found.filter("first < last").select("a", "b")
    whole = sums[0]
    for more in sums[1:]:
        whole = whole.unionByName(more)
    return _lag_means(whole)


def _lag_means(whole: DataFrame) -> DataFrame:
    total = whole.groupBy("lag").agg(*[F.sum(c).alias(c) for c in _SUMS]).filter("p > 0")
    return total.select(
        "lag", (F.col("hp") / F.col("p")).alias("h"), F.col("p").cast("bigint").alias("pairs"), (F.col("sq") / (2 * F.col("p"))).alias("gamma"),
        F.sqrt(F.col("h2p") / F.col("p")).alias("h_rms"))


def fit_variogram(lags: DataFrame, models: tuple[str, ...] = MODELS) -> tuple[Variogram, float]:
    """Weighted least squares on the (small) lag table; returns the fit and its error.

    For a given model and range the two remaining parameters are linear; the range
    is searched on a log grid and then refined around the best.
    """
    rows = lags.filter("h > 0").orderBy("h").toPandas()
    if rows.empty:
        raise ValueError("no lags to fit")
    h, g, w = (rows[c].to_numpy(float) for c in ("h", "gamma", "pairs"))
    w = w / w.sum()
    best = None
    for model in models:
        lo, hi = h[0] / 2, 4 * h[-1]
        for _ in range(3):
            grid = np.geomspace(lo, hi, 60)
            scored = [(*_linear_part(model, r, h, g, w), r) for r in grid]
            err, nugget, part, r = min(scored)
            at = grid.tolist().index(r)
            lo, hi = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
        if best is None or err < best[1]:
            best = (Variogram(model, float(r), float(nugget + part), float(nugget)), float(err))
    return best


def _linear_part(model: str, r: float, h, g, w) -> tuple[float, float, float]:
    """Best non-negative nugget and partial sill for one model and range."""
    shape = Variogram(model, r, 1.0, 0.0).gamma(h)
    options = []
    design = np.column_stack([np.ones_like(shape), shape])
    root = np.sqrt(w)
    both, *_ = np.linalg.lstsq(design * root[:, None], g * root, rcond=None)
    options.append(tuple(both))
    options.append((0.0, float((w * shape * g).sum() / (w * shape * shape).sum())))
    options.append((float((w * g).sum()), 0.0))
    errors = [(float((w * (a + b * shape - g) ** 2).sum()), a, b) for a, b in options if a >= 0 and b >= 0]
    return min(errors)
