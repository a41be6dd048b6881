"""Cells for systems of bounded size: the points of blocks, cut by k-d trees.

A block is cut in two passes over the points, at any size.  Blocks with many points are first cut into shards by
a tree that the driver grows from a bounded sample; all copies are dealt to shards in one pass, and their exact counts are taken.
Should a shard have far more points than the sample promised, it alone is sampled and cut again.  Then every shard
is cut at exact medians in a task of its own, down to its cells.

The driver holds the sample and the shards' cuts; a task holds one shard with the points around it.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefield.functions.joins import lookup_join
from lodefield.operators.blocks import AXES, Grid, _cells, assign_blocks, block_id
from lodefield.sources.staging import staged

#: Own points of a shard aimed at (more if there would be over ``SAMPLE / _PER_SHARD`` shards) and the most that a task takes.
SHARD = 50_000
LARGEST_SHARD = 4_000_000
#: Points that the driver samples at once, and those wanted of a shard.
SAMPLE = 200_000
_PER_SHARD = 50
#: A cell whose own and margin points exceed a system is cut until its own points are this share of one.
OWN_SHARE = 4
_CELL_BITS = 24
_ROWS_PER_TASK = 50_000
#: Bytes of cuts that are broadcast to the targets.
_BROADCAST_BYTES = 32 << 20
_NAMES = ("bi", "bj", "bk")


@dataclass
class Cuts:
    """A binary tree of cuts: node ``i`` sends points with ``x[axis] >= cut`` to ``beyond[i]``, others to ``below[i]``; a leaf has axis -1."""

    axis: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    below: list[int] = field(default_factory=lambda: [0])
    beyond: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, axis: int, cut: float) -> tuple[int, int]:
        first = len(self.axis)
        self.axis[node], self.cut[node], self.below[node], self.beyond[node] = axis, cut, first, first + 1
        for name, blank in (("axis", -1), ("cut", 0.0), ("below", 0), ("beyond", 0)):
            getattr(self, name).extend((blank, blank))
        return first, first + 1

    @property
    def trivial(self) -> bool:
        return len(self.axis) == 1

    def leaf_of(self, xyz: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        axis, cut, below, beyond = (np.array(c) for c in (self.axis, self.cut, self.below, self.beyond))
        at = np.zeros(len(xyz), np.int64)
        rows = np.arange(len(xyz)) if axis[0] >= 0 else np.empty(0, np.int64)
        while len(rows):
            node = at[rows]
            at[rows] = np.where(xyz[rows, axis[node]] >= cut[node], beyond[node], below[node])
            rows = rows[axis[at[rows]] >= 0]
        return at

    def boxes(self, lo: np.ndarray, hi: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Box of every node within the box of the root."""
        out = {0: (lo, hi)}
        for node, axis in enumerate(self.axis):
            if axis >= 0:
                lo, hi = out[node]
                out[self.below[node]], out[self.beyond[node]] = _halves(lo, hi, axis, self.cut[node])
        return out

    def reached(self, xyz: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, margin: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf: the rows that it owns or that lie within its margin, and which of them it owns."""
        boxes, found, todo = self.boxes(lo, hi), [], [(0, np.arange(len(xyz)), own)]
        while todo:
            node, rows, mine = todo.pop()
            axis = self.axis[node]
            if not len(rows):
                continue
            if axis < 0:
                found.append((node, rows, mine))
                continue
            beyond = xyz[rows, axis] >= self.cut[node]
            for child, side in ((self.below[node], ~beyond), (self.beyond[node], beyond)):
                owned = mine & side
                kept = owned | _near(xyz[rows], *boxes[child], margin)
                todo.append((child, rows[kept], owned[kept]))
        return found


def _halves(lo: np.ndarray, hi: np.ndarray, axis: int, cut: float):
    top, bottom = hi.copy(), lo.copy()
    top[axis] = bottom[axis] = cut
    return (lo, top), (bottom, hi)


def _outside(xyz: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(lo - xyz, xyz - hi), 0.0)


def _near(xyz: np.ndarray, lo: np.ndarray, hi: np.ndarray, margin: float) -> np.ndarray:
    return (_outside(xyz, lo, hi) <= margin * (hi - lo)).all(axis=1)


def _median(xyz: np.ndarray) -> tuple[int, float] | None:
    """Longest axis and a cut on it with points on both sides; None for a single place."""
    if not len(xyz):
        return None
    low, high = xyz.min(axis=0), xyz.max(axis=0)
    axis = int(np.argmax(high - low))
    if not high[axis] > low[axis]:
        return None
    x = xyz[:, axis]
    middle = float(np.partition(x, len(x) // 2)[len(x) // 2])
    return axis, middle if middle > low[axis] else float(x[x > low[axis]].min())


def grow(
    xyz: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_max: int, margin: float, own_share: int = OWN_SHARE,
) -> tuple[Cuts, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Cuts of a box and, for each leaf, its rows and which of them it owns.

    A leaf has at most ``n_max`` rows: its own and, of those within the margin, as many of the nearest as fit.
    """
    cuts, found, todo = Cuts(), [], [(0, np.arange(len(xyz)), own, lo, hi)]
    while todo:
        node, rows, mine, lo, hi = todo.pop()
        if len(rows) > n_max and mine.sum() > max(1, n_max // own_share) and (where := _median(xyz[rows[mine]])):
            beyond = xyz[rows, where[0]] >= where[1]
            sides = zip(cuts.split(node, *where), (~beyond, beyond), _halves(lo, hi, *where))
            for child, side, box in sides:
                owned = mine & side
                kept = owned | _near(xyz[rows], *box, margin)
                todo.append((child, rows[kept], owned[kept], *box))
            continue
        room = n_max - int(mine.sum())
        if len(rows) - int(mine.sum()) > room:
            others = rows[~mine]
            gap = _outside(xyz[others], lo, hi)
            off = np.divide(gap, hi - lo, out=np.zeros_like(gap), where=hi > lo).max(axis=1)
            order = np.lexsort((*xyz[others].T[::-1], off))
            rows = np.concatenate((rows[mine], others[order[:room]]))
            mine = np.arange(len(rows)) < mine.sum()
        found.append((node, rows, mine))
    return cuts, found


def _shard_cuts(sample: np.ndarray, most: float) -> Cuts:
    """Cuts of sampled points into leaves of at most ``most`` of them."""
    cuts, todo = Cuts(), [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        where = _median(sample[rows]) if len(rows) > most else None
        if where:
            beyond = sample[rows, where[0]] >= where[1]
            todo += zip(cuts.split(node, *where), (rows[~beyond], rows[beyond]))
    return cuts


def _graft(cuts: Cuts, leaf: int, more: Cuts) -> None:
    """Put ``more`` in the place of a leaf of ``cuts``."""
    todo = [(leaf, 0)]
    while todo:
        here, there = todo.pop()
        if more.axis[there] >= 0:
            below, beyond = cuts.split(here, more.axis[there], more.cut[there])
            todo += [(below, more.below[there]), (beyond, more.beyond[there])]


@dataclass
class Cells:
    """How blocks are cut: into shards (``shards``, by block) and further into cells (``planes``: ``block_id, _shard, _planes``)."""

    grid: Grid
    shards: dict[int, Cuts]
    planes: DataFrame


def _box(grid: Grid, block: int) -> tuple[np.ndarray, np.ndarray]:
    bk, rest = block % grid.counts[2], block // grid.counts[2]
    at = np.array([rest // grid.counts[1], rest % grid.counts[1], bk], float)
    low, width = np.array([s[0] for s in grid.spans], float), np.array([grid.width(i) for i in range(3)], float)
    return low + at * width, low + (at + 1) * width


def _with_shards(copies: DataFrame, grid: Grid, shards: dict[int, Cuts], margin: float) -> DataFrame:
    """Add ``_shard``; a row goes to the shard that owns it and to those in whose margin it lies."""
    if not shards:
        return copies.withColumn("_shard", F.lit(0))

    @F.pandas_udf("array<struct<shard:int,own:boolean>>")
    def dealt(block: pd.Series, own: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        xyz, mine = np.column_stack((x, y, z)).astype(float), own.to_numpy(bool)
        out: list[list] = [[] for _ in range(len(xyz))]
        for b, rows in pd.Series(range(len(xyz))).groupby(block.to_numpy()).indices.items():
            if b not in shards:
                for r in rows:
                    out[r].append((0, bool(mine[r])))
                continue
            for leaf, at, owned in shards[b].reached(xyz[rows], mine[rows], *_box(grid, int(b)), margin):
                for r, o in zip(rows[at], owned):
                    out[r].append((leaf, bool(o)))
        return pd.Series(out)

    spread = copies.withColumn("_at", F.explode(dealt("block_id", "_own", *AXES)))
    return spread.withColumn("_shard", F.col("_at.shard")).withColumn("_own", F.col("_at.own")).drop("_at")


def _sampled(rows: DataFrame, keys: list[str], total: int) -> pd.DataFrame:
    """At most about ``SAMPLE`` of ``total`` points, by the hash of their places."""
    top = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(3), *AXES), F.lit(top))
    return rows.filter(draw < int(top * min(1.0, SAMPLE / max(total, 1)))).select(*keys, *AXES).toPandas()


def _plan_shards(points: DataFrame, grid: Grid) -> dict[int, Cuts]:
    """Cuts of the blocks that have more points than a shard is to have."""
    spark = points.sparkSession
    home = assign_blocks(points.select(*AXES), grid).select("block_id", *AXES)
    total = points.count()
    size = max(SHARD, math.ceil(total * _PER_SHARD / SAMPLE))
    if total <= 1.5 * size:
        return {}
    # At most total / size rows, and so at most SAMPLE / _PER_SHARD.
    large = {r.block_id: r.n for r in home.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1.5 * size).collect()}
    if not large:
        return {}
    inside = home.join(F.broadcast(spark.createDataFrame([(b,) for b in large], home.select("block_id").schema)), "block_id")
    drawn = _sampled(inside, ["block_id"], sum(large.values()))
    share = len(drawn) / sum(large.values())
    shards = {int(b): _shard_cuts(rows[list(AXES)].to_numpy(float), max(1.0, size * share)) for b, rows in drawn.groupby("block_id")}
    while True:
        owned = _with_shards(inside.withColumn("_own", F.lit(True)), grid, shards, -1.0).filter("_own")
        counts = owned.groupBy("block_id", "_shard").agg(F.count(F.lit(1)).alias("n"))
        over = {(r.block_id, r._shard): r.n for r in counts.filter(F.col("n") > LARGEST_SHARD).collect()}
        if not over:
            return shards
        keys = spark.createDataFrame(list(over), T.StructType([owned.schema["block_id"], owned.schema["_shard"]]))
        drawn = _sampled(owned.join(F.broadcast(keys), ["block_id", "_shard"]), ["block_id", "_shard"], sum(over.values()))
        share = len(drawn) / sum(over.values())
        for (block, shard), rows in drawn.groupby(["block_id", "_shard"]):
            more = _shard_cuts(rows[list(AXES)].to_numpy(float), max(1.0, min(LARGEST_SHARD / 2, max(size, over[block, shard] / 8)) * share))
            if more.trivial:
                raise RuntimeError("a shard cannot be cut: its points share a place")
            _graft(shards.setdefault(int(block), Cuts()), int(shard), more)


def fit_cells(points: DataFrame, grid: Grid, n_max: int, margin: float, own_share: int = OWN_SHARE) -> tuple[DataFrame, Cells]:
    """Points per cell (``block_id, _cell``, the columns of ``points``, ``_own``), at most ``n_max`` of each, and how to find a place's cell.

    ``points`` has one row per location and should be a staged table: it is read three times at most, and once more for each time
    that overfull shards are cut again.  A location is own in exactly one cell.  A cell is a block, or a part of one with up to
    ``n_max / own_share`` own points; its other points are the nearest of those within ``margin`` of its widths.
    """
    shards = _plan_shards(points, grid)
    home = assign_blocks(points, grid).drop("block_id").withColumnsRenamed({n: f"_{n}" for n in _NAMES})
    for i, n in enumerate(_NAMES):
        home = home.withColumn(n, F.explode(F.array_distinct(F.concat(_cells(i, grid, margin), F.array(f"_{n}")))))
    copies = home.select(
        block_id(grid).alias("block_id"), *points.columns, F.expr(" and ".join(f"{n} = _{n}" for n in _NAMES)).alias("_own"))
    dealt = _with_shards(copies, grid, shards, margin)
    columns = points.columns

    def cut(table: pa.Table) -> pa.Table:
        block, shard = table.column("block_id")[0].as_py(), table.column("_shard")[0].as_py()
        xyz = np.column_stack([table.column(a).to_numpy().astype(float) for a in AXES])
        own = table.column("_own").to_numpy(zero_copy_only=False).astype(bool)
        lo, hi = _box(grid, block)
        if block in shards:
            lo, hi = shards[block].boxes(lo, hi)[shard]
        cuts, leaves = grow(xyz, own, lo, hi, n_max, margin, own_share)
        at = np.concatenate([rows for _, rows, _ in leaves])
        taken = table.select(columns).take(pa.array(at))
        cell = np.concatenate([np.full(len(rows), (shard << _CELL_BITS) + leaf, np.int64) for leaf, rows, _ in leaves])
        mine = np.concatenate([mine for _, _, mine in leaves])
        n = len(at)
        planes = pa.array([None if cuts.trivial else pickle.dumps((cuts.axis, cuts.cut, cuts.below, cuts.beyond)), *[None] * (n - 1)], pa.binary())
        return pa.Table.from_arrays(
            [pa.array(np.full(n, block), table.column("block_id").type), pa.array(np.full(n, shard), pa.int32()), pa.array(cell),
             *taken.columns, pa.array(mine), planes], schema=pa.schema([
                 ("block_id", table.column("block_id").type), ("_shard", pa.int32()), ("_cell", pa.int64()),
                 *[taken.schema.field(c) for c in columns], ("_own", pa.bool_()), ("_planes", pa.binary())]))

    schema = T.StructType([
        copies.schema["block_id"], T.StructField("_shard", T.IntegerType()), T.StructField("_cell", T.LongType()),
        *[points.schema[c] for c in columns], T.StructField("_own", T.BooleanType()), T.StructField("_planes", T.BinaryType())])
    near = staged(dealt.groupBy("block_id", "_shard").applyInArrow(cut, schema), "near")
    planes = near.filter("_planes is not null").select("block_id", "_shard", "_planes")
    return near.drop("_shard", "_planes"), Cells(grid, shards, planes)


def place_in_cells(placed: DataFrame, cells: Cells) -> DataFrame:
    """Add ``_cell`` to rows with a ``block_id``."""
    shards = cells.shards

    @F.pandas_udf("int")
    def shard_of(block: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        xyz, out = np.column_stack((x, y, z)).astype(float), np.zeros(len(block), np.int32)
        for b, rows in pd.Series(range(len(xyz))).groupby(block.to_numpy()).indices.items():
            if b in shards:
                out[rows] = shards[b].leaf_of(xyz[rows])
        return pd.Series(out)

    @F.pandas_udf("int")
    def leaf_of(planes: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        xyz, out = np.column_stack((x, y, z)).astype(float), np.zeros(len(planes), np.int32)
        codes, kinds = pd.factorize(planes)
        for code, kind in enumerate(kinds):
            rows = np.flatnonzero(codes == code)
            out[rows] = Cuts(*pickle.loads(kind)).leaf_of(xyz[rows])
        return pd.Series(out)

    shard = shard_of("block_id", *AXES) if shards else F.lit(0)
    size = cells.planes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_planes")), F.lit(0))).first()
    out = placed.withColumn("_shard", shard)
    if not size[0]:
        return out.withColumn("_cell", F.shiftleft(F.col("_shard").cast("bigint"), _CELL_BITS)).drop("_shard")
    out = lookup_join(out, cells.planes, ["block_id", "_shard"], "left", small_rows=size[1], max_broadcast=_BROADCAST_BYTES)
    leaf = F.when(F.col("_planes").isNull(), 0).otherwise(leaf_of("_planes", *AXES))
    return out.withColumn("_cell", F.shiftleft(F.col("_shard").cast("bigint"), _CELL_BITS) + leaf).drop("_shard", "_planes")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for systems of ``rows`` points: solving takes long for few bytes, so their number is not left to Spark, which goes by bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, math.ceil(rows / _ROWS_PER_TASK))


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Deal a table of ``rows`` points by ``keys`` to as many tasks as their systems are worth."""
    return df.repartition(tasks_for(df.sparkSession, rows), *keys)
