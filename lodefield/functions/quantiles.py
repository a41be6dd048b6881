"""Exact order statistics without gathering a column in one task.

The built-in exact ``percentile`` builds a map of all distinct values in the
final aggregation task.  Here mergeable rank sketches bracket every wanted rank of a floating
column in the scan that counts it, a second scan counts the rows below and inside the brackets, and
what lies inside is narrowed by histogram passes, mostly one: each pass counts a fixed number of buckets inside the interval known to hold the
rank (partial aggregation keeps the shuffle at buckets x map tasks) and keeps one
bucket.  When few rows are left their distinct values are counted exactly.  All
columns and ranks share each pass, up to ``PASS_INTERVALS`` intervals.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BUCKETS = 4096
FINISH_ROWS = 50_000
#: Intervals of a pass: a pass of 32 is over five times as slow as two of 16, presumably because the JVM does not compile so long a method.
PASS_INTERVALS = 16
#: Ranks of the sketches are off by one in so many rows at most; brackets are twice as wide on either side.
SKETCH_ACCURACY = 10_000
# Fixed value: the greatest finite double.
_MAX_DOUBLE = 1.7976931348623157e308
_MAX_PASSES = 200


@dataclass(frozen=True)
class _Interval:
    col: str
    lo: float
    hi: float
    below: int
    rows: int

    @property
    def solved(self) -> bool:
        return self.lo == self.hi


def _bucket(value: Column, iv: _Interval, integral: bool) -> Column:
    if integral:
        width = max(1, -(-(iv.hi - iv.lo + 1) // BUCKETS))
        return F.call_function("div", value - F.lit(iv.lo), F.lit(width))
    if not math.isfinite(iv.hi - iv.lo):
        # Infinities have the outermost buckets; the finite values are scaled before they are subtracted.
        lo, hi = max(iv.lo, -_MAX_DOUBLE), min(iv.hi, _MAX_DOUBLE)
        width = (hi / 2 - lo / 2) / (BUCKETS / 2 - 2)
        inner = F.floor(value / F.lit(width) - F.lit(lo / width)).cast("int") + F.lit(1)
        return F.when(value < F.lit(lo), 0).when(value > F.lit(hi), BUCKETS - 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(BUCKETS - 2), inner)))
    width = max((iv.hi - iv.lo) / BUCKETS, 5e-324)
    return F.least(F.lit(BUCKETS - 1), F.floor((value - F.lit(iv.lo)) / F.lit(width)).cast("int"))


def _one_pass(df: DataFrame, open_ivs: list[_Interval], types: dict[str, bool]):
    """Count the buckets (or the values, when few rows) of every open interval."""
    integral = all(types.values())
    kind = "bigint" if integral else "double"
    by_col: dict[str, list[int]] = {}
    for i, iv in enumerate(open_ivs):
        by_col.setdefault(iv.col, []).append(i)
    # Rows outside all intervals, mostly nearly all, are not copied for each column.
    tests = [F.col(iv.col).cast(kind).between(F.lit(iv.lo), F.lit(iv.hi)) for iv in open_ivs]
    df = df.filter(functools.reduce(lambda a, b: a | b, tests))
    # Exploding first makes each value a plain column, computed once per row.
    values = F.array(*[F.struct(F.lit(j).alias("c"), F.col(col).cast(kind).alias("v")) for j, col in enumerate(by_col)])
    rows = df.select(F.explode(values).alias("s")).select("s.c", "s.v")
    v = F.col("v")
    few = FINISH_ROWS // len(open_ivs)
    slot = bucket = value = None
    for j, members in enumerate(by_col.values()):
        for i in members:
            iv = open_ivs[i]
            inside = (F.col("c") == j) & v.between(F.lit(iv.lo), F.lit(iv.hi))
            slot = (F if slot is None else slot).when(inside, F.lit(i))
            if iv.rows <= few:
                value = (F if value is None else value).when(inside, v)
            else:
                bucket = (F if bucket is None else bucket).when(inside, _bucket(v, iv, integral).cast("bigint"))
    none = F.lit(None)
    rows = rows.select(
        slot.alias("slot"), (none if bucket is None else bucket).cast("bigint").alias("bucket"),
        (none if value is None else value).cast(kind).alias("value"), "v")
    return (
        rows.filter("slot is not null")
        .groupBy("slot", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .toPandas()
        .sort_values(["slot", "lo"])
    )


def _bracketed(df: DataFrame, place: dict[tuple[str, int], _Interval], brackets: dict[tuple[str, int], tuple[float, float]]) -> None:
    """Count the rows below and inside the brackets, and narrow the columns whose ranks all prove to lie inside.

    The passes need disjoint intervals, so overlapping brackets of a column become one.
    """
    merged: dict[str, list[list[float]]] = {}
    for col, lo, hi in sorted({(col, *span) for (col, _), span in brackets.items()}):
        held = merged.setdefault(col, [])
        if held and lo <= held[-1][1]:
            held[-1][1] = max(held[-1][1], hi)
        else:
            held.append([lo, hi])
    if not merged:
        return
    counts = df.agg(*[
        F.count_if(test).alias(f"{name}{i}_{col}") for col, held in merged.items() for i, (lo, hi) in enumerate(held)
        for name, test in (("below", F.col(col) < F.lit(lo)), ("inside", F.col(col).between(F.lit(lo), F.lit(hi))))]).first()
    for col, held in merged.items():
        found = [_Interval(col, lo, hi, counts[f"below{i}_{col}"], counts[f"inside{i}_{col}"]) for i, (lo, hi) in enumerate(held)]
        own = {key: iv for key in place if key[0] == col for iv in found if iv.below <= key[1] < iv.below + iv.rows}
        if all(key in own for key in place if key[0] == col):
            place.update(own)


def order_statistics(
    df: DataFrame, ranks: dict[str, set[int]], spans: dict[str, tuple], brackets: dict[tuple[str, int], tuple[float, float]] | None = None,
) -> dict[tuple[str, int], _Interval]:
    """Where each 0-based rank of each column falls; ``spans`` gives (n, lowest, highest), ``brackets`` likely bounds of a rank.

    Where a rank is outside its bracket its column is searched as a whole.  A result holds the value (``lo``), the rows below it and the rows equal to it.
    """
    types = {c: df.schema[c].dataType.typeName() in ("long", "integer", "short", "byte") for c in ranks}
    if len(set(types.values())) > 1:
        raise TypeError("mix of integer and floating columns; rank them separately")
    place = {}
    for col, wanted in ranks.items():
        n, lo, hi = spans[col]
        for r in wanted:
            place[(col, r)] = _Interval(col, lo, hi, 0, n)
    _bracketed(df, place, brackets or {})
    for _ in range(_MAX_PASSES):
        open_ivs = sorted({iv for iv in place.values() if not iv.solved}, key=lambda iv: (iv.col, iv.lo))
        if not open_ivs:
            return place
        steps = {}
        for first in range(0, len(open_ivs), PASS_INTERVALS):
            counts = _one_pass(df, open_ivs[first:first + PASS_INTERVALS], types)
            steps.update({first + i: part for i, part in counts.groupby("slot")})
        for key, iv in place.items():
            if iv.solved:
                continue
            part = steps[open_ivs.index(iv)]
            upto = iv.below + part["n"].cumsum()
            at = int((upto > key[1]).to_numpy().argmax())
            kind = int if types[iv.col] else float
            rows = int(part["n"].iloc[at])
            place[key] = _Interval(iv.col, kind(part["lo"].iloc[at]), kind(part["hi"].iloc[at]), int(upto.iloc[at]) - rows, rows)
    raise RuntimeError("order statistics did not settle")


def uniform_rank(df: DataFrame, col: str, rank: int, n: int, top: int) -> _Interval:
    """Where the 0-based ``rank`` of ``n`` uniform hashes of 0 to ``top`` falls: one pass counts the values around the place expected.

    Should the rank lie elsewhere, or too many values around it, the column is searched as by ``order_statistics``.
    """
    share, spread = (rank + 0.5) / n, 5 * math.sqrt(n) / 2 + 10
    lo, hi = (max(0, min(top, int(top * (share + side * spread / n)))) for side in (-1, 1))
    if 2 * spread <= FINISH_ROWS:
        v = F.col(col)
        found = df.filter(v <= F.lit(hi)).groupBy(F.when(v >= F.lit(lo), v).otherwise(F.lit(-1)).alias("value")).agg(
            F.count(F.lit(1)).alias("n")).orderBy("value").limit(FINISH_ROWS + 1).collect()
        below = 0
        for value, rows in found:
            if below <= rank < below + rows and value >= 0:
                return _Interval(col, value, value, below, rows)
            below += rows
    return order_statistics(df.select(col), {col: {rank}}, {col: (n, 0, top)}, {(col, rank): (lo, hi)})[(col, rank)]


def _numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns, NaN as NULL."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).cast("double").alias(c) if c in floats else F.col(c) for c in cols])


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], approx: bool = False) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column; NULL and NaN are ignored, infinities are the lowest and highest values.

    A quantile between an infinity and another value is that infinity, between both infinities NaN.
    ``approx=True`` uses one ``percentile_approx`` pass instead.
    """
    if approx:
        row = df.agg(*[F.percentile_approx(c, probs, 10000).alias(c) for c in cols]).first()
        return {c: list(row[c] or []) for c in cols}
    return quantiles_and(df, cols, probs, [])[0]


def quantiles_and(df: DataFrame, cols: list[str], probs: list[float], aggregates: list[Column]) -> tuple[dict[str, list[float]], Row]:
    """``exact_quantiles`` and a row with ``aggregates`` of the columns, NaN as NULL, from the same scan as the sketches."""
    numbers = _numbers(df, cols)
    floats = [c for c in cols if numbers.schema[c].dataType.typeName() == "double"]
    near = sorted({min(1.0, max(0.0, p + side * 2 / SKETCH_ACCURACY)) for p in probs for side in (-1, 1)})
    row = numbers.agg(
        *_span_columns(cols), *aggregates, *[F.percentile_approx(c, near, SKETCH_ACCURACY).alias(f"sketch_{c}") for c in floats]).first()
    spans = _spans(row, cols)
    brackets = {}
    for c in floats:
        n, lowest, highest = spans[c]
        for p in probs if n else []:
            low, high = (row[f"sketch_{c}"][near.index(min(1.0, max(0.0, p + side * 2 / SKETCH_ACCURACY)))] for side in (-1, 1))
            # The outermost ranks of a sketch need not be the ends of the column.
            low, high = (lowest if p * SKETCH_ACCURACY <= 2 else low), (highest if (1 - p) * SKETCH_ACCURACY <= 2 else high)
            for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                brackets.setdefault((c, r), (low, high))
    return quantiles_from_spans(numbers, spans, probs, brackets), row


def _span_columns(cols: list[str]) -> list[Column]:
    return [f(c).alias(f"{p}_{c}") for c in cols for p, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]


def _spans(row, cols: list[str]) -> dict[str, tuple]:
    return {c: (row[f"n_{c}"], row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def column_spans(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    return _spans(df.agg(*_span_columns(cols)).first(), cols)


def quantiles_from_spans(
    df: DataFrame, spans: dict[str, tuple], probs: list[float], brackets: dict[tuple[str, int], tuple[float, float]] | None = None,
) -> dict[str, list[float]]:
    """As ``exact_quantiles`` when count, min and max are already known."""
    ranks: dict[str, set[int]] = {}
    for c, (n, _, _) in spans.items():
        if n:
            ranks[c] = {r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
    found = order_statistics(df.select(*spans), ranks, spans, brackets) if ranks else {}
    out = {}
    for c, (n, _, _) in spans.items():
        out[c] = []
        for p in probs if n else []:
            pos = p * (n - 1)
            lo, hi = found[(c, math.floor(pos))].lo, found[(c, math.ceil(pos))].lo
            part = pos - math.floor(pos)
            out[c].append(lo if lo == hi or part == 0 else lo + (hi - lo) * part)
    return out
