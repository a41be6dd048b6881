"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.functions.binning import grade_class
from lodefield.functions.moments import moments
from lodefield.operators import balance, blocks, clean, contours, explain, fusion, kriging, metrics, reports, samples, search, split, surface, trees, variogram
from lodefield.operators.components import apply_components, fit_components
from lodefield.operators.proxy import rolling_mean
from lodefield.plans import views as V
from lodefield.plans.modelling import apply_features, fit_features
from lodefield.plans.views import PREDICTIONS, sql, sql_hash, sql_uniform
from lodefield.session import checkpoint_folder, ship_package
from lodefield.sources import sinks, tables
from lodefield.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (no negative zero), integers as BIGINT."""
    out = {}
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind == "double":
            out[f.name] = F.round(F.col(f.name), digits) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            out[f.name] = F.col(f.name).cast("bigint")
    return df.withColumns(out) if out else df


def query(name: str, oracle: str | None = None, digits: int = 6):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return tidy(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def rnd(*columns: str, digits: int = 6) -> str:
    """``expr as name`` items, each rounded like ``tidy`` does."""
    items = []
    for c in columns:
        expr, _, alias = c.rpartition(" as ")
        items.append(f"round({expr or alias}, {digits}) + cast(0 as double) as {alias}")
    return ", ".join(items)


# --- samples ------------------------------------------------------------------------

@query("composite_points", sql(f"select sample_id, hole_id, {rnd('x', 'y', 'depth', 'grade')} from samples", "samples"))
def _(spark, sf):
    return V.samples(spark, sf).select("sample_id", "hole_id", "x", "y", "depth", "grade")


@query("collar_join", sql(
    f"select i.interval_id, i.hole_id, {rnd('c.e as e', 'c.n as n', 'i.d_from as d_from')} from intervals i join collars c on i.hole_id = c.hole_id",
    "intervals", "collars"))
def _(spark, sf):
    return samples.join_collars(V.intervals(spark, sf), V.collars(spark, sf)).select("interval_id", "hole_id", "e", "n", "d_from")


_TEXT = {
    "interval_id": "interval_id",
    "d_from": "case when hole_id % 29 = 0 then 'inf' else cast(cast(d_from as bigint) as varchar(20)) end",
    "d_to": "case when hole_id % 31 = 0 then 'NaN' else cast(cast(ceil(d_to) as bigint) as varchar(20)) end",
    "grade": "case when grade is null then 'n/a' else cast(cast(floor(grade * 100) as bigint) as varchar(20)) end",
}


@query("parse_tolerant", sql(f"""
    select interval_id, {rnd('a as d_from', 'b as d_to', 'g as grade')}
    from (select interval_id, try_cast(d_from as double) as a, try_cast(d_to as double) as b, try_cast(grade as double) as g
          from (select {V.select_list(_TEXT)} from intervals) t) v
    where isfinite(a) and isfinite(b) and isfinite(g) and b > a""", "intervals"))
def _(spark, sf):
    text = V.intervals(spark, sf).selectExpr(*[f"{e} as {a}" for a, e in _TEXT.items()])
    return samples.non_empty(samples.parse_intervals(text))


@query("drop_missing", sql(f"""
    select interval_id, {rnd('d_from', 'd_to', 'grade')}
    from (select interval_id, d_from, case when hole_id % 31 = 0 then cast('NaN' as double) else d_to end as d_to, grade from intervals) t
    where grade is not null and not isnan(d_to)""", "intervals"))
def _(spark, sf):
    df = V.intervals(spark, sf).withColumn("d_to", F.expr("case when hole_id % 31 = 0 then cast('NaN' as double) else d_to end"))
    return samples.drop_missing(df.select("interval_id", "d_from", "d_to", "grade"))


@query("attr_join", sql(
    "select i.interval_id, i.hole_id, c.line_no from intervals i left join (select distinct hole_id, line_no from collars) c on i.hole_id = c.hole_id",
    "intervals", "collars"))
def _(spark, sf):
    return samples.attach_attributes(
        V.intervals(spark, sf), V.collars(spark, sf), ["line_no"]).select("interval_id", "hole_id", "line_no")


@query("distinct_attributes", sql("select distinct hole_id, line_no from collars", "collars"))
def _(spark, sf):
    return V.collars(spark, sf).select("hole_id", "line_no").distinct()


@query("union_sets", sql(
    f"select sample_id, _set, {rnd('grade')} from labelled where _set = 'Train' union all "
    f"select sample_id, _set, {rnd('grade')} from labelled where _set = 'Test'", "labelled"))
def _(spark, sf):
    train, test = split.train_test(V.labelled(spark, sf))
    return samples.union_sets(train, test).select("sample_id", "_set", "grade")


# --- cleaning, features, balance ------------------------------------------------------

@query("outliers", sql(f"select sample_id, {rnd('x', 'y', 'depth', 'grade')} from cleaned", "cleaned"))
def _(spark, sf):
    return V.cleaned(spark, sf).select("sample_id", "x", "y", "depth", "grade")


@query("features", sql(
    f"select sample_id, {rnd('r', 'xy', 'depth2', 'r2')} from featured", "featured"))
def _(spark, sf):
    return V.featured(spark, sf).select("sample_id", "r", "xy", "depth2", "r2")


@query("depth_norm", sql(f"select sample_id, {rnd('depth', 'depth_norm')} from featured", "featured"))
def _(spark, sf):
    return V.featured(spark, sf).select("sample_id", "depth", "depth_norm")


_TAILS = """select *, 'low' as tail from cleaned where grade <= (select quantile_cont(grade, 0.02) from cleaned)
    union all select *, 'high' as tail from cleaned where grade >= (select quantile_cont(grade, 0.98) from cleaned)"""


@query("tails", sql(f"select sample_id, tail, {rnd('grade')} from ({_TAILS}) t", "cleaned"))
def _(spark, sf):
    df = V.cleaned(spark, sf)
    return clean.select_tails(df, clean.fit_tails(df)).select("sample_id", "tail", "grade")


@query("oversample", sql(f"""
    , tails as ({_TAILS}),
    ranked as (select *, row_number() over (order by {sql_hash('42t', 'sample_id', 'tail')}, sample_id, tail) - 1 as pos from tails),
    draws as (select i as draw, {sql_hash('42d', 'i')} % (select count(*) from tails) as pos
              from range((select least(count(*), 1000) from tails)) t(i))
    select sample_id, {rnd('x', 'y', 'depth', 'grade')} from cleaned
    union all
    select sample_id || '+o' || cast(draw as varchar) as sample_id, {rnd('x', 'y', 'depth', 'grade')}
    from ranked join draws using (pos)""", "cleaned"))
def _(spark, sf):
    return balance.oversample_extremes(V.cleaned(spark, sf)).select("sample_id", "x", "y", "depth", "grade")


_NORMAL = (f"sqrt(-2 * ln({sql_uniform('42a', 'sample_id', 'tail')})) * cos(2 * pi() * {sql_uniform('42b', 'sample_id', 'tail')})")


@query("jitter", sql(f"""
    select sample_id, {rnd('grade')} from cleaned
    union all
    select sample_id || '+j' || tail as sample_id,
           {rnd(f'grade + {_NORMAL} * greatest((select stddev_samp(grade) from cleaned) * 0.01, 1e-6) as grade')}
    from ({_TAILS}) t""", "cleaned"))
def _(spark, sf):
    return balance.jitter_extremes(V.cleaned(spark, sf)).select("sample_id", "grade")


_KM = {"x": "x / 1000", "y": "y / 1000", "depth": "depth / 100"}
_COV = ["x", "y", "depth", "grade", "r", "xy", "depth2", "r2"]


@query("covariance", sql(f"""
    , km as (select x / 1000 as x, y / 1000 as y, depth / 100 as depth, grade from cleaned),
    f as (select *, sqrt(x * x + y * y) as r, x * y as xy, depth * depth as depth2, x * x + y * y as r2 from km)
    """ + " union all ".join(
    f"select '{a}' as a, '{b}' as b, {rnd(f'covar_samp({a}, {b}) as cov')} from f" for i, a in enumerate(_COV) for b in _COV[i:]), "cleaned"))
def _(spark, sf):
    df = clean.add_features(V.cleaned(spark, sf).selectExpr("x / 1000 as x", "y / 1000 as y", "depth / 100 as depth", "grade"))
    m = moments(df, _COV)
    rows = [(a, b, float(m.cov[i, j])) for i, a in enumerate(_COV) for j, b in enumerate(_COV) if j >= i]
    return spark.createDataFrame(rows, "a string, b string, cov double")


_BASE = list(clean.BASE_FEATURES)


@query("scale", sql(f"select sample_id, " + rnd(*[
    f"({c} - (select avg({c}) from featured)) / (select stddev_pop({c}) from featured) as {c}_sc" for c in _BASE], digits=4) + " from featured",
    "featured"), digits=4)
def _(spark, sf):
    return clean.scale_features(V.featured(spark, sf), _BASE).select("sample_id", *[f"{c}_sc" for c in _BASE])


@query("split", sql("select sample_id, _set from labelled", "labelled"))
def _(spark, sf):
    return V.labelled(spark, sf).select("sample_id", "_set")


@query("split_by_hole", sql(f"""
    select sample_id, hole_id, case when {sql_uniform('42p', 'hole_id')} < 0.3 then 'Test' else 'Train' end as _set from cleaned""", "cleaned"))
def _(spark, sf):
    return split.split_fraction(V.cleaned(spark, sf), 0.3, 42, "hole_id").select("sample_id", "hole_id", "_set")


@query("rolling_proxy", sql(f"""
    select sample_id, {rnd('avg(grade) over (partition by hole_id order by depth, sample_id rows between 2 preceding and current row) as kriging_pred')}
    from cleaned""", "cleaned"))
def _(spark, sf):
    return rolling_mean(V.cleaned(spark, sf).select("sample_id", "hole_id", "depth", "grade")).select("sample_id", "kriging_pred")


@query("subsample", sql(f"select sample_id, {rnd('grade')} from cleaned order by {sql_hash('42s', 'sample_id')}, sample_id limit 3000", "cleaned"))
def _(spark, sf):
    return split.subsample(V.cleaned(spark, sf), 3000).select("sample_id", "grade")


@query("kfold", sql(f"select sample_id, {sql_hash('42k', 'sample_id')} % 5 as fold from cleaned", "cleaned"))
def _(spark, sf):
    return split.add_fold(V.cleaned(spark, sf)).select("sample_id", "fold")


@query("fit_apply", sql(f"""
    , tr as (select * from labelled where _set = 'Train')
    select sample_id, """ + rnd(*[f"({c} - (select avg({c}) from tr)) / (select stddev_pop({c}) from tr) as {c}_sc" for c in ("x", "y", "depth")], digits=4)
    + " from labelled where _set = 'Test'", "labelled"), digits=4)
def _(spark, sf):
    """Scaler fitted on the training rows, applied to the test rows."""
    train, test = split.train_test(V.labelled(spark, sf))
    cols = ["x", "y", "depth"]
    return clean.apply_scaler(test, clean.fit_scaler(train, cols)).select("sample_id", *[f"{c}_sc" for c in cols])


# --- blocks, variograms ---------------------------------------------------------------

def _sql_bin(v: str, lo: str, hi: str, n: int) -> str:
    return f"least({n - 1}, cast(floor(({v} - {lo}) / (({hi} - {lo}) / {n})) as bigint))"


_GRID = "g as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(depth) z0, max(depth) z1 from cleaned)"
_BIJK = f"{_sql_bin('x', 'x0', 'x1', 5)} as bi, {_sql_bin('y', 'y0', 'y1', 5)} as bj, {_sql_bin('depth', 'z0', 'z1', 3)} as bk"


@query("blocks", sql(f"""
    , {_GRID}, b as (select {_BIJK} from cleaned, g)
    select (bi * 5 + bj) * 3 + bk as block_id, bi, bj, bk, count(*) as n from b group by all""", "cleaned"))
def _(spark, sf):
    df = V.cleaned(spark, sf)
    return blocks.block_counts(blocks.assign_blocks(df, blocks.fit_grid(df)))


def _sql_shared(v: str, lo: str, hi: str, n: int, out: str) -> str:
    pos = f"({v} - {lo}) / (({hi} - {lo}) / {n})"
    return f"unnest(range(greatest(0, least({n - 1}, cast(ceil({pos} - 1) as bigint))), least({n - 1}, cast(floor({pos}) as bigint)) + 1)) as {out}"


@query("blocks_shared", sql(f"""
    , {_GRID}, b1 as (select *, {_sql_shared('x', 'x0', 'x1', 5, 'bi')} from cleaned, g),
    b2 as (select *, {_sql_shared('y', 'y0', 'y1', 5, 'bj')} from b1),
    b3 as (select *, {_sql_shared('depth', 'z0', 'z1', 3, 'bk')} from b2)
    select (bi * 5 + bj) * 3 + bk as block_id, bi, bj, bk, count(*) as n from b3 group by all""", "cleaned"))
def _(spark, sf):
    df = V.cleaned(spark, sf)
    return blocks.block_counts(blocks.assign_blocks(df, blocks.fit_grid(df), edges="shared"))


@query("block_rmse", sql(f"""
    , {_GRID.replace('from cleaned', 'from predicted')}, b as (select *, {_BIJK} from predicted, g)
    select (bi * 5 + bj) * 3 + bk as block_id, count(*) as n,
           {rnd('sqrt(avg((kriging_pred - grade) * (kriging_pred - grade))) as rmse')} from b group by 1""", "predicted"))
def _(spark, sf):
    df = V.predicted(spark, sf)
    return blocks.block_rmse(blocks.assign_blocks(df, blocks.fit_grid(df)))


_VG = {"spherical": variogram.Variogram("spherical", 120.0, 9.0, 1.5), "exponential": variogram.Variogram("exponential", 200.0, 7.0, 0.5),
       "gaussian": variogram.Variogram("gaussian", 150.0, 8.0, 1.0)}


@query("variogram_models", sql("select sample_id, " + rnd(
    "case when h > 0 then 1.5 + 7.5 * (case when h <= 120 then 1.5 * (h / 120) - 0.5 * (h / 120) * (h / 120) * (h / 120) else 1 end) else 0 end as g_spherical",
    "case when h > 0 then 0.5 + 6.5 * (1 - exp(-3 * (h / 200))) else 0 end as g_exponential",
    "case when h > 0 then 1 + 7 * (1 - exp(-(1.75 * (h / 150)) * (1.75 * (h / 150)))) else 0 end as g_gaussian",
) + " from (select sample_id, -depth as h from samples) t", "samples"))
def _(spark, sf):
    h = -F.col("depth")
    return V.samples(spark, sf).select("sample_id", *[variogram.gamma_column(h, v).alias(f"g_{name}") for name, v in _VG.items()])


_LAG, _LAGS = 60.0, 5
_FIT_CELL = (15.0, 15.0, 2.0)


@query("variogram_lags", sql(f"""
    , z as (select x, y, depth, cast(floor(x / {_LAG * _LAGS}) as bigint) as i, cast(floor(y / {_LAG * _LAGS}) as bigint) as j,
                   cast(count(*) as double) as n, sum(grade - m) as s, sum((grade - m) * (grade - m)) as q
            from cleaned, (select avg(grade) as m from cleaned) group by all),
    near as (select z.*, i + di as ni, j + dj as nj from z, range(-1, 2) a(di), range(-1, 2) b(dj)),
    pairs as (select sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.depth - b.depth) * (a.depth - b.depth)) as h,
                     a.n * b.n as p, b.n * a.q + a.n * b.q - 2 * a.s * b.s as sq
              from near a join z b on b.i = a.ni and b.j = a.nj and (a.x, a.y, a.depth) < (b.x, b.y, b.depth)
              union all select 0, n * (n - 1) / 2, n * q - s * s from z where n > 1)
    select cast(floor(h / {_LAG}) as bigint) as lag, cast(sum(p) as bigint) as pairs,
           {rnd('sqrt(sum(h * h * p) / sum(p)) as h_rms', 'sum(sq) / (2 * sum(p)) as gamma')}
    from pairs where h < {_LAG * _LAGS} group by 1""", "cleaned"))
def _(spark, sf):
    """All pairs within the last lag; the SQL lists the pairs of locations."""
    return variogram.lag_table(V.cleaned(spark, sf), _LAG, _LAGS, _FIT_CELL).select("lag", "pairs", "h_rms", "gamma")


_TRIALS_SQL = """select hole_id as trial, case hole_id % 3 when 0 then 'spherical' when 1 then 'exponential' else 'gaussian' end as model,
    10.0 + max(-depth) as range, cast(1 as double) + var_samp(grade) as sill, cast(0 as double) + hole_id % 5 as nugget,
    sqrt(avg((grade - 40) * (grade - 40))) as rmse from {} group by hole_id"""


@query("search_stats", sql(f"""
    , t as ({_TRIALS_SQL.format('cleaned')})
    select {rnd('min(rmse) as best_rmse', 'max(rmse) as worst_rmse', 'avg(rmse) as mean_rmse', 'quantile_cont(rmse, 0.5) as median_rmse',
                'stddev_pop(rmse) as std_rmse')}, count(*) as evals_total, arg_min(trial, rmse) + 1 as evals_to_best,
           arg_min(model, rmse) as best_model, {rnd('arg_min(range, rmse) as best_range', 'arg_min(sill, rmse) as best_sill',
                                                    'arg_min(nugget, rmse) as best_nugget')} from t""", "cleaned"))
def _(spark, sf):
    """Statistics of one constant-estimate trial per hole."""
    spread = F.col("grade") - 40
    trials = V.cleaned(spark, sf).groupBy(F.col("hole_id").alias("trial")).agg(
        (10.0 + F.max(-F.col("depth"))).alias("range"), (1.0 + F.var_samp("grade")).alias("sill"), F.sqrt(F.avg(spread * spread)).alias("rmse"),
    ).withColumn("nugget", (F.col("trial") % 5).cast("double")).withColumn(
        "model", F.expr("case trial % 3 when 0 then 'spherical' when 1 then 'exponential' else 'gaussian' end"))
    return search.search_stats(trials)


# --- fusion ---------------------------------------------------------------------------

def _predicted_once(spark, sf, *columns: str):
    """The named columns of the predictions, written once for fits that scan them repeatedly: each scan would hash every row's key three times."""
    return staged(V.predicted(spark, sf).select(*columns), "predicted")


_THREE = ["kriging_pred", "xgb_pred", "hybrid_pred"]
_NAMES = [*_THREE, "grade"]


@query("ridge_moments", sql(" union all ".join(
    [f"select 'mean' as kind, '{a}' as a, '{a}' as b, count(*) as n, {rnd(f'avg({a}) as value')} from predicted" for a in _NAMES]
    + [f"select 'cov' as kind, '{a}' as a, '{b}' as b, count(*) as n, {rnd(f'covar_pop({a}, {b}) as value')} from predicted"
       for i, a in enumerate(_NAMES) for b in _NAMES[i:]]), "predicted"))
def _(spark, sf):
    m = moments(_predicted_once(spark, sf, *_NAMES), _NAMES)
    rows = [("mean", a, a, m.n, float(v)) for a, v in zip(_NAMES, m.mean)]
    rows += [("cov", a, b, m.n, float(m.cross[i, j] / m.n)) for i, a in enumerate(_NAMES) for j, b in enumerate(_NAMES) if j >= i]
    return spark.createDataFrame(rows, "kind string, a string, b string, n bigint, value double")


def _sql_ridge(source: str, alpha: float = 1.0) -> str:
    """Ridge weights of three predictions by Cramer's rule on the penalised moments."""
    s = {(i, j): f"(covar_pop({a}, {b}) * count(*){f' + {alpha}' if i == j else ''})"
         for i, a in enumerate(_THREE) for j, b in enumerate(_THREE)}
    c = [f"(covar_pop({a}, grade) * count(*))" for a in _THREE]
    names = [f"{s[i, j]} as s{i}{j}" for i in range(3) for j in range(3)] + [f"{v} as c{i}" for i, v in enumerate(c)]
    mean = [f"avg({a}) as m{i}" for i, a in enumerate(_NAMES)]

    def det(cols: list[list[str]]) -> str:
        (a, d, g), (b, e, h), (q, f, i) = cols
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {q} * ({d} * {h} - {e} * {g}))"

    columns = [[f"s{i}{j}" for i in range(3)] for j in range(3)]
    right = ["c0", "c1", "c2"]
    solved = [f"{det([right if k == j else columns[k] for k in range(3)])} / {det(columns)} as r{j}" for j in range(3)]
    clipped = " + ".join(f"greatest(r{j}, 0)" for j in range(3))
    weights = [f"case when {clipped} > 0 then greatest(r{j}, 0) / ({clipped}) else 1.0 / 3 end as w{j}" for j in range(3)]
    return (f"(select *, m3 - (w0 * m0 + w1 * m1 + w2 * m2) as centred, m3 - (r0 * m0 + r1 * m1 + r2 * m2) as raw from (select *, {', '.join(weights)} "
            f"from (select *, {', '.join(solved)} from (select {', '.join(names + mean)} from {source}))))")


@query("fusion_weights", sql(f"select {rnd('w0 as w_kriging_pred', 'w1 as w_xgb_pred', 'w2 as w_hybrid_pred', 'centred as intercept')} from "
                             + _sql_ridge("predicted"), "predicted"))
def _(spark, sf):
    return fusion.fit_fusion(_predicted_once(spark, sf, *_NAMES), _THREE).frame(spark)


@query("fusion_linear", sql(f"""
    select sample_id, {rnd('kriging_pred * w0 + xgb_pred * w1 + hybrid_pred * w2 + centred as fused',
                           'kriging_pred * w0 + xgb_pred * w1 + hybrid_pred * w2 + raw as fused_raw', digits=5)}
    from predicted, {_sql_ridge('predicted')} w""", "predicted"), digits=5)
def _(spark, sf):
    df = _predicted_once(spark, sf, "sample_id", *_NAMES)
    m = moments(df, _NAMES)
    centred, raw = (fusion.fusion_from_moments(m, _THREE, intercept=i) for i in ("centred", "raw"))
    return fusion.apply_fusion(fusion.apply_fusion(df, centred, "fused"), raw, "fused_raw").select("sample_id", "fused", "fused_raw")


@query("oof_ridge", sql(f"""
    , folded as (select *, {sql_hash('42k', 'sample_id')} % 5 as fold from predicted),
    w as (""" + " union all ".join(
    f"select {f} as fold, w0, w1, w2, raw from " + _sql_ridge(f"(select * from folded where fold <> {f})") for f in range(5))
    + f""") select sample_id, f.fold, {rnd('kriging_pred * w0 + xgb_pred * w1 + hybrid_pred * w2 + raw as oof_ridge', digits=5)}
    from folded f join w on f.fold = w.fold""", "predicted"), digits=5)
def _(spark, sf):
    return fusion.out_of_fold_ridge(_predicted_once(spark, sf, "sample_id", *_NAMES), _THREE)[0].select("sample_id", "fold", "oof_ridge")


# --- metrics and reports ----------------------------------------------------------------

def _sql_metrics(p: str) -> str:
    return (f"select '{p}' as model, count(*) as n, " + rnd(
        f"avg(abs({p} - grade)) as mae", f"sqrt(avg(({p} - grade) * ({p} - grade))) as rmse",
        f"1 - avg(({p} - grade) * ({p} - grade)) / var_pop(grade) as r2", f"1 - var_pop({p} - grade) / var_pop(grade) as evs",
        f"avg(abs({p} - grade) / greatest(abs(grade), 1e-9)) * 100 as mape", f"avg({p} - grade) as bias") + " from predicted")


_METRICS = " union all ".join(_sql_metrics(p) for p in PREDICTIONS)


@query("metrics", sql(_METRICS, "predicted"))
def _(spark, sf):
    return metrics.evaluate(V.predicted(spark, sf), list(PREDICTIONS))


@query("model_compare", sql(f"select model, rmse, r2 from ({_METRICS}) m", "predicted"))
def _(spark, sf):
    return metrics.compare_models(metrics.evaluate(V.predicted(spark, sf), list(PREDICTIONS)))


@query("pred_pairs", sql(" union all ".join(
    f"select sample_id, '{p}' as model, {rnd('grade as truth', f'{p} as pred')} from predicted" for p in PREDICTIONS), "predicted"))
def _(spark, sf):
    return metrics.prediction_pairs(V.predicted(spark, sf), list(PREDICTIONS), keep=("sample_id",))


_ALL = ["grade", *PREDICTIONS]


@query("pred_limits", sql("select " + rnd(
    f"least({', '.join(f'min({c})' for c in _ALL)}) - 1 as lo", f"greatest({', '.join(f'max({c})' for c in _ALL)}) + 1 as hi") + " from predicted",
    "predicted"))
def _(spark, sf):
    return metrics.axis_limits(V.predicted(spark, sf), list(PREDICTIONS))


def _sql_hist(name: str, expr: str) -> str:
    return f"""select '{name}' as model, bin, {rnd('a + bin * ((b - a) / 40) as lo', 'a + (bin + 1) * ((b - a) / 40) as hi')}, count(*) as n,
        {rnd('max(m) as mean', 'max(s) as std')}
        from (select {_sql_bin('v', 'a', 'b', 40)} as bin, a, b, m, s from (select {expr} as v from predicted) p,
              (select min({expr}) a, max({expr}) b, avg({expr}) m, stddev_samp({expr}) s from predicted) q) t group by bin, a, b"""


@query("residual_hist", sql(" union all ".join(_sql_hist(p, f"({p} - grade)") for p in PREDICTIONS), "predicted"))
def _(spark, sf):
    return metrics.residual_histogram(V.predicted(spark, sf), list(PREDICTIONS))


@query("points_by_set", sql(f"select {rnd('x', 'y', 'depth')}, _set from labelled", "labelled"))
def _(spark, sf):
    return reports.points_by_set(V.labelled(spark, sf))


@query("model_delta", sql(_sql_hist("delta", "(fusion_pred - xgb_pred)"), "predicted"))
def _(spark, sf):
    return metrics.delta_histogram(V.predicted(spark, sf))


@query("model_delta_map", sql(f"select {rnd('x', 'y', 'fusion_pred - xgb_pred as delta')} from predicted", "predicted"))
def _(spark, sf):
    return metrics.delta_map(V.predicted(spark, sf))


@query("hexbin", sql(f"""
    , s as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from predicted),
    p as (select (x - x0) / ((x1 - x0) / 35) as a, (y - y0) / ((y1 - y0) / 20) as b, fusion_pred - grade as err from predicted, s),
    c as (select *, (a - floor(a + 0.5)) * (a - floor(a + 0.5)) + 3 * (b - floor(b + 0.5)) * (b - floor(b + 0.5)) as d1,
                 (a - floor(a) - 0.5) * (a - floor(a) - 0.5) + 3 * (b - floor(b) - 0.5) * (b - floor(b) - 0.5) as d2 from p),
    h as (select case when d1 < d2 then floor(a + 0.5) else floor(a) + 0.5 end as u,
                 case when d1 < d2 then floor(b + 0.5) else floor(b) + 0.5 end as v, err from c)
    select {rnd('u', 'v')}, count(*) as n, {rnd('avg(err) as mean_error')} from h group by h.u, h.v""", "predicted"))
def _(spark, sf):
    return reports.hexbin_error(V.predicted(spark, sf), "fusion_pred")


def _sql_calibration(p: str) -> str:
    probs = ", ".join(repr(i / 15) for i in range(16))
    return f"""select '{p}' as model, bin, count(*) as n, {rnd(f'avg({p}) as pred_mean', 'avg(grade) as true_mean')}
        from (select {p}, grade, greatest(1, (select count(*) from (select distinct unnest(quantile_cont({p}, [{probs}])) as e from predicted) q
              where e < r.{p})) as bin from predicted r) t group by bin"""


@query("calibration", sql(_sql_calibration("fusion_pred"), "predicted"))
def _(spark, sf):
    return metrics.calibration(_predicted_once(spark, sf, "fusion_pred", "grade"), ["fusion_pred"])


@query("calibration_multi", sql(" union all ".join(_sql_calibration(p) for p in ("xgb_pred", "fusion_pred")), "predicted"))
def _(spark, sf):
    return metrics.calibration(_predicted_once(spark, sf, "xgb_pred", "fusion_pred", "grade"), ["xgb_pred", "fusion_pred"])


@query("slices_equal", sql(f"""
    , s as (select min(depth) a, max(depth) b, stddev_samp(depth) sd from predicted)
    select {rnd('a + i * ((b - a) / 5) as centre', 'x', 'y', 'depth', 'fusion_pred - grade as err')}
    from predicted, s, range(1, 5) t(i) where abs(depth - (a + i * ((b - a) / 5))) <= sd * 0.1 + 1e-6""", "predicted"))
def _(spark, sf):
    return reports.slices_equal(V.predicted(spark, sf), "fusion_pred")


def _sql_slices(interval: int, band: int) -> str:
    return f"""s as (select min(depth) a, max(depth) b from labelled),
    sliced as (select l.*, a + k * cast({interval} as double) as z0
               from labelled l, s, range(0, 1000) t(k)
               where k < ceil((b + {interval} - a) / {interval}) and abs(depth - (a + k * cast({interval} as double))) <= {band})"""


def _sliced(spark, sf, interval=20.0, band=10.0):
    return reports.slices_regular(V.labelled(spark, sf), interval, band)


_SLICE_STATS = f"select {rnd('z0')}, _set, count(*) as n, {rnd('min(grade) as grade_min', 'avg(grade) as grade_mean', 'max(grade) as grade_max')} from sliced group by sliced.z0, _set"


@query("slices_regular", sql(f", {_sql_slices(20, 10)} {_SLICE_STATS}", "labelled"))
def _(spark, sf):
    return reports.slice_stats(_sliced(spark, sf))


@query("slices_sparse", sql(f", {_sql_slices(80, 10)} {_SLICE_STATS}", "labelled"))
def _(spark, sf):
    return reports.slice_stats(_sliced(spark, sf, 80.0))


@query("slice_points", sql(f", {_sql_slices(20, 10)} select {rnd('z0', 'x', 'y', 'grade')}, _set from sliced", "labelled"))
def _(spark, sf):
    return reports.slice_points(_sliced(spark, sf))


@query("slice_min_points", sql(f""", {_sql_slices(20, 10)},
    cells as (select z0, cast(floor(x / 100.0) as bigint) as cx, cast(floor(y / 100.0) as bigint) as cy, count(*) as n, avg(grade) as g
              from sliced group by all)
    select {rnd('z0')}, cx, cy, n, {rnd('g as grade_mean')}, cast(sum(n) over (partition by cells.z0) as bigint) as slice_n
    from cells qualify sum(n) over (partition by cells.z0) >= 10""", "labelled"))
def _(spark, sf):
    return reports.contour_cells(_sliced(spark, sf))


# Lines run through neighbouring cells that hold points; these rows of holes are over 800 m apart.
_CONTOUR_CELL = 1000.0
_CONTOURS = f""", {_sql_slices(20, 10)},
    cells as (select z0, cast(floor(x / {_CONTOUR_CELL}) as bigint) as cx, cast(floor(y / {_CONTOUR_CELL}) as bigint) as cy, count(*) as n, avg(grade) as g
              from sliced group by 1, 2, 3 qualify sum(count(*)) over (partition by z0) >= 10),
    spans as (select z0, (max(g) - min(g)) / 12 as raw from cells group by z0 having max(g) > min(g)),
    powers as (select z0, raw, pow(10.0, floor(log10(raw))) as p from spans),
    steps as (select z0, case when p >= raw then p when 2.0 * p >= raw then 2.0 * p when 2.5 * p >= raw then 2.5 * p when 5.0 * p >= raw then 5.0 * p
                              else 10.0 * p end as step from powers),
    corners as (select a.z0, a.cx, a.cy, a.g as sw, b.g as se, c.g as ne, d.g as nw, step
                from cells a join steps using (z0)
                join cells b on b.z0 = a.z0 and b.cx = a.cx + 1 and b.cy = a.cy
                join cells c on c.z0 = a.z0 and c.cx = a.cx + 1 and c.cy = a.cy + 1
                join cells d on d.z0 = a.z0 and d.cx = a.cx and d.cy = a.cy + 1),
    near as (select corners.*, unnest(range(cast(floor(least(sw, se, ne, nw) / step) as bigint), cast(floor(greatest(sw, se, ne, nw) / step) as bigint) + 2)) as m
             from corners),
    cut as (select near.*, m * step as level from near
            where m * step > least(sw, se, ne, nw) and m * step <= greatest(sw, se, ne, nw)),
    -- The four sides of a square, right-handed from the lower one.
    sides as (
        select z0, level, cx, cy, 0 as i, sw as a, se as b, cx as kx, cy as ky, 0 as side, (level - sw) / (se - sw) as part, (sw + se + ne + nw) / 4 as mid from cut
        union all select z0, level, cx, cy, 1, se, ne, cx + 1, cy, 1, (level - se) / (ne - se), (sw + se + ne + nw) / 4 from cut
        union all select z0, level, cx, cy, 2, ne, nw, cx, cy + 1, 0, (level - nw) / (ne - nw), (sw + se + ne + nw) / 4 from cut
        union all select z0, level, cx, cy, 3, nw, sw, cx, cy, 1, (level - sw) / (nw - sw), (sw + se + ne + nw) / 4 from cut),
    crossed as (
        select z0, level, cx, cy, i, kx, ky, side, a >= level as falls, mid >= level as joined,
               (kx + 0.5 + case side when 0 then part else 0 end) * {_CONTOUR_CELL} as x, (ky + 0.5 + case side when 1 then part else 0 end) * {_CONTOUR_CELL} as y,
               count(*) over (partition by z0, level, cx, cy) as n
        from sides where (a >= level) <> (b >= level)),
    segments as (
        select f.z0, f.level, f.kx as cx, f.ky as cy, f.side, f.x, f.y, t.kx as to_cx, t.ky as to_cy, t.side as to_side, t.x as to_x, t.y as to_y
        from crossed f join crossed t on f.z0 = t.z0 and f.level = t.level and f.cx = t.cx and f.cy = t.cy and f.falls and not t.falls
        where f.n = 2 or t.i = (f.i + case when f.joined then 1 else 3 end) % 4)"""


def _contours(spark, sf):
    return contours.contour_segments(reports.contour_cells(_sliced(spark, sf), _CONTOUR_CELL), _CONTOUR_CELL)


@query("contour_segments", sql(f"""{_CONTOURS}
    select {rnd('z0', 'level', 'x', 'y', 'to_x', 'to_y')}, cx, cy, cast(side as bigint) as side, to_cx, to_cy, cast(to_side as bigint) as to_side from segments""", "labelled"))
def _(spark, sf):
    return _contours(spark, sf)


# Lines by following the segments one by one: from points without a segment before them, then round what is left.
@query("contour_lines", sql(f"""{_CONTOURS},
    links as (select z0, level, struct_pack(cx := cx, cy := cy, side := side) as a, struct_pack(cx := to_cx, cy := to_cy, side := to_side) as b, x, y, to_x, to_y
              from segments),
    open_lines as (
        select z0, level, a as line, a as node, x, y, 0 as place from links l where not exists (select 1 from links p where p.z0 = l.z0 and p.level = l.level and p.b = l.a)
        union all
        select o.z0, o.level, o.line, l.b, l.to_x, l.to_y, o.place + 1 from open_lines o join links l on l.z0 = o.z0 and l.level = o.level and l.a = o.node),
    rest as (select l.* from links l where not exists (select 1 from open_lines o where o.z0 = l.z0 and o.level = l.level and o.node = l.a)),
    walks as (
        select z0, level, a as line, a as node, x, y, 0 as place from rest
        union all
        select w.z0, w.level, w.line, r.b, r.to_x, r.to_y, w.place + 1 from walks w join rest r on r.z0 = w.z0 and r.level = w.level and r.a = w.node
        where r.b > w.line),
    -- Only the walk from a closed line's least point comes back to it, by a last segment that the walk leaves out.
    loops as (select w.* from walks w join (select w.z0, w.level, w.line from walks w join rest r on r.z0 = w.z0 and r.level = w.level and r.a = w.node
                                            where r.b = w.line) k on k.z0 = w.z0 and k.level = w.level and k.line = w.line)
    select {rnd('z0', 'level', 'x', 'y')}, line.cx as line_cx, line.cy as line_cy, cast(line.side as bigint) as line_side, closed, cast(place as bigint) as place
    from (select *, false as closed from open_lines union all select *, true from loops) v""", "labelled").replace("with ", "with recursive ", 1))
def _(spark, sf):
    return contours.contour_lines(_contours(spark, sf))


_CLASS = "case when grade < 30 then '<30' when grade < 40 then '30-40' when grade < 50 then '40-50' else '>=50' end"


@query("slice_classes", sql(f", {_sql_slices(20, 10)} select {rnd('z0')}, {_CLASS} as grade_class, count(*) as n from sliced group by sliced.z0, 2", "labelled"))
def _(spark, sf):
    return reports.slice_classes(_sliced(spark, sf))


@query("slice_classes_wide", sql(f"""
    , {_sql_slices(20, 10)}, classed as (select z0, {_CLASS} as c from sliced)
    select {rnd('z0')}, """ + ", ".join(f"count(*) filter (c = '{c}') as \"{c}\"" for c in ("<30", "30-40", "40-50", ">=50"))
    + " from classed group by classed.z0", "labelled"))
def _(spark, sf):
    return reports.slice_classes_wide(_sliced(spark, sf))


@query("grade_classes", sql(
    f"select interval_id, case when grade is null then null else {_CLASS} end as grade_class, {_CLASS} as parity_class from intervals", "intervals"))
def _(spark, sf):
    return V.intervals(spark, sf).select(
        "interval_id", grade_class(F.col("grade")).alias("grade_class"), grade_class(F.col("grade"), ">=50").alias("parity_class"))


def _lined(spark, sf):
    return samples.attach_attributes(V.labelled(spark, sf), V.collars(spark, sf), ["line_no"])


_SECTIONS = """lined as (select l.*, c.line_no from labelled l left join (select distinct hole_id, line_no from collars) c on l.hole_id = c.hole_id),
    sections as (select line_no, count(*) as n, count(*) filter (_set = 'Train') as n_train, count(*) filter (_set = 'Test') as n_test,
        case when var_samp(x) < var_samp(y) then 'y' else 'x' end as axis,
        case when var_samp(x) < var_samp(y) then min(y) else min(x) end as start
        from lined where line_no is not null group by line_no having count(*) >= 10)"""


@query("sections", sql(f", {_SECTIONS} select line_no, n, n_train, n_test, axis, {rnd('start')} from sections", "labelled", "collars"))
def _(spark, sf):
    return reports.section_summary(_lined(spark, sf), "line_no")


@query("section_points", sql(f""", {_SECTIONS}
    select l.line_no, _set, {rnd("case when axis = 'y' then y else x end - start as hcoord_rel", 'depth', 'grade')}
    from lined l join sections s on l.line_no = s.line_no""", "labelled", "collars"))
def _(spark, sf):
    return reports.section_points(_lined(spark, sf), "line_no")


_LAYERS = "select lith, count(*) as n, {} from labelled where lith is not null group by lith having count(*) >= 10"


@query("layers", sql(_LAYERS.format(rnd("min(grade) as grade_min", "avg(grade) as grade_mean", "max(grade) as grade_max")), "labelled"))
def _(spark, sf):
    return reports.layer_summary(V.labelled(spark, sf), "lith")


@query("layer_points", sql(
    f"select lith, {rnd('x', 'y', 'grade')} from labelled where lith in (select lith from labelled group by lith having count(*) >= 10)", "labelled"))
def _(spark, sf):
    return reports.layer_points(V.labelled(spark, sf), "lith")


@query("surface_clip", sql(f"select sample_id, {rnd('depth + 250 as depth')} from samples where depth + 250 <= 0", "samples"))
def _(spark, sf):
    """Points raised by 250, so that about half lie above the surface."""
    raised = V.samples(spark, sf).withColumn("depth", F.col("depth") + 250)
    return surface.clip_to_surface(raised, V.surface(spark, sf)).select("sample_id", "depth")


@query("surface_nearest", sql(f"""
    , places as (select distinct x, y from samples),
    hit as (select p.x, p.y, arg_min(s.z, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) as z
            from places p, surface s group by p.x, p.y)
    select sample_id, {rnd('z as surface_z')} from samples join hit on samples.x = hit.x and samples.y = hit.y""", "samples", "surface"))
def _(spark, sf):
    return surface.nearest_surface(V.samples(spark, sf), V.surface(spark, sf)).select("sample_id", "surface_z")


# --- sinks and sources: written to the shared folder and read back ---------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/lodefield-{name}-{uuid.uuid4().hex}"


@query("export_sets", sql(f"select sample_id, {rnd('x', 'y', 'depth', 'grade')}, _set from labelled where _set = 'Test'", "labelled"))
def _(spark, sf):
    """Both sets written partitioned; one set read back from its own folder."""
    path = _folder(spark, "sets")
    sinks.export_sets(V.labelled(spark, sf), path)
    return spark.read.parquet(path).filter("_set = 'Test'").select("sample_id", "x", "y", "depth", "grade", "_set")


@query("export_predictions", sql(f"select sample_id, {rnd('grade', 'kriging_pred')} from predicted", "predicted"))
def _(spark, sf):
    path = _folder(spark, "predictions")
    sinks.export_predictions(V.predicted(spark, sf).select("sample_id", "grade", "kriging_pred"), path)
    return spark.read.csv(path, header=True, schema="sample_id string, grade double, kriging_pred double")


@query("export_summary", sql(_METRICS, "predicted"))
def _(spark, sf):
    path = _folder(spark, "summary")
    df = _predicted_once(spark, sf, "grade", *PREDICTIONS)
    sinks.export_summary(metrics.evaluate(df, list(PREDICTIONS)), fusion.fit_fusion(df, _THREE).frame(spark), path)
    return spark.read.json(f"{path}/metrics_json", schema="model string, n bigint, mae double, rmse double, r2 double, evs double, mape double, bias double")


@query("export_trials")
def _(spark, sf):
    path = _folder(spark, "trials")
    train, _ = _sets(spark, sf)
    trials = search.search_variogram(train)
    sinks.export_trials(trials, search.search_stats(trials), path)
    return spark.read.csv(f"{path}/trials", header=True, schema=trials.schema)


@query("read_surface", sql(f"select {rnd('x', 'y', 'z')} from surface", "surface"))
def _(spark, sf):
    path = _folder(spark, "surface")
    V.surface(spark, sf).write.csv(path, header=True)
    return tables.read_surface(spark, path)


@query("read_tables", sql(f"""
    select i.interval_id, i.hole_id, {rnd('e', 'n', 'd_from', 'd_to', 'grade')} from intervals i join collars c on i.hole_id = c.hole_id
    where d_to > d_from and grade is not null""", "intervals", "collars"))
def _(spark, sf):
    """Collars and intervals written as CSV and read with their fixed schemas."""
    where, what = _folder(spark, "collars"), _folder(spark, "intervals")
    V.collars(spark, sf).select("hole_id", "e", "n", "line_no").write.csv(where, header=True)
    V.intervals(spark, sf).select("hole_id", "d_from", "d_to", "grade", "interval_id").write.csv(what, header=True)
    collars = tables.read_collars(spark, where, attributes=("line_no",))
    parsed = samples.non_empty(samples.parse_intervals(tables.read_intervals(spark, what, keys=("interval_id",))))
    joined = samples.join_collars(parsed, collars)
    return joined.select("interval_id", F.col("hole_id").cast("bigint").alias("hole_id"), "e", "n", "d_from", "d_to", "grade")


# --- estimation: no SQL form; checked by properties in the tests ---------------------------

# Smaller systems than the default of 3,000 points keep the block solves short.
_SYSTEM = 600
_TREES = trees.TreeParams(n_trees=20, depth=5, step=0.2)
_SMALL_TREES = trees.TreeParams(n_trees=10, depth=4, step=0.2)
_MODEL = variogram.Variogram("spherical", 150.0, 60.0, 2.0)


def _sets(spark, sf):
    """Training and test rows from one staged table, which the fits below scan repeatedly."""
    return split.train_test(staged(V.labelled(spark, sf), "labelled"))


def _modelling(spark, sf):
    """Training and test rows with scaled features fitted on the training rows."""
    train, test = _sets(spark, sf)
    params = fit_features(train)
    return apply_features(train, params), apply_features(test, params), params.features


@query("pca", digits=3)
def _(spark, sf):
    df = V.featured(spark, sf)
    return apply_components(df, fit_components(df, _BASE)).select("sample_id", *[f"PC{i}" for i in range(1, 6)])


@query("variogram_fit")
def _(spark, sf):
    fitted, error = variogram.fit_variogram(variogram.lag_table(V.cleaned(spark, sf), _LAG, _LAGS, _FIT_CELL))
    return spark.createDataFrame([(fitted.model, fitted.range, fitted.sill, fitted.nugget, error)],
                                 "model string, range double, sill double, nugget double, error double")


@query("kriging")
def _(spark, sf):
    train, test = _sets(spark, sf)
    out = kriging.krige_blocks(train, test.select("sample_id", "x", "y", "depth", "grade"), _MODEL, "auto", _SYSTEM)
    return out.select("sample_id", "block_id", "grade", "kriging_pred", "kriging_pred_status")


@query("kriging_fast")
def _(spark, sf):
    """One system on the 3,000-point subsample; targets are scored in place."""
    train, test = _sets(spark, sf)
    system = kriging.fit_global(train, _MODEL)
    return kriging.apply_global(test.select("sample_id", "x", "y", "depth", "grade"), system).drop("kriging_pred_var")


@query("kriging_2d")
def _(spark, sf):
    """All places in one system while they fit it, else in cells."""
    train, test = _sets(spark, sf)
    test = test.select("sample_id", "x", "y", "depth", "grade")
    return kriging.krige_blocks(train, test, _MODEL, (1, 1, 1), dims=2, variance=True).drop("block_id")


@query("kriging_out_of_fold")
def _(spark, sf):
    out = kriging.krige_out_of_fold(V.cleaned(spark, sf).select("sample_id", "x", "y", "depth", "grade"), _MODEL, n_max=1500)
    return out.drop("kriging_pred_var")


@query("variogram_search")
def _(spark, sf):
    train, _ = _sets(spark, sf)
    return search.search_variogram(train)


@query("regression_kriging")
def _(spark, sf):
    train, test, features = _modelling(spark, sf)
    model = trees.fit_trees(train, features, params=_TREES)
    train, test = (trees.score_trees(df, model, features, "ml_pred").select("sample_id", "x", "y", "depth", "grade", "ml_pred") for df in (train, test))
    residual = train.withColumn("_r", F.col("grade") - F.col("ml_pred"))
    v, _ = variogram.fit_variogram(variogram.lag_table(residual, _LAG, _LAGS, _FIT_CELL, "_r"), ("spherical",))
    out = kriging.regression_kriging(train, test, v, blocks="auto", n_max=_SYSTEM)
    return out.select("sample_id", "grade", "ml_pred", "residual_pred", "rk_pred", "residual_pred_status")


@query("trees")
def _(spark, sf):
    train, test, features = _modelling(spark, sf)
    return trees.score_trees(test, trees.fit_trees(train, features, params=_TREES), features, "xgb_pred").select("sample_id", "grade", "xgb_pred")


@query("grid")
def _(spark, sf):
    """All 108 combinations of the full grid, as 36 fits of 400 trees."""
    train, _, features = _modelling(spark, sf)
    return trees.grid_search(train, features)[0]


@query("clusters")
def _(spark, sf):
    df = V.cleaned(spark, sf)
    return trees.assign_clusters(df, trees.fit_clusters(df)).select("sample_id", "cluster")


@query("hybrid")
def _(spark, sf):
    """Kriging moves the points only; their features are row-wise and are made where they are used."""
    train, test = _sets(spark, sf)
    params = fit_features(train)
    points = ["sample_id", "x", "y", "depth", "grade"]
    known, kriged = kriging.krige_with_held_out(train.select(points), test.select(points), _MODEL, n_max=_SYSTEM)
    clusters = trees.fit_clusters(train)
    known = known.withColumn("residual", F.col("grade") - F.col("kriging_pred")).filter("residual is not null")
    residual = trees.assign_clusters(apply_features(known, params), clusters)
    local = trees.fit_cluster_models(residual, params.features, params=_SMALL_TREES)
    hybrid = trees.predict_hybrid(apply_features(kriged, params), clusters, local, params.features)
    return hybrid.select("sample_id", "grade", "cluster", "kriging_pred", "hybrid_pred")


@query("stack")
def _(spark, sf):
    df = _predicted_once(spark, sf, "sample_id", *_NAMES)
    stack = fusion.fit_stack(df, _THREE)
    return fusion.apply_stack(df, stack, _THREE).select("sample_id", "grade", "fusion_pred")


@query("importance")
def _(spark, sf):
    train, _, features = _modelling(spark, sf)
    return explain.feature_importance(spark, trees.fit_trees(train, features, params=_TREES), features)


@query("learning_curve")
def _(spark, sf):
    train, _, features = _modelling(spark, sf)
    return explain.learning_curve(train, features, params=_SMALL_TREES)


@query("pdp")
def _(spark, sf):
    train, test, features = _modelling(spark, sf)
    return explain.partial_dependence(test, trees.fit_trees(train, features, params=_SMALL_TREES), features, points=20)


@query("shapley")
def _(spark, sf):
    train, test, features = _modelling(spark, sf)
    return explain.shapley(test, trees.fit_trees(train, features, params=_SMALL_TREES), features, background=train)
