"""Collars, intervals and a surface derived from the test tables.

The select lists run unchanged in Spark SQL and in ANSI SQL.  They plant the edge
cases (orphan, empty, missing and outlying intervals) by CASE, so every row of the
source tables is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.functions.keyed import keyed_uniform
from lodefield.operators.clean import BASE_FEATURES, engineer_features, remove_outliers
from lodefield.operators.samples import POINT_COLUMNS, build_samples
from lodefield.operators.split import split_exact
from lodefield.sources.staging import staged
from lodefield.sources.tables import spread_scan

COLLARS = {
    "hole_id": "s_suppkey",
    "e": "cast(1000 + 137 * (s_suppkey % 37) as double)",
    "n": "cast(2000 + 91 * (s_suppkey % 53) as double)",
    "line_no": "concat('L', cast(s_suppkey % 7 as varchar(10)))",
}

_START = "cast((l_orderkey % 100) * 5 + l_linenumber as double)"
INTERVALS = {
    # Every 73rd order's intervals belong to a hole without a collar.
    "hole_id": "case when l_orderkey % 73 = 0 then -l_suppkey - 1 else l_suppkey end",
    "interval_id": "concat_ws('-', cast(l_orderkey as varchar(20)), cast(l_partkey as varchar(20)), cast(l_suppkey as varchar(20)), "
    "cast(l_linenumber as varchar(20)), cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)))",
    "d_from": _START,
    "d_to": f"{_START} + case when l_orderkey % 83 = 0 then 0 else l_quantity / 5 end",
    "grade": "case when l_orderkey % 89 = 0 then null else cast(15 as double) + l_extendedprice / 3999"
    f" + cast(137 * (l_suppkey % 37) as double) / 400 + {_START} / 60 + case when l_orderkey % 97 = 0 then 90 else 0 end end",
    "lith": "concat(l_returnflag, l_linestatus)",
}

SURFACE = {
    "x": "cast(1060 + 137 * (s_suppkey % 37) as double)",
    "y": "cast(1960 + 91 * (s_suppkey % 53) as double)",
    "z": "cast(s_suppkey % 11 as double)",
}

# Stand-in predictions: arithmetic on the grade and keyed uniforms.
PREDICTIONS = ("kriging_pred", "xgb_pred", "hybrid_pred", "fusion_pred")


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} as {name}" for name, expr in columns.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{expr} as {alias}" for alias, expr in columns.items()])


def collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supplier", COLLARS)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
    scan = spread_scan(table(spark, sf_dir, "lineitem").select(*columns), "l_orderkey", "l_linenumber")
    return scan.selectExpr(*[f"{expr} as {name}" for name, expr in INTERVALS.items()])


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supplier", SURFACE)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_samples(collars(spark, sf_dir), intervals(spark, sf_dir), keep=("lith",))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples inside the fences; they are made once, because the fences and what follows them scan them repeatedly."""
    return remove_outliers(staged(samples(spark, sf_dir), "samples"), list(POINT_COLUMNS))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineer_features(cleaned(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_exact(cleaned(spark, sf_dir))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaned(spark, sf_dir)
    noise = {i: keyed_uniform(i, "sample_id") - 0.5 for i in (1, 2, 3)}
    g = F.col("grade")
    return df.withColumns({
        "kriging_pred": g + 6 * noise[1],
        "xgb_pred": 0.9 * g + 3.5 + 4 * noise[2],
        "hybrid_pred": 0.97 * g + 1 + 3 * noise[3],
    }).withColumn("fusion_pred", 0.5 * (F.col("xgb_pred") + F.col("hybrid_pred")))


# --- the same chain in SQL, for the oracles ---------------------------------------

def sql_hash(seed: str, *keys: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 15) as bigint)"


def sql_uniform(seed: str, *keys: str) -> str:
    bits = f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8) as bigint)"
    return f"((cast({bits} as double) + 0.5) / cast(4294967296 as double))"


def _fence(c: str) -> str:
    return (f"abs(({c} - m_{c}) / (s_{c} + 1e-9)) <= 4 and {c} between qa_{c} - 1.5 * (qb_{c} - qa_{c}) "
            f"and qb_{c} + 1.5 * (qb_{c} - qa_{c})")


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "collars": ((), f"select {select_list(COLLARS)} from supplier"),
    "intervals": ((), f"select {select_list(INTERVALS)} from lineitem"),
    "surface": ((), f"select {select_list(SURFACE)} from supplier"),
    "samples": (("collars", "intervals"), """
        select c.e as x, c.n as y,
               -(d_from + case when k = 1 then cast(0 as double) else t.i * (d_to - d_from) / (k - 1) end) + 0.0 as depth,
               grade, hole_id, lith, interval_id || ':' || cast(t.i as varchar) as sample_id
        from (select *, greatest(1, cast(floor((d_to - d_from) / 2.0) as bigint)) as k
              from intervals where d_to > d_from and grade is not null) v
        join collars c using (hole_id), unnest(range(k)) as t(i)"""),
    "clean_stats": (("samples",), "select " + ", ".join(
        f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}, quantile_cont({c}, 0.25) as qa_{c}, quantile_cont({c}, 0.75) as qb_{c}"
        for c in POINT_COLUMNS) + " from samples"),
    "cleaned": (("clean_stats",), "select s.* from samples s, clean_stats where " + " and ".join(_fence(c) for c in POINT_COLUMNS)),
    "featured": (("cleaned",), """
        select *, sqrt(x * x + y * y) as r, x * y as xy, depth * depth as depth2, sqrt(x * x + y * y) * sqrt(x * x + y * y) as r2,
               (depth - (select min(depth) from cleaned))
               / greatest((select max(depth) from cleaned) - (select min(depth) from cleaned), 1e-9) as depth_norm
        from cleaned"""),
    "labelled": (("cleaned",), f"""
        select *, case when row_number() over (order by {sql_hash('42p', 'sample_id')}, sample_id)
                         <= ceil(cast(0.3 as double) * (select count(*) from cleaned)) then 'Test' else 'Train' end as _set
        from cleaned"""),
    "predicted": (("cleaned",), f"""
        select *, 0.5 * (xgb_pred + hybrid_pred) as fusion_pred from (
          select *, grade + 6 * ({sql_uniform('1', 'sample_id')} - 0.5) as kriging_pred,
                 0.9 * grade + 3.5 + 4 * ({sql_uniform('2', 'sample_id')} - 0.5) as xgb_pred,
                 0.97 * grade + 1 + 3 * ({sql_uniform('3', 'sample_id')} - 0.5) as hybrid_pred
          from cleaned)"""),
}


def sql(body: str, *names: str) -> str:
    """``body`` behind the CTEs it names and those they need; a leading comma adds CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _CTES[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "with " + ", ".join(f"{n} as ({_CTES[n][1]})" for n in ordered) + " " + body


FEATURES_SC = [f"{c}_sc" for c in BASE_FEATURES]
