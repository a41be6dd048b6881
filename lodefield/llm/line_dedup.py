"""Removal of lines that spread over many sites.

Every line is hashed; a HyperLogLog sketch of the sites is kept per line hash and merged by the
aggregation, also within a map task, so a line of a third of all rows is no hot group.  Lines whose estimate
is clearly above the threshold are boilerplate; for those near it the distinct sites are
counted exactly.  Boilerplate lines are then taken out of all texts.

Near is within six standard errors of the sketch, and one site at least.  At a threshold of a few sites, such
as the query's, sketches are practically exact.  At one of several hundred a line is decided by its
estimate alone only if that is off by more than six standard errors, which for normal errors is about two lines in a
thousand million; those can get the wrong decision.

A line is what lies between line feeds, without blanks, tabs and carriage returns at its ends; blank lines
never count.  Lines are told apart by their 128-bit hash.

Defined results: null text stays null and has no lines; a null site is no site; repeated rows are treated alike;
all columns are kept, ``n_lines``, ``n_removed`` and ``clean_text`` are added (columns of these names are
replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.llm.common import new_folder, private, table

MIN_SITES = 8
LG_K = 12


def _line_key(line: Column) -> Column:
    return F.unhex(F.md5(_bare(line)))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _margin(min_sites: int, lg_k: int) -> int:
    """Sites around the threshold within which lines are counted exactly."""
    return max(1, math.ceil(6 * 1.04 / math.sqrt(2**lg_k) * min_sites))


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``line_key`` of every line on at least ``min_sites`` sites, written to the shared folder."""
    spark = docs.sparkSession
    lines = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(F.split(text_col, "\n")).alias("line"))
    lines = lines.filter((_bare(F.col("line")) != "") & F.col("site").isNotNull()).select("site", _line_key(F.col("line")).alias("line_key"))
    margin = _margin(min_sites, lg_k)
    spread_at = new_folder(spark, "line-spread")
    (
        lines.groupBy("line_key").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
        .select("line_key", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites - margin).write.parquet(spread_at)
    )
    spread = spark.read.parquet(spread_at)
    near = spread.filter(F.col("sites") <= min_sites + margin).select("line_key")
    exact = lines.join(near, "line_key", "left_semi").groupBy("line_key", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("line_key").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("line_key")
    found_at = new_folder(spark, "line-boilerplate")
    spread.filter(F.col("sites") > min_sites + margin).select("line_key").unionByName(exact).write.parquet(found_at)
    return spark.read.parquet(found_at)


def remove_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` with ``n_lines`` (not blank), ``n_removed`` and ``clean_text``."""
    found = boilerplate(docs, site_col, text_col, min_sites, lg_k)
    key, gone = private(docs, "_text_key"), private(docs, "_gone")
    # Equal texts lose equal lines, so what goes is looked up by the hash of the text.
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col(text_col))))
    lines = keyed.select(key, F.explode(F.split(text_col, "\n")).alias("line")).select(key, _line_key(F.col("line")).alias("line_key"))
    hit = lines.join(found, "line_key").groupBy(key).agg(F.collect_set("line_key").alias(gone))
    # Written first, so that the join below is of plain tables and Spark can split the copies of one text over tasks.
    hit_at = new_folder(docs.sparkSession, "line-hits")
    hit.write.parquet(hit_at)
    hit = docs.sparkSession.read.parquet(hit_at)
    parts = F.split(text_col, "\n")
    counted = F.filter(parts, lambda x: _bare(x) != "")
    left = F.filter(parts, lambda x: ~F.array_contains(F.col(gone), _line_key(x)))
    return (
        keyed.join(hit, key, "left")
        .withColumn("n_lines", F.coalesce(F.size(counted), F.lit(0)))
        .withColumn("n_removed", F.when(F.col(gone).isNull(), 0).otherwise(F.size(parts) - F.size(left)))
        .withColumn("clean_text", F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
        .drop(key, gone)
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_removed, clean_chars, clean_sha256``."""
    clean = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return clean.select(
        "doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"),
        F.length("clean_text").cast("bigint").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))


OP2_SQL = r"""
with d as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
l as (select source, trim(unnest(ls), chr(32) || chr(9) || chr(13)) as line from d),
b as (select line from l where line <> '' group by line having count(distinct source) >= 8),
g as (select coalesce(list(line), []) as gone from b),
h as (select doc_id, len(list_filter(ls, lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '')) as n_lines, len(ls) as n_all, text,
             list_filter(ls, lambda x: not list_contains(gone, trim(x, chr(32) || chr(9) || chr(13)))) as rest from d, g)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_all - len(rest), 0)::bigint as n_removed,
       length(array_to_string(rest, chr(10)))::bigint as clean_chars, sha256(array_to_string(rest, chr(10))) as clean_sha256
from h
"""
