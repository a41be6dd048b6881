"""Exact deduplication with a stateful stream.

Arriving rows are reduced to a digest of the normalised text (A-Z lower-cased), a stable
identifier and a content locator (the row number in the written table).  A streaming
aggregation keyed by digest keeps, on disk (RocksDB) and without expiry, the identifier and
locator of the row that stays and the number of rows seen.  The state is then read back
as a table.  The full texts of rows that hit one digest are compared, as the least and greatest text of the
digest; where their bytes differ, the rows of that digest are grouped by text instead.

Only DataFrame and SQL functions run on the executors.

Defined results: null text counts as empty; a null identifier is smaller than any other; of rows that
repeat both identifier and text, one stays (that with the largest locator); an empty table
gives an empty result; further columns are carried along and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefield.llm.common import lower_ascii, new_folder, settings, table

# Settings of the state store.
_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk space set aside
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def observe(stream: DataFrame, state: str) -> None:
    """Take every row that has arrived on ``stream`` (``digest, id, row``) into the state at ``state``.

    Call it again with the same folder for rows that arrive later.
    """
    keyed = stream.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    with settings(stream.sparkSession, _STATE_SETTINGS):
        query = (
            keyed.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", state).start()
        )
        query.awaitTermination()


def known(spark: SparkSession, state: str) -> DataFrame:
    """The state as a table: ``digest, keep_id, keep_row, group_size``, a row per digest."""
    with settings(spark, _STATE_SETTINGS):
        kept = spark.read.format("statestore").load(state)
        stays, rows = (f"value.`{name}`" for name in kept.schema["value"].dataType.names)
        return kept.select(
            F.col("key.digest").alias("digest"), F.col(f"{stays}.id").alias("keep_id"),
            F.col(f"{stays}.row").alias("keep_row"), F.col(rows).alias("group_size"))


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """Written rows and decisions of a whole table.

    The rows are ``row``, ``digest`` and ``doc`` (a struct of the columns of ``docs``).  The decisions have
    a line per row: ``row, id, keep_id, keep_row, group_size, kept, digest``.
    """
    spark = docs.sparkSession
    rows_at, state = new_folder(spark, "exact-rows"), new_folder(spark, "exact-state")
    docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
        digest(lower_ascii(F.col(text_col))).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    ).write.parquet(rows_at)
    rows = spark.read.parquet(rows_at)
    narrow = T.StructType([rows.schema[c] for c in ("digest", "id", "row")])
    observe(spark.readStream.schema(narrow).option("maxFilesPerTrigger", files_per_batch).parquet(rows_at), state)
    held_at = new_folder(spark, "exact-known")
    known(spark, state).write.parquet(held_at)
    held = spark.read.parquet(held_at)

    decided = rows.select("row", "id", "digest").join(held, "digest")
    text = lower_ascii(F.col(f"doc.`{text_col}`")).alias("text")
    # Map tasks keep the least and greatest text of a digest; equal ones mean that all its texts have the same bytes.
    unlike_at = new_folder(spark, "exact-unlike")
    (
        rows.select("digest", text).groupBy("digest")
        .agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
        .filter("least <> greatest").select("digest").write.parquet(unlike_at)
    )
    unlike = spark.read.parquet(unlike_at)
    if unlike.isEmpty():
        return rows, decided.withColumn("kept", F.col("row") == F.col("keep_row"))
    # Different texts under one digest: group those few rows by their text.
    again = rows.select("row", "id", "digest", text).join(unlike, "digest", "left_semi")
    groups = again.groupBy("digest", "text").agg(
        F.max(F.struct("id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    regrouped = again.join(groups, ["digest", "text"]).select(
        "digest", "row", "id", F.col("stays.id").alias("keep_id"), F.col("stays.row").alias("keep_row"), "group_size")
    whole = decided.join(unlike, "digest", "left_anti").unionByName(regrouped)
    return rows, whole.withColumn("kept", F.col("row") == F.col("keep_row"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    rows, decided = deduplicate(docs, id_col, text_col)
    dropped = decided.filter(~F.col("kept")).select("row")
    return rows.join(dropped, "row", "left_anti").select("doc.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    _, decided = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decided.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
with d as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""
