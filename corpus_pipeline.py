"""A cleaning pipeline over ``documents``: stages that each call one operator of ``lodefield.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodefield.llm import exact_dedup, ngram_join, packing, quality, toxicity
from lodefield.llm.common import new_folder, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is of good grade with a probability of at least 1/2 stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 1/2 stay."""
    return toxicity.keep_clean(docs, toxicity.learnable(table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles, the one with the smallest id stays."""
    return ngram_join.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a training sequence."""
    return packing.pack(docs)[1]


STAGES = [
    ("quality classifier", keep_good_quality),
    ("toxicity", keep_not_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: The classifiers and the packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
