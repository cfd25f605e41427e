"""The corpus pipeline: quality rules, n-gram Jaccard join, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes what a stage returns to
the shared folder and rereads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.llm import common, mixing, near_join, packing, personal_data, quality_rules


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.rows_kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id."""
    return near_join.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    out = personal_data.mask(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens, with their ids (little-endian, 4 bytes each)."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("near_join", near), ("personal_data", private), ("source_mix", mix), ("packing", pack)]
#: Tokenizing and EM are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        made = common.written(stage(spark, docs, sf_dir))
        common.forget(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
