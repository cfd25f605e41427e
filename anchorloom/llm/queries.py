"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.llm import common, oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import personal_data as pd

    made = pd.spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"cast(size(filter(_pii_spans, x -> x.k = {k})) as bigint)").alias(f"n_{pd.KINDS[k]}")
    return made.select(
        "doc_id", *map(count, range(len(pd.BASE))), F.sha2(pd.named(base=True).cast("binary"), 256).alias("base_sha256"), pd.named(base=False).alias("spans"),
        *map(count, range(len(pd.BASE), len(pd.KINDS))), F.size("_pii_spans").cast("long").alias("n_spans"),
    )


def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import near_join

    return near_join.join(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import mixing

    return mixing.summary(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import substring_dedup

    made = substring_dedup.remove(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import quality_rules

    made = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import language_model as lm

    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(~lm.held_out()))
    made = lm.score(docs, model)
    return made.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import token_files

    to = common.scratch(spark)
    read = token_files.read(spark, to, token_files.write(table(spark, sf_dir, "documents"), to))
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import packing

    made = packing.pack(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import quality_model

    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import vector_dedup

    return vector_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import merkle

    a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = merkle.leaf(text=F.translate("text", a_to_z, a_to_z.lower()))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered).otherwise(merkle.leaf())
    made = merkle.manifest(table(spark, sf_dir, "documents"), {"tampered": tampered})
    made = made.withColumn("folded_root", merkle.folded(F.col("tampered"), F.col("proof")))
    return made.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import importance

    made = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


def op13_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorloom.llm import word_table

    made = word_table.decode(word_table.encode(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_near_join": op2_near_join,
    "op3_source_mix": op3_source_mix,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_model": op6_language_model,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_quality_model": op9_quality_model,
    "op10_vector_dedup": op10_vector_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_importance": op12_importance,
    "op13_word_table": op13_word_table,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_join": oracles.NEAR_JOIN,
    "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op10_vector_dedup": oracles.VECTOR_DEDUP,
    "op11_merkle_manifest": oracles.MERKLE,
    "op12_importance": oracles.IMPORTANCE,
}
