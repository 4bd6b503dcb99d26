"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versekit.llm import audit, dialogue, forest, lengths, packing, passages, quality, sharding, suffixes, templates, toxicity, urls, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 24
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SEQUENCE_TOKENS = 2048


def op1_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_classes(table(spark, sf_dir, "documents"))


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(table(spark, sf_dir, "documents"))


def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("alias_class")


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest.near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_column_wise_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), SEQUENCE_TOKENS)


def op9_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_and_read(table(spark, sf_dir, "documents"))


def op10_template_canonicalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repairs(dialogue.damage(table(spark, sf_dir, "conversations")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_kneser_ney_bands, op2_histogram_sort, op3_collinear_chaining, op4_length_histogram, op5_redirect_equivalence, op6_lsh_forest, op7_column_wise_suffixes, op8_best_two_fit, op9_wavelet_matrix,
                                   op10_template_canonicalisation, op11_compression_distance, op12_edit_lattice, op13_filter_audit)}

ORACLES: dict[str, str] = {"op5_redirect_equivalence": urls.ORACLE.format(rules=", ".join(str(r) for r in URL_RULES)), "op13_filter_audit": audit.ORACLE}
