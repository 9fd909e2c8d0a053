"""The queries opN_ and pipeline: thin readers that apply one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, language, licenses, linededup, lmscore, mixing, neardup, secrets, toxicity
from .kernels import remainder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train_toxicity(docs.where(~F.col("held_out")), labels)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_bloom_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    return lmscore.score_texts(docs)


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op5_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(documents(spark, sf_dir), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir).select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    one = lambda b: F.concat_ws(":", b["line"].cast("string"), b["label"], F.round(b["containment"], 4).cast("string"))
    return found.withColumn("blocks", F.coalesce(F.array_join(F.transform("blocks", one), ","), F.lit("")))


def op9_spectrum_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = language.train_language(docs.where(~F.col("held_out")))
    return language.predict_language(docs.select("doc_id", "held_out", "text"), model)


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in two pushes, so the second meets blobs that the ledger has."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return secrets.scan_history([docs.where(~second), docs.where(second)], secrets.SecretLedger(spark))


def token_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can express."""
    found = op2_bloom_lm_score(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_pareto_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES = {f.__name__: f for f in (op1_subsequence_toxicity, op2_bloom_lm_score, op3_pareto_mix, op4_fuzzy_lines, op5_setsketch_neardup, op6_template_decontamination, op7_merkle_fingerprints, op8_license_scan, op9_spectrum_language, op10_secret_ledger, token_base_scores, mix_targets)}
