"""A pipeline from documents to a mixed, clean corpus; its stages are written and read again one by one."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocell.llm import decontam, language, linededup, mixing, neardup
from chronocell.llm.common import cut, drop
from chronocell.llm.kernels import remainder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without text, have no language and go; all others stay as they are.

    The model learns from the documents with a lang. Null and repeated ids change nothing, rows that repeat all stay or
    go, texts that tie between languages stay, long texts are read whole, an empty table stays empty, and columns other
    than COLUMNS are left out before the operator could meet their names.
    """
    model = language.train_language(docs.where(remainder(F.col("doc_id"), 4) != 2))
    read = docs.select(*COLUMNS, F.col("text").alias("whole")).withColumnsRenamed({"text": "own_text", "whole": "text"})
    return language.predict_language(read, model).where("lang_pred <> 'und'").withColumnRenamed("own_text", "text").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike across documents the one with the least (doc_id, place) stays; documents left without text go.

    Null texts go; null ids come last, ties go by the text's hash, rows equal in id and text get the same result; n_chars
    is counted anew where lines went; an empty table stays empty, and columns other than COLUMNS are left out.
    """
    return linededup.dedup_lines(docs.select(*COLUMNS)).where("trim(text) <> ''").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8): the least by doc_id (nulls last) and text hash.

    Null and empty texts are alike with nothing and stay; of rows equal in id and text one stays; rows that share an id
    or have none but differ in text don't hide each other; an empty table stays empty; only COLUMNS are returned.
    """
    return neardup.drop_near_duplicates(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one asked again with other slots, go.

    Null and empty texts stay, rows equal in id and text get the same result, an empty table on either side changes
    nothing, long texts are read whole, and only COLUMNS are returned.
    """
    return decontam.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their words (size), the number of copies and the words these bring (taken).

    A null source is a source of its own, documents without words are not taken, ties of the rank go by doc_id and text
    hash, rows equal in id and text get the same number of copies, and an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    return mixing.apply_mix(docs, mixing.pareto_mix(docs))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: Kernel models, sketches and Pareto order hashes are beyond SQL; tests/llm/test_exact.py holds every stage, on what the
#: one before kept, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(*before)  # what the stage before wrote has been read for the last time
        before = [docs]
    return docs
