"""Generated tags and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_tags(spark: SparkSession, start: int, total: int, step: int = 1) -> DataFrame:
    return spark.range(0, total).select((F.lit(start) + F.col("id") * step).alias("tag_id"))


def generate_samples(spark: SparkSession, tags: int, samples_per_tag: int, first_tag: int = 0, start: int = 0) -> DataFrame:
    """samples_per_tag samples a second apart for each tag; n_value is the sample's time."""
    rows = spark.range(0, tags * samples_per_tag)
    time = F.lit(start) + (F.col("id") % samples_per_tag) * 1000
    return rows.select((F.lit(first_tag) + F.floor(F.col("id") / samples_per_tag)).cast("long").alias("tag_id"), time.alias("sample_time"), time.cast("double").alias("n_value"), F.lit(None).cast("string").alias("o_value"), F.col("id").alias("ingest_seq"))


def generate_mock(spark: SparkSession, path: str, tags: int = 5, samples_per_tag: int = 86_400) -> DataFrame:
    i = F.col("id")
    return spark.range(0, tags * samples_per_tag).select(i.alias("sample_time"), i.alias("insert_time"), i.cast("double").alias("n_value"), F.lit(None).cast("string").alias("o_value"), F.concat(F.lit("Tag"), (i - i % samples_per_tag).cast("string"), F.lit("-"), F.lit(path)).alias("tag"))
