"""Streaming ingestion into the grid, the grid as a stream, and tumbling windows with a watermark."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import GridConfig
from ..schema import SAMPLE_SCHEMA
from ..sources.storage import Files
from ..sources.store import PLACED, store


def batch_time(spark: SparkSession, checkpoint: str, batch: int) -> int:
    """The insert time of a micro-batch: now when it first comes, and the same when it is replayed."""
    files, name = Files(spark, checkpoint), f"insert-times/{batch}.json"
    if not files.exists(name):
        files.mkdirs("insert-times")
        files.write(name, {"insert_time": int(time.time() * 1000)})
    return files.read(name)["insert_time"]


def stream_into(samples: DataFrame, base: str, checkpoint: str, config: GridConfig | None = None, insert_time_of: Callable[[int], int] | None = None) -> StreamingQuery:
    """Each micro-batch becomes one version, inserted now unless insert_time_of(batch) says otherwise.

    The insert time of a batch is kept with the checkpoint, so a replay writes the same versions again and reads don't change.
    """
    spark = samples.sparkSession
    stamp = insert_time_of or (lambda batch: batch_time(spark, checkpoint, batch))

    def write(df: DataFrame, batch: int) -> None:
        if not df.isEmpty():
            store(df, base, stamp(batch), config)

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(spark: SparkSession, base: str) -> DataFrame:
    """The samples of a base as a stream: all versions there are, then those of every new write."""
    return spark.readStream.schema(PLACED).parquet(base).select(*SAMPLE_SCHEMA.names)


def windowed(samples: DataFrame, width_ms: int, late: str = "1 day") -> DataFrame:
    """Mean and count per tag and tumbling window of a stream of samples."""
    timed = samples.withColumn("ts", F.timestamp_millis("sample_time")).withWatermark("ts", late)
    return timed.groupBy("tag_id", F.window("ts", f"{width_ms} milliseconds")).agg(F.avg("n_value").alias("mean"), F.count("*").alias("samples"))
