"""Statistics of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GridConfig
from ..functions.grid import with_cells


def cell_stats(df: DataFrame, config: GridConfig = GridConfig()) -> DataFrame:
    """(tag_bucket, time_bucket, samples, birth, last_write)."""
    return with_cells(df, config).groupBy("tag_bucket", "time_bucket").agg(F.count("*").alias("samples"), F.min("insert_time").alias("birth"), F.max("insert_time").alias("last_write"))


def live_cells(df: DataFrame, now: int, ttl: int, config: GridConfig = GridConfig()) -> DataFrame:
    """Cells whose birth is at most ttl before now."""
    return cell_stats(df, config).where(F.lit(now) - F.col("birth") <= ttl)
