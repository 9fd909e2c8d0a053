"""Placement functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GridConfig

MASK = 0xFFFFFFFF


def bucket(x: Column, width: int) -> Column:
    """The start of x's bucket, truncating toward zero."""
    return x - x % F.lit(width)


def cell_id(tag_bucket: Column, time_bucket: Column, config: GridConfig = GridConfig()) -> Column:
    return F.concat_ws(config.separator, F.lit(config.prefix), tag_bucket.cast("string"), time_bucket.cast("string"))


def code_units(s: Column) -> Column:
    """UTF-16 code units of a string as longs; the empty string has none."""
    points = F.when(F.length(s) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long")))
    pair = lambda c: F.array((c - 0x10000) / 1024 + 0xD800, (c - 0x10000) % 1024 + 0xDC00)
    return F.flatten(F.transform(points, lambda c: F.when(c < 0x10000, F.array(c)).otherwise(F.transform(pair(c), lambda x: F.floor(x).cast("long")))))


def djb2(s: Column) -> Column:
    """hash = hash * 33 + unit over UTF-16 units from 5381, modulo 2^32."""
    return F.aggregate(code_units(s), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(MASK)))


def disk_index(tag_bucket: Column, disks: int) -> Column:
    return F.pmod(tag_bucket, F.lit(disks))


def disk_path(tag_bucket: Column, config: GridConfig) -> Column:
    names = F.array(*[F.lit(d) for d in config.disks])
    return F.get(names, disk_index(tag_bucket, len(config.disks)).cast("int"))


def connection_path(tag_bucket: Column, time_bucket: Column, config: GridConfig = GridConfig()) -> Column:
    return F.concat_ws("/", F.lit(config.shard_set), disk_path(tag_bucket, config), cell_id(tag_bucket, time_bucket, config))


def write_affinity(path: Column, workers: int) -> Column:
    return F.pmod(djb2(path), F.lit(workers))


def read_affinity(cell: Column, workers: int) -> Column:
    return F.pmod(djb2(cell), F.lit(workers))


def displaced(sample_time: Column, insert_time: Column, config: GridConfig = GridConfig()) -> Column:
    """Whether a sample's bucket lies outside its insert bucket and `tolerance` buckets on either side."""
    w = config.time_width
    return F.abs(bucket(sample_time, w) - bucket(insert_time, w)) > config.tolerance * w


def with_cells(df: DataFrame, config: GridConfig = GridConfig()) -> DataFrame:
    return df.withColumns({"tag_bucket": bucket(F.col("tag_id"), config.tag_width), "time_bucket": bucket(F.col("sample_time"), config.time_width)})


def displacement_links(df: DataFrame, config: GridConfig = GridConfig()) -> DataFrame:
    """Distinct (record_cell, insert_cell) of samples that arrived far from their time."""
    tag, time, ins = bucket(F.col("tag_id"), config.tag_width), bucket(F.col("sample_time"), config.time_width), bucket(F.col("insert_time"), config.time_width)
    return df.where(displaced(F.col("sample_time"), F.col("insert_time"), config)).select(cell_id(tag, time, config).alias("record_cell"), cell_id(tag, ins, config).alias("insert_cell")).distinct()


def tolerance_cells(df: DataFrame, config: GridConfig = GridConfig()) -> DataFrame:
    """(tag_bucket, time_bucket) -> the cell and its neighbours within the tolerance, by time."""
    steps = F.array(*[F.lit(i * config.time_width).cast("long") for i in range(-config.tolerance, config.tolerance + 1)])
    near = df.select("tag_bucket", "time_bucket", F.explode(steps).alias("step"))
    return near.select("tag_bucket", "time_bucket", (F.col("time_bucket") + F.col("step")).alias("near_bucket"))
