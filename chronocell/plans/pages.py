"""Decomposition of a query into time pages and tag pages, step order, and read plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GridConfig, PageConfig, check_range
from ..functions.grid import bucket, cell_id, connection_path, read_affinity


def time_pages(spark: SparkSession, start: int, end: int, step: int, config: GridConfig = GridConfig()) -> DataFrame:
    """(page, page_start, page_end): pages from `start` on, no longer than a cell, the last one cut off."""
    check_range(start, end, step)
    step = min(step, config.time_width)
    at = spark.range(start, end, step).select(F.col("id").alias("page_start"), F.least(F.col("id") + step, F.lit(end)).alias("page_end"))
    return at.select(((F.col("page_start") - start) / step).cast("long").alias("page"), "page_start", "page_end")


def tag_pages(tags: DataFrame, step: int, config: GridConfig = GridConfig()) -> DataFrame:
    """tags: (tag_id) -> (tag_page, tags): distinct tags by bucket of at most a cell's width, in ascending order."""
    step = min(step, config.tag_width)
    return tags.groupBy(bucket(F.col("tag_id"), step).alias("tag_page")).agg(F.sort_array(F.collect_set("tag_id")).alias("tags"))


def time_first(time: list, tags: list) -> Iterator[tuple]:
    """All time pages of the first tag page, then of the next."""
    for t in tags:
        for p in time:
            yield p, t


def steps(time: list, tags: list, director: Callable = time_first) -> Iterator[tuple]:
    """The (time page, tag page) steps in the order that a director gives."""
    if time and tags:
        yield from director(time, tags)


def next_steps(time: list, tags: list, director: Callable) -> Iterator[tuple]:
    """The steps of a director that is asked for one at a time.

    director(time pages, tag pages, previous time page or None, previous tag page or None) -> (time page, tag page), or
    None at the end. It may keep to the pages or make up others, repeat or leave out any.
    """
    at = director(time, tags, None, None) if time and tags else None
    while at is not None:
        yield at
        at = director(time, tags, *at)


def step_order(time: DataFrame, tags: DataFrame) -> DataFrame:
    """(step, page, tag_page) of the time-first order: a tag page's place among tag pages, times the time pages, plus the time page."""
    n = time.count()
    place = F.row_number().over(Window.orderBy("tag_page")) - 1  # over the tag pages of one query, at most one for each tag asked for
    ranked = tags.select("tag_page").distinct().withColumn("nth", place)
    each = ranked.select("tag_page", "nth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("page"))
    return each.select((F.col("nth") * n + F.col("page")).cast("long").alias("step"), "page", "tag_page")


def plan_range(time: DataFrame, tags: DataFrame, config: GridConfig = GridConfig(), pages: PageConfig = PageConfig()) -> DataFrame:
    """Cells that a query touches: one row per cell with its path, worker, tags asked for and time range."""
    w = config.time_width
    cells = time.select(F.explode(F.sequence(bucket(F.col("page_start"), w), bucket(F.col("page_end") - 1, w), F.lit(w))).alias("time_bucket"), "page_start", "page_end")
    cells = cells.groupBy("time_bucket").agg(F.min("page_start").alias("range_start"), F.max("page_end").alias("range_end"))
    wanted = tags.select("tag_id").distinct().groupBy(bucket(F.col("tag_id"), config.tag_width).alias("tag_bucket")).agg(F.count("*").alias("n_tags"))
    span = time.agg(F.min("page_start"), F.max("page_end")).first()
    over = F.explode(F.sequence(F.lit(span[0] - span[0] % w), F.lit((span[1] - 1) - (span[1] - 1) % w), F.lit(w))).alias("time_bucket")
    spread = wanted.select("tag_bucket", "n_tags", over).join(cells, "time_bucket")
    tag, at = F.col("tag_bucket"), F.col("time_bucket")
    return spread.select(cell_id(tag, at, config).alias("cell"), connection_path(tag, at, config).alias("path"), read_affinity(cell_id(tag, at, config), config.workers).alias("worker"), "n_tags", F.greatest("range_start", "time_bucket").alias("range_start"), F.least("range_end", F.col("time_bucket") + w).alias("range_end"))
