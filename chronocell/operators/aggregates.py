"""Map and reduce over pages, and the ready-made aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
RUN_ROWS = 10_000  # about as many rows of whole pages go to one call of a map over numbered pages; a larger page goes whole


def map_pages(df: DataFrame, page_map: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, rows_per_page: int | None = None) -> DataFrame:
    """Apply page_map to pages of rows; None or an empty page yields nothing and the next page goes on."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            step = rows_per_page or max(1, len(page))
            for i in range(0, len(page), step):
                out = page_map(page.iloc[i : i + step])
                if out is not None and len(out):
                    yield out

    return df.mapInPandas(run, schema)


def _placed(df: DataFrame, keys: list[str], order: list[str], rows_per_page: int) -> DataFrame:
    """Adds _place, the 0-based place of each row inside its keys, and page, the place's page."""
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return placed.withColumn("page", F.floor(F.col("_place") / rows_per_page).cast("long"))


def numbered_pages(df: DataFrame, keys: list[str], order: list[str], rows_per_page: int) -> DataFrame:
    """Adds page: the 0-based page of each row inside its keys."""
    return _placed(df, keys, order, rows_per_page).drop("_place")


def map_numbered(df: DataFrame, keys: list[str], order: list[str], rows_per_page: int, page_map: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """page_map over pages cut inside each key: a page is at most rows_per_page rows of one key, with its number as page.

    Pages may be small and many, so page_map gets an Arrow table of many whole pages in order, and keeps them apart by
    keys and page; None or an empty table yields nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[pa.Table]:
            held, n = [], 0
            for batch in batches:
                opens = np.flatnonzero(batch.column("_place").to_numpy() % rows_per_page == 0)
                if n + batch.num_rows >= RUN_ROWS and len(opens):
                    last = int(opens[-1])  # the last page may go on in the next batch
                    if n + last:
                        yield pa.Table.from_batches([*held, batch.slice(0, last)])
                    held, n, batch = [], 0, batch.slice(last)
                held.append(batch)
                n += batch.num_rows
            if n:
                yield pa.Table.from_batches(held)

        for pages in whole():
            out = page_map(pages.drop_columns(["_place"]))
            if out is not None:
                yield from out.to_batches()

    return _placed(df, keys, order, rows_per_page).sortWithinPartitions(*keys, "_place").mapInArrow(run, schema)


def fold(df: DataFrame, step: Callable, accumulator=None, rows_per_page: int = 10_000) -> Iterator:
    """step(first, last, page, accumulator) -> (yielded or None, accumulator): first call, one per page, last call.

    Pages reach the driver one at a time. Aggregates with a known algebra should use groupBy instead.
    """
    out, accumulator = step(True, False, None, accumulator)
    if out is not None:
        yield out
    page: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == rows_per_page:
            out, accumulator = step(False, False, page, accumulator)
            if out is not None:
                yield out
            page = []
    if page:
        out, accumulator = step(False, False, page, accumulator)
        if out is not None:
            yield out
    out, accumulator = step(False, True, None, accumulator)
    if out is not None:
        yield out


def summed(column: str, scale: int | None = None):
    """The sum of a column; with a scale exactly, in decimals of so many places (then values must be finite)."""
    return F.sum(column) if scale is None else F.sum(F.col(column).cast(f"decimal(38,{scale})")).cast("double")


def count_per_tag(df: DataFrame) -> DataFrame:
    return df.groupBy("tag_id").agg(F.count("*").alias("samples"))


def latest_per_tag(df: DataFrame) -> DataFrame:
    return df.groupBy("tag_id").agg(F.max("sample_time").alias("sample_time"), F.max_by("n_value", "sample_time").alias("n_value"))


def sum_per_tag(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Nulls don't count, a tag of nulls alone has a null sum, NaN makes the sum NaN; the last digits of a sum of doubles depend on its order."""
    return df.groupBy("tag_id").agg(summed("n_value", scale).alias("total"))


def sum_daily(df: DataFrame, scale: int | None = None) -> DataFrame:
    day = (F.col("sample_time") - F.pmod("sample_time", F.lit(DAY_MS))).alias("day_ms")
    return df.groupBy("tag_id", day).agg(summed("n_value", scale).alias("total"))


def avg_window(df: DataFrame, seconds: int = 1800) -> DataFrame:
    """The mean per tag and tumbling window; nulls don't count."""
    width = seconds * 1000
    start = (F.col("sample_time") - F.pmod("sample_time", F.lit(width))).alias("window_ms")
    return df.groupBy("tag_id", start).agg(F.avg("n_value").alias("mean"))
