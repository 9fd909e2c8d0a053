"""One grid over several bases: the calls that join settings, storage, plans, page maps, folds, cache and diagnostics."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import GridConfig, PageConfig, check_range
from .functions.grid import bucket
from .operators import aggregates
from .plans import pages as page_plans
from .schema import SAMPLE_SCHEMA
from .sources import store as stores
from .sources.cache import ResultCache, cache_key
from .sources.storage import Storage

SAMPLES = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SAMPLE_SCHEMA)


def _source(f: Callable | None):
    """What tells two page maps apart in a cache key: code and the values it closes over."""
    if f is None:
        return None
    free = {k: repr(v) for k, v in inspect.getclosurevars(f).nonlocals.items()}
    return {"name": getattr(f, "__qualname__", repr(f)), "code": f.__code__.co_code.hex(), "constants": repr(f.__code__.co_consts), "free": free, "defaults": repr(f.__defaults__)}


class Grid:
    """Samples of one or more bases. Settings are those the bases were written with; a new base gets `config`.

    cache: where results are kept, if reads ask for it. Reads list the bases anew, so they see every finished write.
    """

    def __init__(self, spark: SparkSession, bases: list[str] | str, config: GridConfig | None = None, storage: Storage = stores.PARQUET, cache: ResultCache | None = None):
        self.spark, self.storage, self.cache = spark, storage, cache
        self.bases = [bases] if isinstance(bases, str) else list(bases)
        if not self.bases:
            raise ValueError("a grid needs a base")
        self.config = stores.config_of(spark, self.bases[0], config)

    def store(self, samples: DataFrame | dict, insert_time: int | None = None, base: str | None = None, unique: bool = False) -> dict:
        """Append samples, or {tag: flat records}, to a base (the first, if none is named); returns counts and times."""
        df = stores.flat_records(self.spark, samples) if isinstance(samples, dict) else samples
        target = base or self.bases[0]
        done = stores.store(df, target, insert_time, self.config, unique=unique, storage=self.storage)
        if target not in self.bases:
            self.bases.append(target)
        return done

    def diagnose_store(self, samples: DataFrame, insert_time: int) -> DataFrame:
        """(path, samples, worker) of a write, before it is done."""
        return stores.plan_upserts(samples, insert_time, self.config)

    def scan(self, tags, start: int, end: int, **options) -> DataFrame:
        """Latest versions as a distributed table; options as in sources.store.scan."""
        return stores.scan(self.spark, self.bases, tags, start, end, storage=self.storage, **options)

    def last_write(self, tags, start: int, end: int) -> int:
        return stores.last_write(self.spark, self.bases, tags, start, end, self.storage)

    def table(self, tags, start: int, end: int, page_map: Callable | None = None, schema: str = SAMPLES, pages: PageConfig = PageConfig(), use_cache: bool = False, now: int | None = None, report: dict | None = None, **options) -> DataFrame:
        """The samples, after page_map if there is one, as a distributed table; from the cache where it is as new as the last write.

        page_map gets pandas pages of at most rows_per_page rows; None or an empty page yields nothing.
        """
        report = {} if report is None else report
        began = time.time()

        def make() -> DataFrame:
            found = self.scan(tags, start, end, **options)
            return found if page_map is None else aggregates.map_pages(found, page_map, schema, pages.rows_per_page)

        if not use_cache:
            out = make()
        elif self.cache is None:
            raise ValueError("the grid has no cache")
        else:
            key = cache_key(bases=sorted(self.bases), tags=tags, start=start, end=end, schema=schema, rows_per_page=pages.rows_per_page, page_map=_source(page_map), options=options)
            newest = self.last_write(tags, start, end)
            report |= {"cache_key": key, "last_write": newest, "cache_hit": self.cache.get(key, newest) is not None}
            out = self.cache.through(key, newest, int(time.time() * 1000) if now is None else now, make)
        report["plan_seconds"] = time.time() - began
        return out

    def read(self, tags: list[int], start: int, end: int, page_map: Callable | None = None, schema: str = SAMPLES, fold: Callable | None = None, accumulator=None, pages: PageConfig = PageConfig(), director: Callable | None = None, use_cache: bool = False, report: list | None = None, **options) -> Iterator:
        """Pages of rows, or what a fold yields over them, step by step.

        A step is a time page by a tag page. Without a director all steps are one distributed read, ordered by tag page,
        time page, tag as text and time; a director names the steps itself, one read for each (see plans.pages.next_steps).
        fold(first, last, page, accumulator) -> (yielded or None, accumulator). report gets one dict for each read.
        """
        check_range(start, end, pages.time_step)
        report = [] if report is None else report
        if fold is None:
            yield from self._pages(tags, start, end, page_map, schema, pages, director, use_cache, report, options)
            return
        given, accumulator = fold(True, False, None, accumulator)
        if given is not None:
            yield given
        for page in self._pages(tags, start, end, page_map, schema, pages, director, use_cache, report, options):
            given, accumulator = fold(False, False, page, accumulator)
            if given is not None:
                yield given
        given, accumulator = fold(False, True, None, accumulator)
        if given is not None:
            yield given

    def _pages(self, tags, start, end, page_map, schema, pages, director, use_cache, report, options) -> Iterator[list[Row]]:
        if not tags:
            return
        if director is None:
            reads = iter([(sorted(set(tags)), start, end)])
        else:
            time_step = min(pages.time_step, self.config.time_width)
            times = [(t, min(t + time_step, end)) for t in range(start, end, time_step)]
            tag_step = min(pages.tag_step, self.config.tag_width)
            groups: dict[int, list[int]] = {}
            for t in sorted(set(tags)):
                groups.setdefault(t - t % tag_step, []).append(t)
            reads = ((own, *at) for at, own in page_plans.next_steps(times, list(groups.values()), director))
        for own, low, high in reads:
            done: dict = {"tags": len(own), "start": low, "end": high, "rows": 0, "pages": 0}
            found = self.table(own, low, high, page_map, schema, pages, use_cache, report=done, **options)
            began = time.time()
            if {"tag_id", "sample_time"} <= set(found.columns):
                steps = [bucket(F.col("tag_id"), min(pages.tag_step, self.config.tag_width)), F.floor((F.col("sample_time") - start) / min(pages.time_step, self.config.time_width))] if director is None else []
                found = found.orderBy(*steps, F.col("tag_id").cast("string"), "sample_time")
            page: list[Row] = []
            for row in found.toLocalIterator(prefetchPartitions=True):
                page.append(row)
                if len(page) == pages.rows_per_page:
                    done["rows"], done["pages"] = done["rows"] + len(page), done["pages"] + 1
                    yield page
                    page = []
            if page:
                done["rows"], done["pages"] = done["rows"] + len(page), done["pages"] + 1
                yield page
            report.append(done | {"read_seconds": time.time() - began})

    def as_json(self, tags: list[int], start: int, end: int, **options) -> Iterator[str]:
        """Rows as JSON lines, each {"tag_id": ..., "sample_time": ..., ...}, in order of tag as text and time."""
        rows = self.scan(tags, start, end, ordered=True, **options)
        yield from (r.value for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).toLocalIterator(prefetchPartitions=True))

    def compact(self, target: str) -> "Grid":
        """The latest versions of all bases at a new place, which then needs no merge."""
        if len(self.bases) > 1:
            raise ValueError("compact one base at a time")
        stores.compact(self.spark, self.bases[0], target, storage=self.storage)
        return Grid(self.spark, target, storage=self.storage, cache=self.cache)
