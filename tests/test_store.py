"""The store, the facade, the cache and streams, on files."""

import math
import re

import pytest
from pyspark.sql import functions as F

from chronocell.config import GridConfig, PageConfig
from chronocell.grid import Grid
from chronocell.operators import aggregates
from chronocell.schema import GridSchema, epoch_ms
from chronocell.sources import store
from chronocell.sources.cache import ResultCache, cache_key
from chronocell.sources.generators import generate_samples
from chronocell.sources.storage import FileStorage
from chronocell.streaming import ingest

W = 1 << 26


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 5000)
    return df._jdf.queryExecution().executedPlan().toString()


def filled(spark, base, **more):
    own = Grid(spark, base, **more)
    own.store(generate_samples(spark, 6, 300), 1000)
    return own


def test_settings_stay_with_the_base(spark, tmp_path):
    wide = GridConfig(tag_width=4, time_width=1 << 12)
    base = f"{tmp_path}/g"
    filled(spark, base, config=wide)
    assert Grid(spark, base).config == wide
    assert store.scan(spark, [base], list(range(6)), 0, 1 << 30).count() == 1800
    for call in (lambda: store.scan(spark, [base], [1], 0, 10, GridConfig()), lambda: Grid(spark, base, GridConfig()), lambda: store.store(generate_samples(spark, 1, 1), base, 1, GridConfig())):
        with pytest.raises(ValueError, match="cells of 4 tags"):
            call()
    store.compact(spark, base, f"{tmp_path}/c")
    assert Grid(spark, f"{tmp_path}/c").config == wide
    both = store.scan(spark, [base, filled(spark, f"{tmp_path}/other").bases[0]], [1, 5], 0, 1 << 30)
    assert both.count() == 600  # each base is pruned by its own widths


@pytest.mark.parametrize("more", [{}, {"ttl": 1 << 40, "now": 2000}, {"ordered": True}, {"as_of": 5000}])
@pytest.mark.parametrize("as_table", [False, True])
def test_every_file_scan_is_pruned(spark, tmp_path, more, as_table):
    base = f"{tmp_path}/g"
    filled(spark, base, config=GridConfig(tag_width=2, time_width=1 << 16))
    tags = spark.createDataFrame([(1,), (4,)], "tag_id long") if as_table else [1, 4]
    found = store.scan(spark, [base], tags, 1 << 16, 1 << 17, **more)
    scans = re.findall(r"FileScan parquet.*?PartitionFilters: \[(.*?)\], PushedFilters", plan(found), re.S)
    assert scans and all("tag_bucket" in s and "time_bucket" in s for s in scans)
    assert found.count() == 2 * 66


def test_merge_is_left_out_where_one_write_was_unique(spark, tmp_path):
    base = f"{tmp_path}/g"
    store.store(generate_samples(spark, 2, 50), base, 1, unique=True)
    assert "Window" not in plan(store.scan(spark, [base], [0, 1], 0, 1 << 20))
    assert "Window" in plan(store.scan(spark, [base, base], [0, 1], 0, 1 << 20))
    store.store(generate_samples(spark, 2, 50), base, 2)
    again = store.scan(spark, [base], [0, 1], 0, 1 << 20)
    assert "Window" in plan(again) and again.count() == 100 and {r.insert_time for r in again.collect()} == {2}
    store.compact(spark, base, f"{tmp_path}/c")
    small = store.scan(spark, [f"{tmp_path}/c"], [0, 1], 0, 1 << 20)
    assert "Window" not in plan(small) and sorted(small.collect()) == sorted(again.collect())


def test_versions_ttl_and_missing_bases(spark, tmp_path):
    base = f"{tmp_path}/g"
    for at, value in ((10, "a"), (20, "b")):
        store.store_flat(spark, {1: [5, 0, 1.0, value], 900: [W + 5, 0, 2.0, value]}, base, at)
    seen = lambda **more: sorted((r.tag_id, r.o_value) for r in store.scan(spark, [base], [1, 900], 0, 2 * W, **more).collect())
    assert seen() == [(1, "b"), (900, "b")] and seen(as_of=15) == [(1, "a"), (900, "a")] and seen(as_of=5) == []
    assert seen(now=30, ttl=20) == seen() and seen(now=31, ttl=20) == []
    assert store.scan(spark, [f"{tmp_path}/none"], [1], 0, 10).count() == 0 and store.last_write(spark, [f"{tmp_path}/none"], [1], 0, 10) == -1
    assert store.last_write(spark, [base], [1], 0, 10) == 20


def test_bad_rows_are_refused(spark, tmp_path):
    for row in ((-1, 5), (None, 5), (1, None)):
        with pytest.raises(Exception, match="must not be"):
            store.store(spark.createDataFrame([(*row, 1.0, "x")], "tag_id long, sample_time long, n_value double, o_value string"), f"{tmp_path}/g", 1)
    for bad in ({1: [1, 2, 3]}, {1: [1.5, 0, 1.0, None]}, {1: [None, 0, 1.0, None]}):
        with pytest.raises(ValueError):
            store.store_flat(spark, bad, f"{tmp_path}/g", 1)


def test_other_formats_and_names(spark, tmp_path):
    own = Grid(spark, f"{tmp_path}/g", storage=FileStorage("orc"))
    names = GridSchema(tag="sensor", time="at", n_value="reading")
    df = spark.createDataFrame([(1, 5, 2.5, True), (2, 6, 3.5, False)], "sensor int, at int, reading float, extra boolean")
    own.store(names.to_samples(df).withColumn("o_value", F.lit("x")), 7)
    found = names.from_samples(own.scan([1, 2], 0, 10)).select("sensor", "at", "reading").collect()
    assert sorted(map(tuple, found)) == [(1, 5, 2.5), (2, 6, 3.5)]
    with pytest.raises(ValueError, match="missing"):
        names.to_samples(df.drop("at"))


def test_reads_by_pages_and_directors(spark, tmp_path):
    own = filled(spark, f"{tmp_path}/g", config=GridConfig(time_width=1 << 16))
    small, report = PageConfig(1 << 16, 2, 40), []
    found = list(own.read([0, 1, 5], 0, 300_000, pages=small, report=report))
    assert sum(map(len, found)) == 900 and max(map(len, found)) == 40 and report[0]["rows"] == 900
    flat = [(r.tag_id, r.sample_time) for p in found for r in p]
    assert flat == sorted(flat, key=lambda x: (x[0] // 2, x[1] // (1 << 16), str(x[0]), x[1]))

    def forward(times, tags, time, group):
        at = [(t, g) for g in tags for t in times]
        nth = at.index((time, group)) + 1 if group else 0
        return at[nth] if nth < len(at) else None

    steps: list = []
    led = [(r.tag_id, r.sample_time) for p in own.read([0, 1, 5], 0, 300_000, pages=small, director=forward, report=steps) for r in p]
    assert led == flat and len(steps) == 2 * 5 and sum(s["rows"] for s in steps) == 900
    only = list(own.read([0, 1], 0, 300_000, pages=small, director=lambda times, tags, time, group: None if group else (times[1], [1])))
    assert {r.tag_id for p in only for r in p} == {1} and sum(map(len, only)) == 66

    def count(first, last, page, n):
        return (n if last else None), n + len(page or [])

    assert list(own.read([0, 1], 0, 300_000, fold=count, accumulator=0, page_map=lambda p: p[p.tag_id == 1])) == [300]
    lines = list(own.as_json([0, 5], 0, 2000))
    assert len(lines) == 4 and '"tag_id":0' in lines[0]


def test_cache(spark, tmp_path):
    own = filled(spark, f"{tmp_path}/g", cache=ResultCache(spark, f"{tmp_path}/cache", cool_down=100))

    def read(now, **more):
        report: dict = {}
        rows = own.table([1, 2], 0, 300_000, use_cache=True, now=now, report=report, **more)
        return report["cache_hit"], rows.count()

    assert read(1050) == (False, 600) and read(1060) == (False, 600)  # writes have not cooled down
    assert read(5000) == (False, 600) and read(5000) == (True, 600)
    keep = lambda n: lambda p: p[p.n_value > n]
    assert read(5000, page_map=keep(1000)) == (False, 596) and read(5000, page_map=keep(2000)) == (False, 594) and read(5000, page_map=keep(1000)) == (True, 596)
    own.store(generate_samples(spark, 3, 310), 6000)
    assert read(9000) == (False, 600) and read(9000) == (True, 600)
    cache = own.cache
    one, two = (spark.range(n) for n in (1, 2))
    assert cache.through("k", 0, 500, lambda: one).count() == 1
    assert cache.through("k", 0, 500, lambda: two, read=False).count() == 2  # the same time again
    assert cache.get("k", 0).count() in (1, 2) and len(cache._entries("k")) == 2


def test_cache_keys(spark):
    tags = lambda *x: spark.createDataFrame([(t,) for t in x], "tag_id long")
    assert cache_key(tags=[1, 2]) == cache_key(tags=[2, 1, 1]) != cache_key(tags=[1, 3])
    assert cache_key(tags=tags(1, 2)) == cache_key(tags=tags(2, 1, 2)) != cache_key(tags=tags(1, 3))
    with pytest.raises(TypeError):
        cache_key(page_map=object())


def test_times_do_not_depend_on_the_zone(spark):
    df = lambda: spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.123456' AS ts UNION ALL SELECT TIMESTAMP_NTZ '1969-12-31 23:59:59.9995' UNION ALL SELECT NULL")
    wanted = [1710037800123, -1, None]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r.x for r in df().select(epoch_ms(F.col("ts")).alias("x")).collect()] == wanted
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sums_keep_small_and_large_values(spark):
    rows = [(1, 0, 0.001), (1, 1, 0.001), (1, 2, 0.004), (2, 0, 1e17), (2, 1, 1.0), (3, 0, float("nan")), (3, 1, 1.0), (4, 0, None), (5, 0, None), (5, 1, 2.0)]
    df = spark.createDataFrame(rows, "tag_id long, sample_time long, n_value double")
    total = {r.tag_id: r.total for r in aggregates.sum_per_tag(df).collect()}
    assert math.isclose(total[1], 0.006) and math.isclose(total[2], 1e17) and math.isnan(total[3]) and total[4] is None and total[5] == 2
    daily = {r.tag_id: r.total for r in aggregates.sum_daily(df).collect()}
    assert math.isclose(daily[1], 0.006) and daily[4] is None
    mean = {r.tag_id: r["mean"] for r in aggregates.avg_window(df).collect()}
    assert math.isclose(mean[1], 0.002) and math.isnan(mean[3]) and mean[4] is None and mean[5] == 2
    exact = {r.tag_id: r.total for r in aggregates.sum_per_tag(df.where("tag_id in (1, 4, 5)"), scale=6).collect()}
    assert exact == {1: 0.006, 4: None, 5: 2.0}


def test_streams(spark, tmp_path):
    source, base, at = (f"{tmp_path}/{x}" for x in ("in", "grid", "check"))
    rows = lambda v: spark.createDataFrame([(1, 5, float(v), str(v), 0)], "tag_id long, sample_time long, n_value double, o_value string, ingest_seq long")
    rows(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(rows(1).schema).parquet(source)
    store.store(rows(0), base, 1_700_000_000_000)
    ingest.stream_into(stream(), base, at).awaitTermination()
    latest = lambda: [r.o_value for r in store.scan(spark, [base], [1], 0, 10).collect()]
    assert latest() == ["1"]  # streamed rows are not older than batch writes
    assert ingest.batch_time(spark, at, 0) == ingest.batch_time(spark, at, 0)
    rows(2).write.mode("append").parquet(source)
    ingest.stream_into(stream(), base, at).awaitTermination()
    assert latest() == ["2"]
    replay = lambda df, batch: store.store(df, base, ingest.batch_time(spark, at, batch))
    replay(rows(1), 0)
    assert latest() == ["2"]
    ingest.stream_of(spark, base).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen").count() == 4
    timed = ingest.windowed(stream(), 1000).writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    timed.awaitTermination()
    assert [(r["mean"], r.samples) for r in spark.table("means").collect()] == [(1.5, 2)]
