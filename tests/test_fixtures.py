"""The micro fixtures of FIXTURES.md, part C, by their numbers."""

import pytest
from pyspark.sql import functions as F

from chronocell.config import GridConfig, PageConfig, check_range
from chronocell.functions import codecs, grid
from chronocell.grid import Grid
from chronocell.operators import aggregates
from chronocell.operators.mvcc import latest_version
from chronocell.plans import pages
from chronocell.sources import store

W = 1 << 26
SAMPLES = "tag_id long, sample_time long, insert_time long, n_value double, o_value string, ingest_seq long"


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def table(spark, rows):
    return spark.createDataFrame([(t, s, i, None, v, n) for n, (t, s, i, v) in enumerate(rows)], SAMPLES)


def test_c1_c2_buckets_and_cells(spark):
    assert [one(spark, grid.bucket(F.lit(x).cast("long"), w)) for x, w in ((513, 512), (3 * W + 5, W), (-1, 10))] == [512, 201326592, 0]
    assert one(spark, grid.cell_id(F.lit(512).cast("long"), F.lit(W).cast("long"))) == "l-512-67108864"


def test_c3_djb2(spark):
    assert [one(spark, grid.djb2(F.lit(s))) for s in ("", "a", "l-0-0")] == [5381, 177670, 263902667]


def test_c4_disk(spark):
    assert one(spark, grid.disk_index(F.lit(512).cast("long"), 5)) == 2


@pytest.mark.parametrize("asked, wanted", [((0, 100, 64), [(0, 64), (64, 100)]), ((10, 100, 64), [(10, 74), (74, 100)]), ((0, 2 * W, 2 * W), [(0, W), (W, 2 * W)])])
def test_c5_to_c7_time_pages(spark, asked, wanted):
    assert [(r.page_start, r.page_end) for r in pages.time_pages(spark, *asked).orderBy("page").collect()] == wanted


@pytest.mark.parametrize("asked", [(5, 5, 64), (-1, 5, 64), (0, 5, 3), (0, 5, 1)])
def test_c8_bad_ranges(spark, asked):
    with pytest.raises(ValueError):
        pages.time_pages(spark, *asked)


def test_c9_tag_pages(spark):
    tags = spark.createDataFrame([(t,) for t in (1, 2, 65, 130, 66)], "tag_id long")
    assert [r.tags for r in pages.tag_pages(tags, 64).orderBy("tag_page").collect()] == [[1, 2], [65, 66], [130]]


def test_c10_to_c12_codecs(spark):
    assert one(spark, codecs.short_bigint(F.lit("AB")).cast("string")) == "72417346"
    assert [one(spark, codecs.tag_split(F.lit(s))) for s in ("Tag12x", "Tag", "a", "Tag99999999999999999999")] == [12, None, 177670, None]
    assert one(spark, codecs.code_points(F.lit("a😀b"))) == [97, 128512, 98]


def test_c13_c14_displacement(spark):
    links = lambda times, insert: sorted(tuple(r) for r in grid.displacement_links(table(spark, [(0, t, insert, "")  for t in times])).collect())
    assert links([0], 5 * W) == [("l-0-0", "l-0-335544320")] and links([4 * W], 5 * W) == links([6 * W + 1], 5 * W) == []
    assert links([7 * W], 5 * W) == [("l-0-469762048", "l-0-335544320")]
    assert len(links([0, 10 * W, 5 * W], 100 * W)) == 3


def test_c15_c16_versions(spark, tmp_path):
    rows = table(spark, [(1, 10, 1, "a"), (1, 10, 3, "c"), (1, 10, 2, "b")])
    assert [r.o_value for r in latest_version(rows).collect()] == ["c"]
    store.store_flat(spark, {1: [10, 0, None, "a", 10, 0, None, "b"]}, f"{tmp_path}/flat", 5)
    assert [r.o_value for r in store.scan(spark, [f"{tmp_path}/flat"], [1], 0, 20).collect()] == ["b"]
    unnumbered = spark.createDataFrame([(1, 10, None, v) for v in "abc"], "tag_id long, sample_time long, n_value double, o_value string")
    store.store(unnumbered, f"{tmp_path}/plain", 5)
    assert [r.o_value for r in store.scan(spark, [f"{tmp_path}/plain"], [1], 0, 20).collect()] == ["c"]


def test_c17_shards(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    store.store_flat(spark, {2: [1, 0, None, "old"]}, a, 1)
    store.store_flat(spark, {1: [1, 0, None, "one"], 2: [1, 0, None, "new"]}, b, 2)
    found = store.scan(spark, [a, b], [1, 2], 0, 10).collect()
    assert sorted((r.tag_id, r.o_value) for r in found) == [(1, "one"), (2, "new")]


def test_c18_to_c20_scans(spark, tmp_path):
    base = f"{tmp_path}/g"
    store.store_flat(spark, {t: [s for at in (9, 10, 19, 20) for s in (at, 0, 1.0, None)] for t in (2, 7, 9, 10)}, base, 1)
    assert sorted(r.sample_time for r in store.scan(spark, [base], [7], 10, 20).collect()) == [10, 19]
    assert [r.tag_id for r in store.scan(spark, [base], [2, 9, 10], 10, 11, ordered=True).collect()] == [10, 2, 9]
    assert store.scan(spark, [base], [7, 7], 10, 20).count() == 2


def test_c21_no_tags(spark, tmp_path):
    def step(first, last, page, seen):
        return (dict(seen) if last else None), seen

    assert list(Grid(spark, f"{tmp_path}/none").read([], 0, 10, fold=step, accumulator={})) == [{}]
    assert list(aggregates.fold(spark.createDataFrame([], "tag_id long"), step, {})) == [{}]


def test_c22_bad_settings():
    for bad in (0, 3, -4):
        with pytest.raises(ValueError):
            GridConfig(tag_width=bad)
        with pytest.raises(ValueError):
            GridConfig(time_width=bad)
        with pytest.raises(ValueError):
            PageConfig(time_step=bad)
    assert GridConfig(tag_width=1).tag_width == 1
    for step in ("time_step", "tag_step"):
        with pytest.raises(ValueError):
            PageConfig(**{step: 1})
    for bad in ((5, 5), (-1, 5), (6, 5)):
        with pytest.raises(ValueError):
            check_range(*bad)


def test_c23_displaced_rows_are_found(spark, tmp_path):
    store.store_flat(spark, {0: [W + 1, 0, 1.0, None]}, f"{tmp_path}/g", 2 * W + 5)
    assert store.scan(spark, [f"{tmp_path}/g"], [0], W // 2, W // 2 + W).count() == 1


def test_c24_an_empty_page_does_not_end_a_map(spark):
    df = spark.range(40, numPartitions=1).select(F.col("id").alias("tag_id"))
    found = aggregates.map_pages(df, lambda p: p if p.tag_id.iloc[0] >= 20 else None, "tag_id long", 20)
    assert found.count() == 20


def test_c25_latest_of_the_hourly_fixture(spark):
    from chronocell.catalogue import v_dup

    assert latest_version(v_dup(spark, "/root/testdata/sf0.01")).count() == 9567
