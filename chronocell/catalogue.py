"""The queries of the engine's own operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import GridConfig, PageConfig
from .functions import codecs, grid
from .grid import Grid
from .operators import aggregates
from .operators.mvcc import latest_version
from .plans import pages, stats
from .schema import epoch_ms, samples
from .sources import generators, store
from .sources.cache import ResultCache
from .sources.scratch import new_path

CONFIG = GridConfig()
W, HOUR = CONFIG.time_width, 3_600_000
START, END = 1_704_067_200_000, 1_735_689_600_000  # one year
LATE = START + 3 * 31_536_000_000  # a fixed insert time far behind the samples
TAGS = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def v_raw(spark, sf) -> DataFrame:
    return samples(events(spark, sf), "user_id", epoch_ms(F.col("ts")), "event_id", "value", "event_type")


def v_dup(spark, sf) -> DataFrame:
    """Times floored to the hour, so that versions meet."""
    ms = epoch_ms(F.col("ts"))
    return samples(events(spark, sf), "user_id", ms - ms % HOUR, "event_id", "value", "event_type")


def v_orders(spark, sf) -> DataFrame:
    return samples(spark.read.parquet(f"{sf}/orders.parquet"), "o_custkey", epoch_ms(F.col("o_orderdate")), "o_orderkey", "o_totalprice", "o_orderpriority")


CORE = ("tag_id", "sample_time", "insert_time", "n_value", "o_value")
RAW = "SELECT user_id AS tag_id, (epoch_us(ts) // 1000) AS sample_time, event_id AS insert_time, value AS n_value, event_type AS o_value FROM events"
DUP = f"SELECT user_id AS tag_id, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {HOUR} AS sample_time, event_id AS insert_time, value AS n_value, event_type AS o_value FROM events"
ORD = "SELECT o_custkey AS tag_id, (epoch_us(o_orderdate) // 1000) AS sample_time, o_orderkey AS insert_time, o_totalprice AS n_value, o_orderpriority AS o_value FROM orders"
LATEST = "QUALIFY row_number() OVER (PARTITION BY tag_id, sample_time ORDER BY insert_time DESC) = 1"
IN_TAGS = f"tag_id IN ({', '.join(map(str, TAGS))})"
IN_TIME = f"sample_time >= {START} AND sample_time < {END}"
DJB = "list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda ch: unicode(ch)::BIGINT)), lambda a, b: (a * 33 + b) & 4294967295)"
CELLS = f"*, tag_id - tag_id % 512 AS tag_bucket, sample_time - sample_time % {W} AS time_bucket"
CELL = "'l-' || tag_bucket || '-' || time_bucket"
PATH = f"'set1/disk' || (tag_bucket % 5 + 1) || '/' || {CELL}"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def latest_within(df: DataFrame) -> DataFrame:
    return latest_version(store.within(df, TAGS, START, END)).select(*CORE)


FOREVER = 1 << 43  # ms, beyond all samples
_BASES: dict[tuple[str, str, str], str] = {}


def base_of(spark, sf: str, name: str, make) -> str:
    """A grid with make(spark, sf), whose rows keep their insert times; written once a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _BASES:
        base = new_path(spark, f"grid-{name}")
        store.store(make(spark, sf).withColumn("ingest_seq", F.col("insert_time")), base, config=CONFIG, stamped=True)
        _BASES[key] = base
    return _BASES[key]


def raw_grid(spark, sf) -> Grid:
    return Grid(spark, base_of(spark, sf, "raw", v_raw))


def dup_grid(spark, sf) -> Grid:
    return Grid(spark, base_of(spark, sf, "dup", v_dup))


def all_tags(spark, sf) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").alias("tag_id")).distinct()


# ---- scans --------------------------------------------------------------------------------------


@query(f"WITH v AS ({RAW}) SELECT * FROM v WHERE {IN_TAGS} AND {IN_TIME} {LATEST}")
def scan_range(spark, sf):
    return raw_grid(spark, sf).scan(TAGS, START, END).select(*CORE)


@query(f"WITH v AS ({RAW}) SELECT *, row_number() OVER (ORDER BY CAST(tag_id AS VARCHAR), sample_time, insert_time) AS place FROM v WHERE {IN_TAGS} AND {IN_TIME}")
def scan_ordered(spark, sf):
    found = raw_grid(spark, sf).scan(TAGS, START, END, ordered=True).select(*CORE)
    # the place of a row among all: its place in its tag plus the rows of the tags before, of which there are as many as asked for
    own = found.withColumn("nth", F.row_number().over(Window.partitionBy("tag_id").orderBy("sample_time", "insert_time")))
    per_tag = found.groupBy("tag_id").count().select("tag_id", (F.sum("count").over(Window.orderBy(F.col("tag_id").cast("string"))) - F.col("count")).alias("before"))
    return own.join(per_tag, "tag_id").select(*CORE, (F.col("nth") + F.col("before")).cast("long").alias("place"))


@query(f"WITH v AS ({RAW}) SELECT * FROM v WHERE tag_id IN (999999999) AND {IN_TIME}")
def scan_missing_tag(spark, sf):
    return raw_grid(spark, sf).scan([999_999_999], START, END).select(*CORE)


@query(f"WITH v AS ({RAW}) SELECT * FROM v WHERE tag_id < 1200 AND {IN_TIME}")
def scan_many_tags(spark, sf):
    return raw_grid(spark, sf).scan(list(range(1200)), START, END).select(*CORE)


@query(f"WITH v AS ({RAW}) SELECT * FROM v WHERE tag_id % 3 = 1 AND {IN_TIME}")
def scan_tag_table(spark, sf):
    return raw_grid(spark, sf).scan(all_tags(spark, sf).where("tag_id % 3 = 1"), START, END).select(*CORE)


@query(f"WITH v AS ({RAW}) SELECT * FROM v WHERE tag_id IN (7) AND {IN_TIME}")
def filter_tags(spark, sf):
    return raw_grid(spark, sf).scan([7, 7], START, END).select(*CORE)


@query(f"WITH v AS ({RAW}) SELECT * FROM v WHERE {IN_TIME} ORDER BY sample_time, insert_time LIMIT 20")
def scan_limit(spark, sf):
    return v_raw(spark, sf).where(IN_TIME).select(*CORE).orderBy("sample_time", "insert_time").limit(20)


@query(f"WITH v AS (SELECT * FROM ({DUP}) UNION ALL SELECT tag_id, sample_time, insert_time + 1000000000, n_value + 1, o_value FROM ({DUP}) WHERE insert_time % 3 = 0) SELECT * FROM v {LATEST}")
def multi_shard_scan(spark, sf):
    later = lambda spark, sf: v_dup(spark, sf).where("insert_time % 3 = 0").withColumns({"insert_time": F.col("insert_time") + 1_000_000_000, "n_value": F.col("n_value") + 1})
    shards = [base_of(spark, sf, "dup", v_dup), base_of(spark, sf, "later", later)]
    return Grid(spark, shards).scan(all_tags(spark, sf), 0, FOREVER).select(*CORE)


@query(f"WITH v AS ({RAW}), c AS (SELECT {CELLS} FROM v), live AS (SELECT tag_bucket, time_bucket FROM c GROUP BY 1, 2 HAVING 5000 - min(insert_time) <= 4000) SELECT tag_id, sample_time, insert_time, n_value, o_value FROM c SEMI JOIN live USING (tag_bucket, time_bucket) WHERE {IN_TAGS}")
def scan_ttl(spark, sf):
    return raw_grid(spark, sf).scan(TAGS, 0, FOREVER, now=5000, ttl=4000).select(*CORE)


@query(f"WITH v AS ({DUP}) SELECT * FROM v WHERE insert_time <= 5000 {LATEST}")
def scan_as_of(spark, sf):
    return dup_grid(spark, sf).scan(all_tags(spark, sf), 0, FOREVER, as_of=5000).select(*CORE)


STEP_TIME, STEP_TAGS, STEP_ROWS = 1 << 26, 64, 50
STEPS = f"tag_id - tag_id % {STEP_TAGS}, (sample_time - {START}) // {STEP_TIME}, CAST(tag_id AS VARCHAR), sample_time"


@query(f"WITH v AS ({RAW}), r AS (SELECT *, row_number() OVER (ORDER BY {STEPS}) - 1 AS place FROM v WHERE {IN_TAGS} AND {IN_TIME} {LATEST}) SELECT tag_id, sample_time, n_value, place // {STEP_ROWS} AS page FROM r")
def iterate_pages(spark, sf):
    """Pages as a caller meets them: of one distributed read in the order of the steps."""
    found = raw_grid(spark, sf).read(TAGS, START, END, pages=PageConfig(STEP_TIME, STEP_TAGS, STEP_ROWS))
    rows = [(r.tag_id, r.sample_time, r.n_value, i) for i, page in enumerate(found) for r in page]
    return spark.createDataFrame(rows, "tag_id long, sample_time long, n_value double, page long")


SOON = START + 4 * W


@query(f"WITH v AS ({RAW}) SELECT tag_id, count(*) AS samples, min(sample_time) AS first_time, max(sample_time) AS last_time FROM (SELECT * FROM v WHERE {IN_TAGS} AND sample_time >= {START} AND sample_time < {SOON} {LATEST}) WHERE n_value > 50 GROUP BY 1")
def iterate_fold(spark, sf):
    """A page map and a fold over the steps of a director that goes from the last one to the first."""

    def backwards(times, tags, time, own):
        order = [(t, g) for g in reversed(tags) for t in reversed(times)]
        nth = order.index((time, own)) + 1 if own else 0
        return order[nth] if nth < len(order) else None

    def step(first, last, page, seen):
        for r in page or []:
            n, low, high = seen.get(r.tag_id, (0, r.sample_time, r.sample_time))
            seen[r.tag_id] = (n + 1, min(low, r.sample_time), max(high, r.sample_time))
        return (sorted((t, *x) for t, x in seen.items()) if last else None), seen

    found = list(raw_grid(spark, sf).read(TAGS, START, SOON, page_map=lambda p: p[p.n_value > 50], fold=step, accumulator={}, pages=PageConfig(W, 64, 50), director=backwards))
    return spark.createDataFrame(found[-1], "tag_id long, samples long, first_time long, last_time long")


@query(f"WITH v AS ({RAW}) SELECT * FROM v WHERE {IN_TAGS} AND {IN_TIME} {LATEST}")
def cached_read(spark, sf):
    """The second of two equal reads, which the cache answers."""
    own = raw_grid(spark, sf)
    own.cache = ResultCache(spark, new_path(spark, "cache"))
    for _ in range(2):
        report: dict = {}
        found = own.table(TAGS, START, END, use_cache=True, report=report)
    if not report["cache_hit"]:
        raise RuntimeError("the cache did not answer")
    return found.select(*CORE)


# ---- versions and writes ------------------------------------------------------------------------


@query(f"WITH v AS ({DUP}) SELECT * FROM v {LATEST}")
def mvcc_latest(spark, sf):
    return latest_version(v_dup(spark, sf)).select(*CORE)


@query(f"WITH v AS ({ORD}) SELECT * FROM v {LATEST}")
def mvcc_orders(spark, sf):
    return latest_version(v_orders(spark, sf)).select(*CORE)


@query(f"WITH v AS ({DUP}) SELECT tag_id, sample_time, CAST({LATE} AS BIGINT) AS insert_time, n_value, o_value FROM v {LATEST}")
def store_roundtrip(spark, sf):
    own = Grid(spark, new_path(spark, "grid"), CONFIG)
    own.store(v_dup(spark, sf).withColumn("ingest_seq", F.col("insert_time")), LATE)
    return own.scan(all_tags(spark, sf), 0, FOREVER).select(*CORE)


@query(f"WITH v AS ({DUP}) SELECT tag_id, sample_time, CAST({LATE} AS BIGINT) AS insert_time, n_value, o_value FROM v {LATEST}")
def compacted_read(spark, sf):
    own = Grid(spark, new_path(spark, "grid"), CONFIG)
    own.store(v_dup(spark, sf).withColumn("ingest_seq", F.col("insert_time")), LATE)
    return own.compact(new_path(spark, "compact")).scan(all_tags(spark, sf), 0, FOREVER).select(*CORE)


@query(f"WITH v AS (SELECT tag_id - tag_id % 512 AS tag_bucket, CAST({LATE - LATE % W} AS BIGINT) AS time_bucket FROM ({RAW})), p AS (SELECT {PATH} AS path, count(*) AS samples FROM v GROUP BY 1) SELECT path, samples, {DJB.format('path')} % 10 AS worker FROM p")
def store_diagnostics(spark, sf):
    return raw_grid(spark, sf).diagnose_store(v_raw(spark, sf), LATE)


@query(f"WITH v AS (SELECT tag_id - tag_id % 512 AS tag_bucket, CAST({LATE - LATE % W} AS BIGINT) AS time_bucket FROM ({ORD})), p AS (SELECT {PATH} AS path, count(*) AS samples FROM v GROUP BY 1) SELECT path, samples, {DJB.format('path')} % 10 AS worker FROM p")
def plan_upserts(spark, sf):
    return store.plan_upserts(v_orders(spark, sf), LATE)


@query(f"WITH v AS ({ORD}) SELECT DISTINCT 'l-' || (tag_id - tag_id % 512) || '-' || (sample_time - sample_time % {W}) AS record_cell, 'l-' || (tag_id - tag_id % 512) || '-' || {LATE - LATE % W} AS insert_cell FROM v WHERE abs((sample_time - sample_time % {W}) - {LATE - LATE % W}) > {W}")
def displacement_links(spark, sf):
    return grid.displacement_links(v_orders(spark, sf).withColumn("insert_time", F.lit(LATE).cast("long")))


# ---- placement ----------------------------------------------------------------------------------


def _cells(spark, sf) -> DataFrame:
    return grid.with_cells(v_orders(spark, sf))


@query(f"SELECT tag_id, sample_time, tag_bucket, time_bucket FROM (SELECT {CELLS} FROM ({ORD}))")
def bucket_tag_time(spark, sf):
    return _cells(spark, sf).select("tag_id", "sample_time", "tag_bucket", "time_bucket")


def placement(name: str, sql: str):
    def add(f):
        def run(spark, sf):
            return _cells(spark, sf).groupBy(f(F.col("tag_bucket"), F.col("time_bucket")).alias(name)).agg(F.count("*").alias("samples"))

        run.__name__ = name
        query(f"WITH c AS (SELECT {CELLS} FROM ({ORD})), d AS (SELECT {sql} AS {name} FROM c) SELECT {name}, count(*) AS samples FROM d GROUP BY 1")(run)
        return f

    return add


placement("cell_id", CELL)(lambda t, b: grid.cell_id(t, b))
placement("disk_index", "tag_bucket % 5")(lambda t, b: grid.disk_index(t, 5))
placement("connection_path", PATH)(lambda t, b: grid.connection_path(t, b))
placement("write_affinity", DJB.format(f"({PATH})") + " % 10")(lambda t, b: grid.write_affinity(grid.connection_path(t, b), 10))
placement("read_affinity", DJB.format(f"({CELL})") + " % 10")(lambda t, b: grid.read_affinity(grid.cell_id(t, b), 10))


@query(f"WITH c AS (SELECT DISTINCT tag_bucket, time_bucket FROM (SELECT {CELLS} FROM ({RAW}))) SELECT tag_bucket, time_bucket, time_bucket + s * {W} AS near_bucket FROM c, (VALUES (-1), (0), (1)) AS x(s)")
def tolerance_cells(spark, sf):
    return grid.tolerance_cells(grid.with_cells(v_raw(spark, sf)).select("tag_bucket", "time_bucket").distinct())


# ---- codecs -------------------------------------------------------------------------------------


def _names(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, {DJB.format('c_name')} AS hash FROM customer")
def djb2_hash(spark, sf):
    return _names(spark, sf).select("c_custkey", grid.djb2(F.col("c_name")).alias("hash"))


def _md5_word(i: int) -> str:
    byte = lambda b: f"(('0x' || substr(md5(c_name), {8 * i + 2 * b + 1}, 2))::BIGINT)"
    return f"({byte(0)} + 256 * {byte(1)} + 65536 * {byte(2)} + 16777216 * {byte(3)})"


@query("SELECT c_custkey, " + ", ".join(f"CAST(CASE WHEN {_md5_word(i)} >= 2147483648 THEN {_md5_word(i)} - 4294967296 ELSE {_md5_word(i)} END AS INTEGER) AS w{i}" for i in range(4)) + " FROM customer")
def codec_md5(spark, sf):
    return _names(spark, sf).select("c_custkey", codecs.md5_words(F.col("c_name")).alias("w")).select("c_custkey", *[F.col("w")[i].alias(f"w{i}") for i in range(4)])


TAGGED = "(CASE WHEN c_custkey % 3 = 0 THEN 'Tag' || c_custkey || 'x' WHEN c_custkey % 3 = 1 THEN 'Tag' ELSE c_name END)"


@query(f"WITH t AS (SELECT c_custkey, {TAGGED} AS s FROM customer) SELECT c_custkey, CASE WHEN starts_with(s, 'Tag') THEN TRY_CAST(regexp_extract(s, '^Tag\\s*([+-]?\\d+)', 1) AS BIGINT) ELSE {DJB.format('s')} END AS number FROM t")
def codec_tag_split(spark, sf):
    s = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Tag"), F.col("c_custkey").cast("string"), F.lit("x"))).when(F.col("c_custkey") % 3 == 1, "Tag").otherwise(F.col("c_name"))
    return _names(spark, sf).select("c_custkey", codecs.tag_split(s).alias("number"))


@query("SELECT c_custkey, array_to_string(list_transform(string_split(c_name, ''), lambda ch: unicode(ch)), ',') AS points FROM customer")
def codec_codepoints(spark, sf):
    return _names(spark, sf).select("c_custkey", F.array_join(codecs.code_points(F.col("c_name")), ",").alias("points"))


@query("SELECT c_custkey, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(left(c_name, 6), ''), lambda ch: unicode(ch)::HUGEINT)), lambda a, b: a * 1114112 + b) AS VARCHAR) AS number FROM customer")
def codec_bigint(spark, sf):
    return _names(spark, sf).select("c_custkey", codecs.short_bigint(F.substring("c_name", 1, 6)).cast("string").alias("number"))


# exact numbers of any size in SQL: limbs of nine decimal digits, the least first; a character needs less than one
_CARRY = "list_transform(range(1, len(a) + 1), lambda i: {0})"
_STEP = _CARRY.format("a[i] * 1114112 % 1000000000 + CASE WHEN i = 1 THEN b[1] ELSE a[i - 1] * 1114112 // 1000000000 END")
_SETTLE = _CARRY.format("a[i] % 1000000000 + CASE WHEN i = 1 THEN 0 ELSE a[i - 1] // 1000000000 END")
_ZEROS = "list_transform(range(length(c_name) + 1), lambda i: 0::BIGINT)"


@query(f"WITH l AS (SELECT c_custkey, c_name, list_reduce(list_prepend({_ZEROS}, list_transform(string_split(c_name, ''), lambda ch: [unicode(ch)::BIGINT])), lambda a, b: {_STEP}) AS x FROM customer WHERE c_name <> ''), s AS (SELECT c_custkey, list_reduce(list_prepend(x, list_transform(range(length(c_name) + 1), lambda i: [i])), lambda a, b: {_SETTLE}) AS x FROM l) SELECT c_custkey, ltrim(array_to_string(list_transform(list_reverse(x), lambda d: lpad(CAST(d AS VARCHAR), 9, '0')), ''), '0') AS number FROM s UNION ALL SELECT c_custkey, CASE WHEN c_name = '' THEN '0' END FROM customer WHERE c_name IS NULL OR c_name = ''")
def codec_bigint_whole(spark, sf):
    return _names(spark, sf).select("c_custkey", codecs.long_bigint(F.col("c_name")).alias("number"))


# ---- pages and plans ----------------------------------------------------------------------------

P_START, P_END, P_STEP = START + 1000, START + 5 * W, 1 << 24
TAG_STEP = 64
PAGES = f"SELECT (p - {P_START}) // {P_STEP} AS page, p AS page_start, least(p + {P_STEP}, {P_END}) AS page_end FROM (SELECT unnest(generate_series({P_START}, {P_END - 1}, {P_STEP})) AS p)"


def _tags(spark, sf) -> DataFrame:
    return v_orders(spark, sf).select("tag_id")


@query(PAGES)
def time_pages(spark, sf):
    return pages.time_pages(spark, P_START, P_END, P_STEP)


@query(f"SELECT tag_id - tag_id % {TAG_STEP} AS tag_page, array_to_string(list_sort(list(DISTINCT tag_id)), ',') AS tags FROM ({ORD}) GROUP BY 1")
def tag_pages(spark, sf):
    return pages.tag_pages(_tags(spark, sf), TAG_STEP).select("tag_page", F.array_join(F.col("tags").cast("array<string>"), ",").alias("tags"))


@query(f"WITH t AS ({PAGES}), g AS (SELECT DISTINCT tag_id - tag_id % {TAG_STEP} AS tag_page FROM ({ORD})) SELECT row_number() OVER (ORDER BY tag_page, page) - 1 AS step, page, tag_page FROM t, g")
def step_order(spark, sf):
    return pages.step_order(pages.time_pages(spark, P_START, P_END, P_STEP), pages.tag_pages(_tags(spark, sf), TAG_STEP))


@query(f"WITH t AS (SELECT DISTINCT tag_id FROM ({ORD})), g AS (SELECT tag_id - tag_id % 512 AS tag_bucket, count(*) AS n_tags FROM t GROUP BY 1), b AS (SELECT unnest(generate_series({P_START - P_START % W}, {P_END - 1}, {W})) AS time_bucket) SELECT {CELL} AS cell, {PATH} AS path, {DJB.format(f'({CELL})')} % 10 AS worker, n_tags, greatest(time_bucket, {P_START}) AS range_start, least(time_bucket + {W}, {P_END}) AS range_end FROM g, b")
def plan_range(spark, sf):
    return pages.plan_range(pages.time_pages(spark, P_START, P_END, P_STEP), _tags(spark, sf))


STATS = f"SELECT tag_bucket, time_bucket, count(*) AS samples, min(insert_time) AS birth, max(insert_time) AS last_write FROM (SELECT {CELLS} FROM ({RAW})) GROUP BY 1, 2"


@query(STATS)
def cell_stats(spark, sf):
    return stats.cell_stats(v_raw(spark, sf))


@query(f"SELECT * FROM ({STATS}) WHERE 5000 - birth <= 4000")
def ttl_prune(spark, sf):
    return stats.live_cells(v_raw(spark, sf), 5000, 4000)


@query(f"WITH c AS (SELECT {CELLS} FROM ({RAW})) SELECT tag_id, sample_time, insert_time, (row_number() OVER (PARTITION BY tag_bucket, time_bucket ORDER BY CAST(tag_id AS VARCHAR), sample_time, insert_time) - 1) // 100 AS page FROM c")
def row_pages(spark, sf):
    numbered = aggregates.numbered_pages(grid.with_cells(v_raw(spark, sf)).withColumn("tag", F.col("tag_id").cast("string")), ["tag_bucket", "time_bucket"], ["tag", "sample_time", "insert_time"], 100)
    return numbered.select("tag_id", "sample_time", "insert_time", "page")


# ---- lambdas ------------------------------------------------------------------------------------

PAGE = "tag_id long, sample_time long, n_value double"


def _plain(spark, sf) -> DataFrame:
    return latest_version(v_dup(spark, sf)).select("tag_id", "sample_time", "n_value")


@query(f"WITH v AS (SELECT * FROM ({DUP}) {LATEST}) SELECT tag_id, sample_time, n_value * 2 + 1 AS n_value FROM v")
def lambda_map(spark, sf):
    return aggregates.map_pages(_plain(spark, sf), lambda p: p.assign(n_value=p.n_value * 2 + 1), PAGE)


@query(f"WITH v AS (SELECT * FROM ({DUP}) {LATEST}) SELECT tag_id, sample_time, n_value FROM v WHERE n_value > 50")
def lambda_filter(spark, sf):
    return aggregates.map_pages(_plain(spark, sf), lambda p: p[p.n_value > 50], PAGE)


@query(f"WITH v AS (SELECT * FROM ({DUP}) {LATEST}), n AS (SELECT tag_id, (row_number() OVER (PARTITION BY tag_id ORDER BY sample_time) - 1) // 10 AS page, sample_time FROM v) SELECT tag_id, page, count(*) AS samples, min(sample_time) AS first_time, max(sample_time) AS last_time FROM n GROUP BY 1, 2")
def lambda_per_page(spark, sf):
    each = lambda p: p.group_by(["tag_id", "page"], use_threads=False).aggregate([([], "count_all"), ("sample_time", "min"), ("sample_time", "max")])
    one = lambda p: each(p).select(["tag_id", "page", "count_all", "sample_time_min", "sample_time_max"])
    return aggregates.map_numbered(_plain(spark, sf), ["tag_id"], ["sample_time"], 10, one, "tag_id long, page long, samples long, first_time long, last_time long")


@query(f"WITH v AS (SELECT * FROM ({DUP}) {LATEST}) SELECT tag_id, count(*) AS samples FROM v WHERE n_value > 50 GROUP BY 1")
def map_reduce(spark, sf):
    return aggregates.count_per_tag(lambda_filter(spark, sf))


@query(f"WITH v AS (SELECT * FROM ({RAW}) WHERE {IN_TAGS} AND {IN_TIME} {LATEST}) SELECT tag_id, count(*) AS samples FROM v GROUP BY 1")
def count_per_tag(spark, sf):
    return aggregates.count_per_tag(latest_within(v_raw(spark, sf)))


@query(f"WITH v AS (SELECT * FROM ({RAW}) {LATEST}) SELECT tag_id, count(*) AS samples FROM v GROUP BY 1")
def count_per_tag_whole(spark, sf):
    return aggregates.count_per_tag(latest_version(v_raw(spark, sf)))


def folded_counts(spark, df: DataFrame) -> DataFrame:
    def step(first, last, page, acc):
        acc = acc or {}
        for row in page or []:
            acc[row.tag_id] = acc.get(row.tag_id, 0) + row.samples
        return (sorted(acc.items()) if last else None), acc

    # partial counts of each page of samples go to the fold, never the samples themselves
    partial = aggregates.map_pages(df.select("tag_id"), lambda p: p.groupby("tag_id").size().reset_index(name="samples"), "tag_id long, samples long")
    found = list(aggregates.fold(partial, step))[-1]
    return spark.createDataFrame(found, "tag_id long, samples long")


@query(f"WITH v AS (SELECT * FROM ({RAW}) WHERE {IN_TAGS} AND {IN_TIME} {LATEST}) SELECT tag_id, count(*) AS samples FROM v GROUP BY 1")
def fold_generic(spark, sf):
    return folded_counts(spark, latest_within(v_raw(spark, sf)))


@query(f"WITH v AS (SELECT * FROM ({RAW}) {LATEST}) SELECT tag_id, count(*) AS samples FROM v GROUP BY 1")
def fold_generic_whole(spark, sf):
    return folded_counts(spark, latest_version(v_raw(spark, sf)))


@query(f"WITH v AS (SELECT * FROM ({DUP}) {LATEST}) SELECT tag_id, max(sample_time) AS sample_time, arg_max(n_value, sample_time) AS n_value FROM v GROUP BY 1")
def latest(spark, sf):
    return aggregates.latest_per_tag(latest_version(v_dup(spark, sf)))


@query(f"WITH v AS ({DUP}) SELECT * FROM v {LATEST}")
def raw(spark, sf):
    return dup_grid(spark, sf).scan(all_tags(spark, sf), 0, FOREVER).select(*CORE)


# sums of doubles differ in their last digits by the order of rows, so both sides are rounded far below the values' own digits


@query(f"WITH v AS (SELECT * FROM ({DUP}) {LATEST}) SELECT tag_id, round(sum(n_value), 6) AS total FROM v GROUP BY 1")
def sum_total(spark, sf):
    return aggregates.sum_per_tag(latest_version(v_dup(spark, sf))).withColumn("total", F.round("total", 6))


@query(f"WITH v AS (SELECT * FROM ({DUP}) {LATEST}) SELECT tag_id, sample_time - sample_time % 86400000 AS day_ms, round(sum(n_value), 6) AS total FROM v GROUP BY 1, 2")
def sum_daily(spark, sf):
    return aggregates.sum_daily(latest_version(v_dup(spark, sf))).withColumn("total", F.round("total", 6))


@query(f"WITH v AS (SELECT * FROM ({RAW}) {LATEST}) SELECT tag_id, sample_time - sample_time % 1800000 AS window_ms, round(avg(n_value), 6) AS mean FROM v GROUP BY 1, 2")
def avg_window_1800(spark, sf):
    return aggregates.avg_window(latest_version(v_raw(spark, sf)), 1800).withColumn("mean", F.round("mean", 6))


# ---- generators ---------------------------------------------------------------------------------


@query("SELECT 100 + 3 * range AS tag_id FROM range(500)")
def gen_tags(spark, sf):
    return generators.generate_tags(spark, 100, 500, 3)


@query("SELECT 10 + range // 1000 AS tag_id, (range % 1000) * 1000 AS sample_time, CAST((range % 1000) * 1000 AS DOUBLE) AS n_value FROM range(20000)")
def gen_samples(spark, sf):
    return generators.generate_samples(spark, 20, 1000, 10).select("tag_id", "sample_time", "n_value")


@query("SELECT range AS sample_time, range AS insert_time, CAST(range AS DOUBLE) AS n_value, 'Tag' || (range - range % 86400) || '-p' AS tag FROM range(432000)")
def gen_mock(spark, sf):
    return generators.generate_mock(spark, "p").select("sample_time", "insert_time", "n_value", "tag")
