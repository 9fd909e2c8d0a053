"""The grid as partitioned files: store, scan, compact."""

from __future__ import annotations

import dataclasses
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GridConfig, check_range
from ..functions.grid import bucket, connection_path, with_cells, write_affinity
from ..operators.mvcc import latest_version
from ..schema import SAMPLE_SCHEMA, flat_records
from .storage import Files, FileStorage, Storage

#: A tag list, or a list of tag buckets, up to this long becomes an IN list; a longer one a semi join.
IN_LIST = 1000
#: Facts about a base beside its data; names with an underscore are no data to Spark.
CONFIG_FILE, WRITES = "_grid.json", "_writes"
PLACED = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in SAMPLE_SCHEMA)}, tag_bucket long, time_bucket long"
PARQUET = FileStorage()


def plan_upserts(df: DataFrame, insert_time: int, config: GridConfig = GridConfig()) -> DataFrame:
    """Rows per (path, worker) when all are inserted at insert_time."""
    tag, at = bucket(F.col("tag_id"), config.tag_width), bucket(F.lit(insert_time).cast("long"), config.time_width)
    path = connection_path(tag, at, config)
    return df.groupBy(path.alias("path")).agg(F.count("*").alias("samples")).withColumn("worker", write_affinity(F.col("path"), config.workers))


def config_of(spark: SparkSession, base: str, config: GridConfig | None = None) -> GridConfig:
    """The settings a base was written with; a given one must agree, and stands in where a base has none."""
    files = Files(spark, base)
    if not files.exists(CONFIG_FILE):
        return config or GridConfig()
    held = files.read(CONFIG_FILE)
    own = GridConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})
    if config is not None and (config.tag_width, config.time_width) != (own.tag_width, own.time_width):
        raise ValueError(f"{base} has cells of {own.tag_width} tags and {own.time_width} ms, not {config.tag_width} and {config.time_width}")
    return own


def _keep_config(spark: SparkSession, base: str, config: GridConfig | None) -> GridConfig:
    own = config_of(spark, base, config)
    files = Files(spark, base)
    if not files.exists(CONFIG_FILE):
        files.mkdirs()
        files.write(CONFIG_FILE, dataclasses.asdict(own))
    return own


def _checked(df: DataFrame) -> DataFrame:
    """Tags and times are checked while they are written, so the input runs once."""
    ok = F.coalesce((F.col("tag_id") >= 0) & F.col("sample_time").isNotNull(), F.lit(False))
    why = F.lit("tags must not be negative, and tags and times must not be null")
    return df.withColumn("tag_id", F.when(ok, F.col("tag_id")).otherwise(F.raise_error(why).cast("long")))


def _write(placed: DataFrame, base: str, rows_per_file: int, storage: Storage) -> None:
    order = ["tag_bucket", "time_bucket", "tag_id", "sample_time"]
    storage.append(placed.repartitionByRange(*order).sortWithinPartitions(*order), base, rows_per_file)


def store(df: DataFrame, base: str, insert_time: int | None = None, config: GridConfig | None = None, rows_per_file: int = 5_000_000, unique: bool = False, stamped: bool = False, storage: Storage = PARQUET) -> dict:
    """Append samples as versions of insert_time (now, if not given), placed by sample time; returns what was done.

    Rows of a cell are spread by ranges of (cell, tag), so a hot cell is written by many tasks, and lie sorted by tag
    and time in each file. Of rows with equal tag and time the one with the greatest ingest_seq wins; without that
    column the later one in the order of df's partitions, which is the order of input where df was not shuffled.
    unique: the caller knows that no two rows of df share tag and time; reads use it to leave out the merge.
    stamped: rows keep insert times of their own, as when a grid is copied.
    """
    spark, began = df.sparkSession, time.time()
    insert_time = int(began * 1000) if insert_time is None else int(insert_time)
    config = _keep_config(spark, base, config)
    seq = F.col("ingest_seq") if "ingest_seq" in df.columns else F.monotonically_increasing_id()
    own = _checked(df.withColumn("ingest_seq", seq.cast("long")).withColumn("insert_time", (F.col("insert_time") if stamped else F.lit(insert_time)).cast("long"))).select(*SAMPLE_SCHEMA.names)
    planned = time.time()
    # noted before the data: a write that breaks off leaves its note behind, and the base then counts as one with several writers
    Files(spark, base).write(f"{WRITES}/{insert_time}-{uuid.uuid4().hex}.json", {"insert_time": insert_time, "unique": unique})
    _write(with_cells(own, config), base, rows_per_file, storage)
    return {"base": base, "insert_time": insert_time, "plan_seconds": planned - began, "write_seconds": time.time() - planned}


def store_flat(spark: SparkSession, records: dict[int, list], base: str, insert_time: int | None = None, config: GridConfig | None = None) -> dict:
    return store(flat_records(spark, records), base, insert_time, config)


def is_unique(spark: SparkSession, base: str) -> bool:
    """Whether all of a base comes from one write of unique keys, as compact() and store(unique=True) make."""
    files = Files(spark, base)
    notes = [n for n in files.names(WRITES) if n.endswith(".json")]
    return len(notes) == 1 and bool(files.read(f"{WRITES}/{notes[0]}")["unique"])


def read_bases(spark: SparkSession, bases: list[str], storage: Storage = PARQUET) -> DataFrame:
    """All shards; a missing one is empty."""
    found = [x for x in (storage.read(spark, base, PLACED) for base in bases) if x is not None]
    out = found[0] if found else spark.createDataFrame([], PLACED)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def in_cells(df: DataFrame, tags: list[int] | DataFrame, start: int, end: int, config: GridConfig) -> DataFrame:
    """Rows of the cells that the tags and the range touch, by partition columns alone, so that other files are not read."""
    check_range(start, end)
    w = config.time_width
    df = df.where(F.col("time_bucket").between(start - start % w, (end - 1) - (end - 1) % w))
    if isinstance(tags, DataFrame):
        few = tags.select(bucket(F.col("tag_id"), config.tag_width).alias("tag_bucket")).distinct().limit(IN_LIST + 1).collect()
        buckets = [r.tag_bucket for r in few]
    else:
        buckets = sorted({t - t % config.tag_width for t in tags})
    return df.where(F.col("tag_bucket").isin(sorted(buckets))) if 0 < len(buckets) <= IN_LIST else df


def within(df: DataFrame, tags: list[int] | DataFrame, start: int, end: int, config: GridConfig | None = None) -> DataFrame:
    """Rows of the tags with start <= sample_time < end; with a config also by cell, so that partitions are pruned."""
    check_range(start, end)
    df = df.where((F.col("sample_time") >= start) & (F.col("sample_time") < end))
    if config:
        df = in_cells(df, tags, start, end, config)
    if isinstance(tags, DataFrame):
        return df.join(tags.select("tag_id").distinct(), "tag_id", "left_semi")
    wanted = sorted(set(tags))
    if len(wanted) > IN_LIST:
        return df.join(df.sparkSession.createDataFrame([(t,) for t in wanted], "tag_id long"), "tag_id", "left_semi")
    return df.where(F.col("tag_id").isin(wanted))


def live(df: DataFrame, now: int, ttl: int) -> DataFrame:
    """Rows of cells born at most ttl before now; df has the cells' columns, and only insert times are read for it."""
    born = df.groupBy("tag_bucket", "time_bucket").agg(F.min("insert_time").alias("birth")).where(F.lit(now) - F.col("birth") <= ttl)
    return df.join(born.select("tag_bucket", "time_bucket"), ["tag_bucket", "time_bucket"], "left_semi")


def scan(spark: SparkSession, bases: list[str], tags, start: int, end: int, config: GridConfig | None = None, now: int | None = None, ttl: int | None = None, as_of: int | None = None, ordered: bool = False, assume_unique: bool | None = None, storage: Storage = PARQUET) -> DataFrame:
    """Latest-version samples of the tags in [start, end) over all shards.

    Each base is pruned by its own settings; a config that disagrees with them raises. ttl drops cells born more than
    ttl before now; as_of ignores later versions; ordered sorts by tag as text, then time. The merge of versions is left
    out where the bases' notes show that all comes from one write of unique keys; assume_unique overrides them.
    """
    check_range(start, end)
    parts = []
    for base in bases:
        own = config_of(spark, base, config)
        rows = storage.read(spark, base, PLACED)
        if rows is None:
            continue
        rows = in_cells(rows, tags, start, end, own)
        if ttl is not None:
            rows = live(rows, int(time.time() * 1000) if now is None else now, ttl)
        parts.append((base, within(rows, tags, start, end).select(*SAMPLE_SCHEMA.names)))
    found = parts[0][1] if parts else spark.createDataFrame([], SAMPLE_SCHEMA)
    for _, more in parts[1:]:
        found = found.unionByName(more)
    if as_of is not None:
        found = found.where(F.col("insert_time") <= as_of)
    unique = len(parts) < 2 and all(is_unique(spark, b) for b, _ in parts) if assume_unique is None else assume_unique
    found = latest_version(found, unique).select(*SAMPLE_SCHEMA.names)
    return found.orderBy(F.col("tag_id").cast("string"), "sample_time") if ordered else found


def last_write(spark: SparkSession, bases: list[str], tags, start: int, end: int, storage: Storage = PARQUET) -> int:
    """The latest insert time in the cells that the tags and the range touch, -1 if they are empty: valid results are not older."""
    newest = -1
    for base in bases:
        rows = storage.read(spark, base, PLACED)
        if rows is not None:
            newest = max(newest, in_cells(rows, tags, start, end, config_of(spark, base)).agg(F.max("insert_time")).first()[0] or -1)
    return newest


def compact(spark: SparkSession, base: str, target: str, config: GridConfig | None = None, rows_per_file: int = 5_000_000, storage: Storage = PARQUET) -> None:
    """Write the latest versions of a base to a new place, which then needs no merge."""
    own = _keep_config(spark, target, config_of(spark, base, config))
    latest = latest_version(read_bases(spark, [base], storage))
    Files(spark, target).write(f"{WRITES}/compact-{uuid.uuid4().hex}.json", {"insert_time": None, "unique": True})
    _write(with_cells(latest.drop("tag_bucket", "time_bucket"), own), target, rows_per_file, storage)
