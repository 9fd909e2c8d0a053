"""Shared pieces: durable cuts of lineage, bounded Arrow slices, vectorised words and shingles."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import hadoop_path, new_path

#: The characters that separate words.
SPACE = "\x20\x09-\x0d"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value) -> Iterator[None]:
    """A session setting for the time of a block."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def cut(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later steps survive lost executors without recomputing it.

    The shuffles of the write are deleted at its end, since nothing reads them any more.
    """
    spark = session_of(df)
    path = new_path(spark, tag)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = [path]
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut(), once what was made from them is written itself."""
    for table in tables:
        for path in table._cut_at:
            files, at = hadoop_path(session_of(table), path)
            files.delete(at, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts may be long, so fewer rows go to Python at once than by default.

    Spark reads the setting when a plan runs, which is after an operator has returned, so it holds for the session.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# ---- Arrow slices -------------------------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each followed by one newline, and the offsets of the texts (n + 1 of them)."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    return data, np.concatenate(([0], ends)).astype(np.int64)


# ---- hashes -------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _TABLES["up"] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _BASE))))
            _TABLES["down"] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _INVERSE))))
    return _TABLES["up"], _TABLES["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans, from one running polynomial sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * down[: len(data)], dtype=np.uint64)))
        return mix64((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (n + 1 of them)."""
    space = _IS_SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, ends, np.searchsorted(starts, offsets)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles_of(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and, for each, its text; with fewer words, the whole sequence is one shingle."""
    n = len(words)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k if n >= k else 0):
            h = h * _BASE + words[i : n - k + 1 + i]
    at = owner[: len(h)]
    inside = at == owner[k - 1 :] if len(h) else np.zeros(0, bool)
    h, at = mix64(h[inside]), at[inside]
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k - 1):
                more = counts[few] > i
                own[more] = own[more] * _BASE + words[first[few[more]] + i]
            own = mix64(own + counts[few].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        h, at = np.concatenate((h, own)), np.concatenate((at, few))
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


# ---- distributed union-find ---------------------------------------------------------------------


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one set of edges: every node and the smallest node of its component."""
    nodes, idx = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))
    left, right = idx[: len(a)].tolist(), idx[len(a) :].tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(left, right):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def forest():
        nodes, root = _roots(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        keep = nodes != root
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes[keep], pa.int64()), "b": pa.array(root[keep], pa.int64())})

    for batch in batches:
        held.append((batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows > 1_000_000:  # the memory of a task stays bounded; what is left over merges in later rounds
            out = forest()
            yield out
            held, rows = [], 0
    if held:
        yield forest()


#: A forest of no more edges than this is finished by one task, which holds it in some tens of MB.
ONE_TASK_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, root): each node of an edge with the smallest node it reaches.

    Every partition first shrinks its edges to a star forest. While more than ONE_TASK_EDGES are left, large-star and
    small-star rounds over shuffled edges go on, each written to the shared folder; below it, one task ends the work.
    Null ends are ignored; no edges give no rows.
    """
    pair = "a long, b long"
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    now = cut(edges.mapInArrow(_local_forest, pair).distinct(), "forest")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state.n <= ONE_TASK_EDGES or state == seen:
            break
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.col("k")).alias("m"))
        joined = now.join(least, F.col("a") == F.col("k"))
        large = now.join(least, F.col("b") == F.col("k")).select("a", F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = cut(large.where("a <> b").distinct().mapInArrow(_local_forest, pair).distinct(), "forest")
        drop(now)
        now = new
    last = now.coalesce(1).mapInArrow(_local_forest, pair) if 0 < state.n <= ONE_TASK_EDGES else now
    rooted = last.groupBy("a").agg(F.min("b").alias("b"))
    found = rooted.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rooted.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = cut(found.unionByName(roots), "components")
    drop(now)
    return out
