"""Links between similar sets: banded registers, estimates inside buckets, exact verification, components.

Nodes are distinct sets with a register row each. Band keys travel packed by shard, so only keys that two nodes share
become rows, counted in the shard; a key that many nodes of one batch share is a message of its own, and two of its nodes stand
for it in the shard, so no shard gathers a hot key; the nodes of such keys alone are counted over all shards. Buckets are cut into blocks of bounded size. Round one links each block's likeliest
pairs as a forest. Round two looks at buckets whose nodes are still in several components: the nodes of the component
with the most of them (the major) meet the others (the strays), and strays meet each other, block by block; pairs that
the estimate can't rule out go out once, in the first band they share. Every pair is verified on full sets by the
caller, and only the texts of nodes in such pairs are fetched.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, mix64, session_of, setting

#: Spark's setting of the rows that go to Python at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Entries of packed band keys that one shard holds (16 bytes each, some 14 on their way), and nodes in a block of a bucket.
SHARD_ENTRIES, BLOCK = 2_000_000, 1000
#: Entries a task packs at a time, and nodes of a batch from which a key is hot.
PACKED, HOT = 1_000_000, 16
#: Rows of sketches that go to Python at once; texts never go with them.
SKETCHES = 4096
#: Spark's settings of Bloom filters below joins, and the size of bucket rows up to which one is made.
BLOOM, FILTERED = "spark.sql.optimizer.runtime.bloomFilter", "256MB"


def sketches_of(column: pa.Array) -> np.ndarray:
    """The 16-bit words of sketches one after the other; none is null."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(nodes, bands) 64-bit keys of consecutive register rows; the band is part of the key."""
    out = np.zeros((len(registers), bands), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + registers[:, i : bands * rows : rows].astype(np.uint64) + np.arange(1, bands + 1, dtype=np.uint64))
    return out


def _by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are neighbours but for rare others between them, and the keys' leading bits in that order."""
    bits = np.uint64(max(1, len(key)).bit_length())
    both = np.sort((key >> bits << bits) | np.arange(len(key), dtype=np.uint64))
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the leading bits, so that keys in order are in order of their shards."""
    return ((key >> np.uint64(44)).astype(np.int64) * shards) >> 20


def _thin(key: np.ndarray) -> bytes:
    """Keys as the first one and the steps from each to the next, in as many bytes as the largest step needs."""
    if not len(key):
        return b""
    step = np.diff(key)  # a step back, which is rare, is a large one
    width = (int(step.max(initial=0)).bit_length() + 7) // 8
    return key[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _thick(data: bytes, count: int) -> np.ndarray:
    """The keys of _thin()."""
    step = np.zeros((count, 8), np.uint8)
    if count:
        held = np.frombuffer(data, np.uint8)
        step[0] = held[:8]
        width = (len(held) - 8) // max(1, count - 1)
        step[1:, :width] = held[8:].reshape(count - 1, width)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def _packer(bands: int, rows: int, width: int, shards: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_n, count, counter = [], [], 0, itertools.count()

        def flush():
            node, once = np.unique(np.concatenate(held_n), return_index=True)  # so a hot key's first entries are of two nodes
            key, node = np.concatenate(held_k)[once].ravel(), np.repeat(node, bands)
            order, _ = _by_key(key)
            key, node = key[order], node[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            nth = np.arange(len(key)) - np.repeat(start, size)
            ready = (np.repeat(size, size) > HOT) & (nth >= 2)
            hot = np.unique(key[start[size > HOT]])
            hot_k, hot_n, key, node = key[ready], node[ready], key[~ready], node[~ready]
            shard, hot_at = _shard_of(key, shards), _shard_of(hot, shards)
            at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            ends = np.append(at[1:], len(shard))
            own = -1 - (TaskContext.get().partitionId() << 24) - next(counter)  # a shard for the hot keys' message alone
            keys = [_thin(key[a:b]) for a, b in zip(at, ends)] + [_thin(hot_k)]
            nodes = [node[a:b].tobytes() for a, b in zip(at, ends)] + [hot_n.tobytes()]
            marks = [hot[a:b].tobytes() for a, b in zip(np.searchsorted(hot_at, shard[at]), np.searchsorted(hot_at, shard[at], "right"))] + [b""]
            out = pa.RecordBatch.from_arrays([pa.array(np.append(shard[at], own), pa.int64()), pa.array(keys, pa.binary()), pa.array(nodes, pa.binary()), pa.array(marks, pa.binary())], ["shard", "keys", "nodes", "hot"])
            return out if len(hot_k) else out.slice(0, len(at))

        for batch in batches:
            if not batch.num_rows:
                continue
            registers = sketches_of(batch.column("sketch")).reshape(-1, width)
            held_k.append(band_keys(registers, bands, rows))
            held_n.append(batch.column("node").to_numpy(zero_copy_only=False))
            count += held_k[-1].size
            if count > PACKED:
                yield flush()
                held_k, held_n, count = [], [], 0
        if count:
            yield flush()

    return pack


def _shared_keys(table: pa.Table) -> pa.Table:
    """The entries of a shard whose key several nodes have, each once, with the key's number of nodes; of a message with a
    shard of its own, all. The number is 0 where a key is hot in some batch, so that other shards hold nodes of it too."""
    nodes = [np.frombuffer(x, np.int64) for x in table.column("nodes").to_pylist()]
    key = np.concatenate([_thick(x, len(n)) for x, n in zip(table.column("keys").to_pylist(), nodes)])
    node = np.concatenate(nodes)
    usual = table.column("shard")[0].as_py() >= 0
    if usual:
        order, leading = _by_key(key)
        same = leading[1:] == leading[:-1]
        many = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(key) else order
        key, node = key[many], node[many]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]))) if len(key) else np.zeros(0, bool)
    key, node, size = key[new], node[new], np.zeros(new.sum(), np.int64)
    if usual and len(key):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        size = np.repeat(size, size)
        key, node, size = key[size > 1], node[size > 1], size[size > 1]  # a hot key has two nodes here
        size[np.isin(key, np.frombuffer(b"".join(table.column("hot").to_pylist()), np.uint64))] = 0
    return pa.table({"bucket": pa.array(key.view(np.int64)), "node": pa.array(node), "size": pa.array(size)})


def shared_buckets(nodes: DataFrame, count: int, bands: int, rows: int, width: int, full: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes: (node, n, sketch, more columns), repeats allowed -> (bucket, node, size) of buckets with several nodes, and
    the rows of the nodes in them, one for each. count: about how many nodes there are; full: see linked_components()."""
    shards = max(32, count * bands // SHARD_ENTRIES + 1)
    packed = nodes.select("node", "sketch").mapInArrow(_packer(bands, rows, width, shards), "shard long, keys binary, nodes binary, hot binary")
    with setting(session_of(nodes), BATCH, SKETCHES):
        shared = cut(packed.groupBy("shard").applyInArrow(_shared_keys, "bucket long, node long, size long"), "buckets")
    # a hot key's nodes come from several tasks, and a node may have been packed more than once
    split = shared.where("size = 0").select("bucket", "node").distinct()
    sizes = split.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").hint("shuffle_hash")
    sized = cut(shared.where("size > 0").unionByName(split.join(sizes, "bucket")), "sized-buckets")
    drop(shared)
    # The bucket rows are the hashed side, so the wide rows are dealt but not sorted. While they are few, Spark drops wide
    # rows by a Bloom filter (of 8 MB at most) before the shuffle; beyond FILTERED all go through it, with the same result.
    own = sized.select("node").where(F.col("size") > 1).hint("shuffle_hash")
    wide = nodes.drop("sketch") if full else nodes
    with setting(session_of(nodes), f"{BLOOM}.applicationSideScanSizeThreshold", "0"), setting(session_of(nodes), f"{BLOOM}.creationSideThreshold", FILTERED):
        needed = wide.join(own, "node", "left_semi").dropDuplicates(["node"])
        needed = cut(full(needed) if full else needed, "needed")
    return sized, needed


# ---- estimates ----------------------------------------------------------------------------------


def parities_of(h: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """(sets, bits / 16) 16-bit words for distinct hashes, the sets beginning at `starts`; bits is a power of two.

    Each bit tells whether an odd number of a set's hashes fell on it.
    """
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    bit = (h >> np.uint64(20)).astype(np.int64) & (bits - 1)
    odd = np.bincount(owner * bits + bit, minlength=len(starts) * bits) & 1
    return np.packbits(odd.astype(bool).reshape(len(starts), bits), axis=1).view(np.uint16)


def parity_allows(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """False only where the sets can't reach the threshold: bits that differ are never more than the elements that do."""
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    return np.bitwise_count(a ^ b).sum(axis=1) <= (na + nb) * (1 - threshold) / (1 + threshold) + 1e-9


def minhash_estimate(threshold: float, width: int) -> Callable:
    """Keeps pairs whose share of equal registers is within 4.5 standard errors of the threshold or above.

    A set of few elements fills few registers itself, so its standard error counts those alone. The words after the
    first `width` are parity bits of the sets.
    """

    sizes = 64 * width  # of such sets on, all registers are their own
    own = width * (1 - (1 - 1 / width) ** np.arange(1, sizes + 1))
    least = width * (threshold - 4.5 * np.sqrt(threshold * (1 - threshold) / own))

    def keep(a, b, na, nb):
        fewer = np.minimum(na, nb)
        equal = np.bitwise_count(np.packbits(a[:, :width] == b[:, :width], axis=1)).sum(axis=1, dtype=np.int64)
        ok = (equal >= least[np.clip(fewer, 1, sizes) - 1]) & (fewer >= threshold * np.maximum(na, nb) - 1e-9)
        at = np.flatnonzero(ok)
        ok[at] = parity_allows(a[at, width:], b[at, width:], na[at], nb[at], threshold)
        return ok, equal

    return keep


def setsketch_estimate(threshold: float, base: float, width: int, slack: float = 10.0) -> Callable:
    """Keeps pairs by the joint likelihood of the counts of greater, smaller and equal registers, given both set sizes.

    A pair goes on unless every similarity of at least the threshold is less likely than the best one by `slack` in
    natural log. The words after the first `width` are parity bits of the sets.
    """
    part = (base - 1) / base
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * part) / np.log(base), 1e-9, 1 - 1e-9)

    def log_likelihood(j, more, less, same, u, v):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-9, 1))

    def keep(a, b, na, nb):
        possible = parity_allows(a[:, width:], b[:, width:], na, nb, threshold)
        a, b = a[:, :width], b[:, :width]
        more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
        same = width - more - less
        ok = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
        ok &= possible
        at = np.flatnonzero(ok)
        if len(at):
            u = na[at] / (na[at] + nb[at])
            v = 1 - u
            most = np.minimum(u / v, v / u)
            best_low, best_high = np.full(len(at), -np.inf), np.full(len(at), -np.inf)
            for step in np.linspace(0, 1, 17):
                best_low = np.maximum(best_low, log_likelihood(most * step, more[at], less[at], same[at], u, v))
                j = threshold + (most - threshold) * step
                best_high = np.maximum(best_high, log_likelihood(j, more[at], less[at], same[at], u, v))
            ok[at] = best_high >= best_low - slack
        return ok, same

    return keep


# ---- rounds -------------------------------------------------------------------------------------


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of rows that share `group`, from batches of a partition sorted by it."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names if k != "sketch"}
        now["sketch"] = sketches_of(batch.column("sketch")).reshape(batch.num_rows, -1)
        if rest is not None:
            now = {k: np.concatenate((rest[k], v)) for k, v in now.items()}
        cuts = np.flatnonzero(now["group"][1:] != now["group"][:-1])
        if len(cuts):
            end = cuts[-1] + 1
            yield {k: v[:end] for k, v in now.items()}
            now = {k: v[end:] for k, v in now.items()}
        rest = now
    if rest is not None and len(rest["group"]):
        yield rest


def _pairs_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size, 1)


def _pair_chunks(rows: dict[str, np.ndarray], most: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside the groups, never more than about `most` at once."""
    start = np.flatnonzero(np.concatenate(([True], rows["group"][1:] != rows["group"][:-1])))
    size = np.diff(np.append(start, len(rows["group"])))
    for s in np.unique(size):
        if s < 2:
            continue
        at = start[size == s]
        i, j = _pairs_of(int(s))
        if len(i) <= most:
            step = max(1, most // len(i))
            for k in range(0, len(at), step):
                base = at[k : k + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            for a in at:
                for k in range(0, len(i), most):
                    yield a + i[k : k + most], a + j[k : k + most]


def _round_one(keep: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["group", "node", "n", "sketch"]):
            found_a, found_b, found_s = [], [], []
            for i, j in _pair_chunks(rows):
                ok, same = keep(rows["sketch"][i], rows["sketch"][j], rows["n"][i], rows["n"][j])
                found_a.append(i[ok]), found_b.append(j[ok]), found_s.append(same[ok])
            if not found_a:
                continue
            a, b, same = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_s)
            order = np.argsort(-same, kind="stable")
            parent: dict[int, int] = {}

            def find(x):
                while parent.get(x, x) != x:
                    parent[x] = parent.get(parent[x], parent[x])
                    x = parent[x]
                return x

            out = []
            for x, y in zip(a[order].tolist(), b[order].tolist()):
                rx, ry = find(x), find(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    out.append((x, y))
            if out:
                x, y = np.array(out).T
                x, y = rows["node"][x], rows["node"][y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _round_two(keep: Callable, bands: int, rows_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["group", "node", "n", "sketch", "root", "stray", "own", "left", "right", "bucket"]):
            for i, j in _pair_chunks(rows):
                # where strays meet the major, such pairs alone; where strays meet, a pair of one block in that block's own group
                mixed = rows["left"][i] < 0
                ok = np.where(mixed, rows["stray"][i] != rows["stray"][j], (rows["root"][i] != rows["root"][j]) & ((rows["left"][i] == rows["right"][i]) | (rows["own"][i] != rows["own"][j])))
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                ok, _ = keep(rows["sketch"][i], rows["sketch"][j], rows["n"][i], rows["n"][j])
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                ka, kb = band_keys(rows["sketch"][i], bands, rows_), band_keys(rows["sketch"][j], bands, rows_)
                first = ka[np.arange(len(i)), (ka == kb).argmax(axis=1)].view(np.int64)
                here = first == rows["bucket"][i]
                x, y = rows["node"][i[here]], rows["node"][j[here]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _mixed_groups(rooted: DataFrame) -> DataFrame:
    """(bucket, node, root) -> the rows of buckets with several roots, once for each group they are compared in."""
    per_root = rooted.groupBy("bucket", "root").agg(F.count("*").alias("held"))
    per_bucket = per_root.groupBy("bucket").agg(F.max(F.struct("held", "root")).alias("top"), F.sum("held").alias("size"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda x: F.ceil(x / BLOCK).cast("long")
    mixed = per_bucket.select("bucket", F.col("top.root").alias("major"), blocks(F.col("top.held")).alias("majors"), blocks(F.col("size") - F.col("top.held")).alias("strays"))
    rows = rooted.join(mixed, "bucket").withColumn("stray", (F.col("root") != F.col("major")).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("stray") == 1, F.col("strays")).otherwise(F.col("majors"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda left, right, name: F.struct(left.alias("left"), right.alias("right"), name.alias("group"))
    with_major = lambda major, stray: pair(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.xxhash64("bucket", F.lit("major"), major, stray))
    with_strays = lambda o: pair(F.least("own", o), F.greatest("own", o), F.xxhash64("bucket", F.lit("strays"), F.least("own", o), F.greatest("own", o)))
    places = F.when(F.col("stray") == 0, F.transform(upto(F.col("strays")), lambda o: with_major(F.col("own"), o))).otherwise(F.concat(F.transform(upto(F.col("majors")), lambda o: with_major(o, F.col("own"))), F.transform(upto(F.col("strays")), with_strays)))
    return rows.withColumn("at", F.explode(places)).select("at.group", "node", "root", "stray", "own", "at.left", "at.right", "bucket")


def linked_components(nodes: DataFrame, count: int, texts: Callable[[DataFrame], DataFrame] | None, bands: int, rows: int, width: int, keep: Callable, verifier: Callable, full: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of every node with a verified link.

    nodes: (node, n, sketch), repeats allowed, with a column text if texts is None; count: about how many there are;
    texts: a table of nodes -> their (node, text), one row a node;
    verifier: Arrow batches of (a, b, text_a, text_b) -> the (a, b) that are links;
    full: if given, nodes holds (node, sketch, more columns) with the banded registers alone as sketch, and full makes
    (node, n, sketch, text) with whole sketches of the rows without sketch; only nodes in buckets pass it.
    """
    spark = session_of(nodes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized, needed = shared_buckets(nodes, count, bands, rows, width, full)
    sketches = needed.select("node", "n", "sketch").hint("shuffle_hash")  # one row a node, so that bucket rows are dealt but not sorted

    def verify(pairs: DataFrame) -> DataFrame:
        """The links among pairs; only the texts of their nodes are fetched."""
        if texts is None:
            return cut(with_texts(pairs, needed.select("node", "text")).mapInArrow(verifier, "a long, b long"), "links")
        wanted = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
        held = cut(texts(wanted), "texts")
        links = cut(with_texts(pairs, held).mapInArrow(verifier, "a long, b long"), "links")
        drop(wanted, held)
        return links

    group = F.xxhash64("bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK).cast("long"))).alias("group")
    dealt = sized.select(group, "node").join(sketches, "node").repartition(parts, "group").sortWithinPartitions("group")
    with setting(spark, BATCH, SKETCHES):
        first = cut(dealt.mapInArrow(_round_one(keep), "a long, b long").distinct(), "pairs")
    links = verify(first)
    found = components(links)
    stars = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))

    # of a bucket of two the first round has compared the only pair
    rooted = cut(sized.where("size > 2").select("bucket", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    dealt = _mixed_groups(rooted).join(sketches, "node").repartition(parts, "group").sortWithinPartitions("group")
    with setting(spark, BATCH, SKETCHES):
        second = cut(dealt.mapInArrow(_round_two(keep, bands, rows), "a long, b long").distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    drop(sized, rooted, links)
    if second.isEmpty():
        drop(first, second, needed)
        return found
    more = verify(second)
    out = components(stars.unionByName(more))
    drop(first, second, more, found, needed)
    return out


def with_texts(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b) pairs and (node, text), one row per node -> (a, b, text_a, text_b); pairs are hashed, so texts are not sorted."""
    left = held.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(pairs.hint("shuffle_hash"), "a")
    return held.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(left.hint("shuffle_hash"), "b").select("a", "b", "text_a", "text_b")
