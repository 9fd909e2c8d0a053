"""Language-model scoring from a log-frequency Bloom filter over n-gram counts.

A count c is held as level q = 1 + floor(log2(c)): the filter stores the n-gram with each number 1..q, and a reader
probes 1, 2, ... until the first miss, at four spots each; words, of which there are fewer, have more bits each. Unigrams and bigrams share the filter, sharded by n-gram hash. Levels are read
back as the mean training count of their level, so totals stay unbiased, and bigram and add-one unigram estimates are
interpolated: p(w | v) = WEIGHT * c(v, w) / c(v) + (1 - WEIGHT) * p(w).

Texts travel in chunks of bounded size. Each chunk sends its words and bigrams packed by shard; shards add them up,
build their part of the filter and send exact word counts back for the base score. While the filter is at most
BROADCAST_BYTES it is broadcast; a larger one stays in its shards, which answer the chunks' n-grams there, with the
same results.

Defined cases: a null or empty text is its end alone (one token); rows that repeat score alike; with no training rows
N = V = 0 and every token has probability 1; words whose counts tie share a level; a null doc_id stays null, ids are cast
to long and other columns are left out; an empty table gives an empty result; whole texts are read, whatever their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, session_of, small_batches, span_hashes

CHUNK_BYTES, SHARD_ENTRIES, BROADCAST_BYTES = 1_500_000, 1_000_000, 256_000_000
WORD_BITS, BIGRAM_BITS, WEIGHT, LEVELS = 20, 8, 0.2, 64
END = b"\n"
#: N-grams that are hashed together when a filter is built; its result does not depend on it.
PIECE = 1 << 16
CHUNK = "chunk long, ids binary, held binary, texts binary, bytes long"


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) -> packed chunks of about CHUNK_BYTES; a longer text is a chunk of its own."""
    ids, held, texts, size, count = [], [], [], 0, 0
    part = TaskContext.get().partitionId()

    def flush():
        bodies = b"\n".join(b" ".join(t.lower().split()) for t in texts)  # no word holds a newline
        nulls = np.array([i is None for i in ids], np.uint8)
        packed = np.array([i or 0 for i in ids], np.int64).tobytes() + nulls.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | count], pa.int64()), pa.array([packed], pa.binary()), pa.array([np.array(held, np.uint8).tobytes()], pa.binary()), pa.array([zlib.compress(bodies, 1)], pa.binary()), pa.array([len(bodies)], pa.int64())], ["chunk", "ids", "held", "texts", "bytes"])

    for batch in batches:
        for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if texts and size + len(raw) > CHUNK_BYTES:
                yield flush()
                ids, held, texts, size, count = [], [], [], 0, count + 1
            ids.append(i), held.append(bool(h)), texts.append(raw)
            size += len(raw) + 1
    if texts:
        yield flush()


class Chunk:
    """Words of a chunk as numbers into its vocabulary, which is in order of appearance."""

    def __init__(self, row: dict):
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        raw = row["ids"]
        n = len(self.held)
        self.ids = [None if z else int(i) for i, z in zip(np.frombuffer(raw[: 8 * n], np.int64), np.frombuffer(raw[8 * n :], np.uint8))]
        vocab = {END: 0}
        numbers, lengths = [], []
        for line in zlib.decompress(row["texts"]).split(b"\n"):
            words = line.split(b" ") if line else []
            numbers += [vocab.setdefault(w, len(vocab)) for w in words]
            numbers.append(0)
            lengths.append(len(words) + 1)
        self.words = list(vocab)
        self.tokens = np.array(numbers, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.doc = np.repeat(np.arange(n), self.lengths)
        self.before = np.concatenate(([0], self.tokens[:-1]))  # a text follows an end
        ends = np.cumsum([len(w) + 1 for w in self.words])
        data = np.frombuffer(b"\0".join(self.words) + b"\0", np.uint8)
        self.hashes = span_hashes(data, np.concatenate(([0], ends[:-1])), ends - 1)

    def bigrams(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(self.hashes[self.before] * np.uint64(0xD1342543DE82EF95) + self.hashes[self.tokens])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, as a chunk's row is long."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _by_shard(h: np.ndarray, shards: int) -> list[np.ndarray]:
    """For each shard that has some: the places of its hashes, in order."""
    shard = (h >> np.uint64(8)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(x)]


def _shard_of(h: np.uint64, shards: int) -> int:
    return int((int(h) >> 8) % shards)


MESSAGE = "what string, chunk long, shard long, keys binary, counts binary"


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["what", "chunk", "shard", "keys", "counts"])


def _packed(what: str, chunk: int, h: np.ndarray, n: np.ndarray, shards: int) -> list[tuple]:
    return [(what, chunk, _shard_of(h[at[0]], shards), h[at].tobytes(), n[at].astype(np.uint32).tobytes()) for at in _by_shard(h, shards)]


def _sender(word_shards: int, bigram_shards: int):
    """What a chunk tells each shard: all its words with their training counts, and its training texts' bigrams with theirs."""

    def run(batches):
        for row in _rows(batches):
            c = Chunk(row)
            learned = ~c.held[c.doc]
            trained = np.bincount(c.tokens[learned], minlength=len(c.words))
            out = [("words", row["chunk"], _shard_of(c.hashes[at[0]], word_shards), b" ".join([c.words[i] for i in at.tolist()]), trained[at].astype(np.uint32).tobytes()) for at in _by_shard(c.hashes, word_shards)]
            yield _messages(out + _packed("bigrams", row["chunk"], *np.unique(c.bigrams()[learned], return_counts=True), bigram_shards))

    return run


def _asker(bigram_shards: int):
    """The distinct bigrams of a chunk by shard."""

    def run(batches):
        for row in _rows(batches):
            h = np.unique(Chunk(row).bigrams())
            yield _messages(_packed("asked", row["chunk"], h, np.zeros(len(h), np.uint32), bigram_shards))

    return run


# ---- the filter ---------------------------------------------------------------------------------


_LOW = np.uint64(0xFFFFFFFF)


def _level_hash(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h + np.uint64(level) * np.uint64(0x9FB21C651E98DF25))


def _next_hash(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(g + np.uint64(0x2545F4914F6CDD1D))


def _spots(g: np.ndarray, bits) -> tuple[np.ndarray, np.ndarray]:
    """Two spots below bits (less than 2^32) from the halves of a hash."""
    half = np.uint64(32)
    return ((g >> half) * bits) >> half, ((g & _LOW) * bits) >> half


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)), 0 for 0."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1)) + 1e-12).astype(np.int64) + 1, 0)


def build_filter(h: np.ndarray, counts: np.ndarray, bits_per_entry: int = BIGRAM_BITS) -> tuple[bytes, np.ndarray]:
    """The bits of a shard, and by level (types, sum of counts)."""
    pieces = [slice(i, i + PIECE) for i in range(0, len(h), PIECE)]
    level = np.concatenate([np.zeros(0, np.uint8), *(level_of(counts[x]).astype(np.uint8) for x in pieces)])
    bits = max(64, -(-int(level.sum(dtype=np.int64)) * bits_per_entry // 64) * 64)
    out, stats = np.zeros(bits, bool), np.zeros((2, LEVELS))
    for x in pieces:
        own, of = h[x], level[x]
        stats += [np.bincount(of, minlength=LEVELS)[:LEVELS], np.bincount(of, weights=counts[x], minlength=LEVELS)[:LEVELS]]
        for q in range(1, int(of.max(initial=0)) + 1):
            g = _level_hash(own[of >= q], q)
            for spot in _spots(g, np.uint64(bits)) + _spots(_next_hash(g), np.uint64(bits)):
                out[spot.astype(np.int64)] = True
    stats[:, 0] = 0
    return np.packbits(out, bitorder="little").tobytes(), stats


class Filter:
    """Shards of one order side by side."""

    def __init__(self, shards: int, parts: dict[int, bytes]):
        self.shards = shards
        self.data = np.frombuffer(b"".join(parts.get(i, b"\0" * 8) for i in range(shards)), np.uint8)
        sizes = np.array([len(parts.get(i, b"\0" * 8)) for i in range(shards)], np.int64)
        self.start, self.bits = (np.cumsum(sizes) - sizes) * 8, (sizes * 8).astype(np.uint64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        shard = ((h >> np.uint64(8)) % np.uint64(self.shards)).astype(np.int64)
        out = np.zeros(len(h), np.uint8)
        live, bits, start = np.arange(len(h)), self.bits[shard], self.start[shard]
        for q in range(1, LEVELS):
            if not len(live):
                break
            g = _level_hash(h[live], q)
            for second in (False, True):
                g = _next_hash(g) if second else g
                for half in (0, 1):  # what misses a spot leaves at once
                    spot = _spots(g, bits)[half].astype(np.int64) + start
                    ok = (self.data[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
                    live, g, bits, start = live[ok], g[ok], bits[ok], start[ok]
            out[live] = q
        return out


ANSWER = "what string, chunk long, shard long, data binary, more binary"


def _answer(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["what", "chunk", "shard", "data", "more"])


def _add(shards: int):
    return lambda table: _add_words(table, shards) if table.column("what")[0].as_py() == "words" else _add_bigrams(table)


def _numbers(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The numbers packed in each value, not copied."""
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _words(column: pa.ChunkedArray) -> pa.DictionaryArray:
    """The words of all messages in a row, without an object for each."""
    data = np.frombuffer(b" ".join([*(x.as_buffer() for x in column), b""]), np.uint8)
    space = data == 32
    ends = np.flatnonzero(space)
    ends -= np.arange(len(ends))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(data[~space])]).dictionary_encode()


def _add_words(table: pa.Table, shards: int) -> pa.Table:
    """A shard of words: exact counts and levels to each chunk, the shard's filter, and totals."""
    shard = table.column("shard")[0].as_py()
    counts = _numbers(table.column("counts"), np.uint32)
    words = _words(table.column("keys"))
    number, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    total, at = np.zeros(len(names), np.int64), 0
    for x in counts:  # a message has a word once
        total[number[at : at + len(x)]] += x
        at += len(x)
    ends = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1]
    h = span_hashes(np.frombuffer(names.buffers()[2], np.uint8)[: ends[-1]], ends[:-1], ends[1:])
    seen = total > 0
    bits, stats = build_filter(h[seen], total[seen], WORD_BITS)
    levels = Filter(shards, {shard: bits}).levels(h)
    short = total.astype(_width(int(total.max(initial=0))))
    rows, at = [("words", None, shard, bits, stats.tobytes())], 0
    for chunk, x in zip(table.column("chunk").to_pylist(), counts):
        own = number[at : at + len(x)]
        rows.append(("counts", chunk, shard, short[own].tobytes(), levels[own].tobytes()))
        at += len(x)
    return _answer(rows)


def _width(most: int) -> type:
    """Of counts up to `most`; readers know it by the levels beside them, a byte each."""
    return np.uint32 if most < 1 << 32 else np.int64


def _add_bigrams(table: pa.Table) -> pa.Table:
    """The hashes of a message are in order, so they are added up range by range, each of some PIECEs."""
    shard = table.column("shard")[0].as_py()
    keys, counts = _numbers(table.column("keys"), np.uint64), _numbers(table.column("counts"), np.uint32)
    bits = (sum(map(len, keys)) // (4 * PIECE)).bit_length()
    starts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    ends = [[0, *np.searchsorted(k, starts).tolist(), len(k)] for k in keys]
    merged = [_merged([k[e[i] : e[i + 1]] for k, e in zip(keys, ends)], [n[e[i] : e[i + 1]] for n, e in zip(counts, ends)]) for i in range(1 << bits)]
    data, stats = build_filter(np.concatenate([h for h, _ in merged]), np.concatenate([n for _, n in merged]))
    return _answer([("bigrams", None, shard, data, stats.tobytes())])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their counts."""
    h = np.concatenate(keys)
    if not len(h):
        return h, np.zeros(0, np.int64)
    order = np.argsort(h)
    h, n = h[order], np.concatenate(counts)[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[start], np.add.reduceat(n, start, dtype=np.int64)


def _probe_shard(shards: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _answer([])
        own = Filter(shards, {s: d for s, d in zip(held.column("shard").to_pylist(), held.column("data").to_pylist())})
        keys = asked.column("keys").to_pylist()
        return _answer([("levels", c, s, own.levels(np.frombuffer(k, np.uint64)).tobytes(), None) for c, s, k in zip(asked.column("chunk").to_pylist(), asked.column("shard").to_pylist(), keys)])

    return run


# ---- scoring ------------------------------------------------------------------------------------


def _scorer(model, word_shards: int, bigram_shards: int, n: int, v: int, mean1: np.ndarray, mean2: np.ndarray):
    unseen = float(n + v + 1)
    total1 = float(mean1[LEVELS]) + v + 1

    def run(batches):
        filters = model.value
        for row in _rows(batches):
            c = Chunk(row)
            exact, level = np.zeros(len(c.words), np.int64), np.zeros(len(c.words), np.uint8)
            sent = {a["shard"]: a for a in row["counts"]}
            for at in _by_shard(c.hashes, word_shards):
                own = sent[_shard_of(c.hashes[at[0]], word_shards)]
                exact[at] = np.frombuffer(own["data"], np.uint32 if len(own["data"]) == 4 * len(at) else np.int64)
                level[at] = np.frombuffer(own["more"], np.uint8)
            base = np.log10((exact + 1) / unseen)[c.tokens]
            if filters:
                level = filters["words"].levels(c.hashes)
            about = mean1[level]
            h = c.bigrams()
            if filters:
                pairs = mean2[filters["bigrams"].levels(h)]
            else:
                own, back = np.unique(h, return_inverse=True)
                level = np.zeros(len(own), np.uint8)
                sent = {a["shard"]: a["data"] for a in row["levels"]}
                for at in _by_shard(own, bigram_shards):
                    level[at] = np.frombuffer(sent[_shard_of(own[at[0]], bigram_shards)], np.uint8)
                pairs = mean2[level][back]
            p1 = (about[c.tokens] + 1) / total1
            before = about[c.before]
            pairs = np.where(about[c.tokens] > 0, np.minimum(pairs, before), 0.0)  # no bigram without its words
            p = WEIGHT * pairs / np.maximum(before, 1.0) + (1 - WEIGHT) * p1
            docs = len(c.lengths)
            score = np.bincount(c.doc, weights=np.log10(np.minimum(p, 1.0)), minlength=docs)
            known = np.bincount(c.doc, weights=exact[c.tokens] > 0, minlength=docs).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(c.lengths), pa.array(known), pa.array(np.full(docs, n, np.int64)), pa.array(np.bincount(c.doc, weights=base, minlength=docs)), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _means(rows: list, what: str) -> np.ndarray:
    """By level the mean count, of a level without n-grams (which a wrong probe may name) that of the one below; at LEVELS the sum of counts."""
    stats = sum((np.frombuffer(r.more, np.float64).reshape(2, LEVELS) for r in rows if r.what == what), np.zeros((2, LEVELS)))
    means = stats[1] / np.maximum(stats[0], 1)
    return np.append(means[np.maximum.accumulate(np.where(stats[0] > 0, np.arange(LEVELS), 0))], stats[1].sum())


def score_texts(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs: (doc_id, held_out, text); learns from the rows not held out and scores all."""
    spark = session_of(docs)
    small_batches(spark)
    chunks = cut(docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(_chunker, CHUNK), "chunks")
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    word_shards = int(max(24, size // 30 // SHARD_ENTRIES))
    bigram_shards = int(max(24, size // 8 // SHARD_ENTRIES))
    cores = spark.sparkContext.defaultParallelism
    few = chunks.repartition(cores) if chunks.rdd.getNumPartitions() < cores else chunks
    counted = cut(few.mapInArrow(_sender(word_shards, bigram_shards), MESSAGE).groupBy("what", "shard").applyInArrow(_add(word_shards), ANSWER), "counts")
    shards = counted.where("what in ('words', 'bigrams')")  # one row a shard
    small = shards.select("what", "more").collect()
    mean1, mean2 = _means(small, "words"), _means(small, "bigrams")
    n = int(round(mean1[LEVELS]))
    v = int(sum(np.frombuffer(r.more, np.float64).reshape(2, LEVELS)[0].sum() for r in small if r.what == "words"))
    total = shards.agg(F.sum(F.length("data").cast("long"))).first()[0] or 0

    def load(what, shards_of):
        return Filter(shards_of, {r.shard: r.data for r in shards.where(F.col("what") == what).select("shard", "data").collect()})

    counts = counted.where("what = 'counts'").groupBy("chunk").agg(F.collect_list(F.struct("shard", "data", "more")).alias("counts"))
    rows = chunks.join(counts.hint("shuffle_hash"), "chunk")  # texts are dealt, but not sorted
    filters = {}
    if total <= broadcast_bytes:
        filters = {"words": load("words", word_shards), "bigrams": load("bigrams", bigram_shards)}
    else:
        asked = few.mapInArrow(_asker(bigram_shards), MESSAGE)
        levels = asked.groupBy("shard").cogroup(shards.where("what = 'bigrams'").groupBy("shard")).applyInArrow(_probe_shard(bigram_shards), ANSWER)
        rows = rows.join(cut(levels, "levels").groupBy("chunk").agg(F.collect_list(F.struct("shard", "data")).alias("levels")).hint("shuffle_hash"), "chunk")
    model = spark.sparkContext.broadcast(filters)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_scorer(model, word_shards, bigram_shards, n, v, mean1, mean2), schema)
