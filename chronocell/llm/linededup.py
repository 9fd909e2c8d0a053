"""Fuzzy line dedup by MinHash.

Lines are compared without case and outer spaces. A line's shingles are its runs of SHINGLE bytes. Its signature is one
permutation of MinHash: the hashes fall into HASHES bins, the least hash of a bin is its register, and an empty bin takes
the register of the first filled bin in an order of its own, the same for all lines. Signatures are banded for high
recall; candidates are verified by the exact Jaccard of their shingle sets and joined by distributed union-find. Of each
component the line with the smallest (doc_id, place) stays.

Defined cases: empty lines always stay; a line shorter than a shingle is one shingle; a null text has no lines and
stays null; a document all of whose lines go keeps an empty text; with a null doc_id a line comes after all others, and
ties between rows that share an id go by the text's hash; rows equal in doc_id and text are one document and get the same
result; other columns stay, but n_lines and n_dropped take the place of columns of these names; an empty table gives an
empty result; whole texts are read, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, drop, fresh, session_of, slices, small_batches
from .simjoin import linked_components, minhash_estimate

SHINGLE, HASHES, BANDS, ROWS = 7, 64, 16, 4
#: Bits of a line's parity sketch, and of the hashes that tell its distinct shingles apart beside a line's number.
PARITY_BITS, DISTINCT_BITS = 512, 44
#: Bytes of text in one slice, pairs that are verified together, and lines a task remembers to have signed.
SLICE, PAIRS, REMEMBERED = 1 << 16, 256, 200_000
#: Lines that more than this share of all places hold: there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def _order() -> np.ndarray:
    """For each bin all bins, itself first, the others in an order drawn for it."""
    rng = np.random.default_rng(20)
    return np.array([np.concatenate(([b], rng.permutation(np.delete(np.arange(HASHES), b)))) for b in range(HASHES)])


_ORDER = _order()


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of lines as 56-bit numbers, and how many each line has; each line ends with one newline byte."""
    lengths = np.diff(offsets) - 1
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    whole = np.ones(len(data) + SHINGLE, bool)  # the places from which a run of SHINGLE bytes stays in its line
    whole[offsets[1:, None] - 1 - np.arange(SHINGLE)] = False
    whole[offsets[:-1][lengths < SHINGLE]] = True
    x = np.ndarray(len(data), "<u8", padded, strides=(1,))[whole[: len(data)]]
    x &= np.uint64((1 << 8 * SHINGLE) - 1)
    return x, np.maximum(1, lengths - SHINGLE + 1)


def leading_hash(x: np.ndarray) -> np.ndarray:
    """DISTINCT_BITS of a hash of shingles, which are overwritten."""
    with np.errstate(over="ignore"):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    x >>= np.uint64(64 - DISTINCT_BITS)
    return x


def joined(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lines, each followed by one newline, and the offsets of the lines (n + 1 of them); no line holds a newline."""
    data = np.frombuffer(("\n".join(lines) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    return data, np.concatenate(([0], np.flatnonzero(data == 10) + 1))


def ordered_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashes of all shingles in order, repeats too, each below its line's number."""
    x, n = shingles(data, offsets)
    hashes = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(DISTINCT_BITS)) | leading_hash(x)
    hashes.sort()
    return hashes


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def registers_of(hashes: np.ndarray, lines: int) -> np.ndarray:
    """(lines, HASHES) 16-bit registers from hashes in order; repeats of a hash change nothing."""
    bin_ = hashes >> np.uint64(DISTINCT_BITS - HASHES.bit_length() + 1)
    first = _starts(bin_)
    bin_ = bin_[first].astype(np.int64)
    registers, filled = np.zeros(lines * HASHES, np.uint16), np.zeros(lines * HASHES, bool)
    registers[bin_] = hashes[first].astype(np.uint16)
    filled[bin_] = True
    empty = np.flatnonzero(~filled)
    for i in range(1, 6):  # most are filled by the first bins of their orders, the rest looks at whole orders
        other = empty // HASHES * HASHES + _ORDER[empty % HASHES, i]
        ok = filled[other]
        registers[empty[ok]] = registers[other[ok]]
        empty = empty[~ok]
    line = empty // HASHES * HASHES
    registers[empty] = registers[line + _ORDER[empty % HASHES, filled[line[:, None] + _ORDER[empty % HASHES]].argmax(axis=1)]]
    return registers.reshape(lines, HASHES)


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines, HASHES + PARITY_BITS / 16) 16-bit registers and parity words, and the number of distinct shingles."""
    lines, distinct = len(offsets) - 1, ordered_hashes(data, offsets)
    distinct = distinct[_starts(distinct)]
    count = np.diff(np.searchsorted(distinct, np.arange(lines + 1, dtype=np.uint64) << np.uint64(DISTINCT_BITS)))
    # in this order hashes that fall on one bit of the parity sketch are neighbours
    spot = (distinct >> np.uint64(DISTINCT_BITS - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    start = _starts(spot)
    odd = np.diff(np.append(start, len(spot))) & 1 == 1
    bits = np.zeros(lines * PARITY_BITS, bool)
    bits[spot[start[odd]]] = True
    parity = np.packbits(bits.reshape(lines, PARITY_BITS), axis=1).view(np.uint16)
    return np.concatenate((registers_of(distinct, lines), parity), axis=1), count


def binaries(words: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    ends = np.arange(len(words) + 1, dtype=np.int32) * (words.shape[1] * words.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(words.tobytes())])


#: Hashes, registers and unlike texts gain nothing from dictionaries, and little from zstd's higher levels.
PACKING = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("node", "check", "sketch", "norm")}
LINE = "doc_id {0}, tie long, place int, node long, check long, sketch binary, norm string"


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tie, text) -> every line's place and 128-bit hash, with registers and text where the task meets a line first."""
    seen: set[bytes] = set()
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            row, place, nodes, once, new = [], [], [], [], []
            if len(seen) > REMEMBERED:
                seen.clear()
            for i, text in enumerate(part.column("text").to_pylist()):
                for j, line in enumerate((text or "").lower().split("\n")):
                    if line := line.strip(" "):
                        node = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        if node not in seen:
                            seen.add(node)
                            once.append(len(row)), new.append(line)
                        row.append(i), place.append(j), nodes.append(node)
            words = registers_of(ordered_hashes(*joined(new)), len(new)) if new else np.zeros((0, HASHES), np.uint16)
            at = np.full(len(row), -1)
            at[once] = np.arange(len(once))
            own = pa.array(at, pa.int64(), mask=at < 0)  # the registers of a place, or none
            both = np.frombuffer(b"".join(nodes), np.int64).reshape(-1, 2)
            of = pa.array(row, pa.int64())
            columns = [part.column("doc_id").take(of), part.column("tie").take(of), pa.array(place, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), binaries(words).take(own), pa.array(new, pa.string()).take(own)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "place", "node", "check", "sketch", "norm"])


def _full_signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) of lines in buckets -> (node, n, sketch, text) with whole signatures."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            words, count = signatures(*joined(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(count, pa.int64()), binaries(words), part.column("text")], ["node", "n", "sketch", "text"])


def shared_shingles(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of lines, at most PAIRS of them: the distinct shingles both hold, and those of either."""
    keys = []
    for side in (a, b):
        x, n = shingles(*bytes_of(side))
        x = np.sort((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(8 * SHINGLE)) | x)
        keys.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
    both = np.sort(np.concatenate(keys))
    count = lambda x: np.bincount((x >> np.uint64(8 * SHINGLE)).astype(np.int64), minlength=len(a))
    shared = count(both[1:][both[1:] == both[:-1]])
    return shared, count(both) - shared


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                part = batch.slice(i, PAIRS)
                shared, either = shared_shingles(part.column("text_a"), part.column("text_b"))
                ok = pa.array(shared >= threshold * either - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], ["a", "b"])

    return run


def doubled_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs: (doc_id, text) -> (doc_id, tie, places): the 0-based places of the lines that go; tie is the text's hash."""
    small_batches(session_of(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = cut(docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(_signer, LINE.format(kind)), "signatures", **PACKING)
    first, total = lines.where("sketch is not null"), lines.count()
    full = lambda rows: rows.select("node", "text").mapInArrow(_full_signer, "node long, n long, sketch binary, text string")
    found = linked_components(first.select("node", "sketch", F.col("norm").alias("text")), total, None, BANDS, ROWS, HASHES, minhash_estimate(threshold, HASHES), _verifier(threshold), full)
    # Only the places of linked lines, and of lines that occur more than once, are looked at. Copies are lines equal in
    # both hashes; a component is a root, or such a line that is linked to no other.
    places = lines.select("doc_id", "tie", "place", "node", "check")
    copies = cut(places.groupBy("node", "check").agg(F.count("*").alias("held")).where("held > 1"), "copies")
    alone = copies.join(found, "node", "left_anti").select("node", F.col("check").alias("own"), F.col("node").alias("root"), F.col("check").alias("side"))
    asked = cut(found.select("node", F.lit(None).cast("long").alias("own"), "root", F.lit(0).cast("long").alias("side")).unionByName(alone), "asked")
    hot = F.broadcast(copies.where(F.col("held") > HOT_SHARE * total).select("node").distinct())  # fewer than 1 / HOT_SHARE rows
    met = lambda rows, of: rows.join(of.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & (F.col("own").isNull() | (F.col("own") == F.col("check"))))
    spots = met(places, F.broadcast(asked.join(hot, "node", "left_semi"))).unionByName(met(places.join(hot, "node", "left_anti"), asked.join(hot, "node", "left_anti").hint("shuffle_hash")))
    spots = cut(spots.select("root", "side", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "place").alias("spot")), "places")
    drop(copies, asked, found, lines)
    best = cut(spots.groupBy("root", "side").agg(F.min("spot").alias("best"), F.count("*").alias("held")), "best")
    often, rest = best.where(F.col("held") > HOT_SHARE * total), best.where(F.col("held") <= HOT_SHARE * total)
    often, key = F.broadcast(often), ["root", "side"]  # fewer than 1 / HOT_SHARE rows
    gone = spots.join(often, key).unionByName(spots.join(often, key, "left_anti").join(rest.hint("shuffle_hash"), key)).where("spot <> best")
    return gone.groupBy("spot.doc_id", "spot.tie").agg(F.sort_array(F.collect_set("spot.place")).alias("places"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with the doubled lines taken out of text (and n_chars, where there is one, counted anew); adds n_lines, n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    key, tie, places = fresh(docs, "gone_id", "gone_tie", "gone_places")
    gone = doubled_lines(docs.select("doc_id", "text"), threshold).select(F.col("doc_id").alias(key), F.col("tie").alias(tie), F.col("places").alias(places))
    out = docs.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(tie)), "left")
    pieces = F.split("text", "\n", -1)
    hit = F.col(places).isNotNull()
    kept = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(places, i)), "\n")
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).cast("long")).withColumn("n_dropped", F.when(hit, F.size(places)).otherwise(0).cast("long")).withColumn("text", F.when(hit, kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(key, tie, places)
