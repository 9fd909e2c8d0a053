"""Near-duplicate documents by SetSketch registers over word shingles.

A register is floor(1 - log_base(m)) for the minimum m of exponential hashes of a document's shingles: truncated,
exponentially spaced and mergeable by taking the greater value. Bands of registers propose pairs, the joint likelihood
of the registers and a parity sketch of the set thin them, and full shingle sets decide.

Defined cases: a text of fewer words than a shingle has the whole sequence as its one shingle; a null or empty text has
none and is linked with nothing; copies count once as a node and share their class; rows that repeat get the same
result; with a null doc_id a row is linked, but never named as a component; one (doc_id, text) of each component is kept,
the least by doc_id (nulls last) and text hash, so rows that share an id or have none don't hide each other; an empty table gives an empty result; whole
texts are read, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, drop, fresh, lower_bytes, mix64, session_of, shingles_of, slices, small_batches, span_hashes, words_of
from .simjoin import linked_components, parities_of, setsketch_estimate

REGISTERS, BANDS, ROWS, BASE = 128, 32, 4, 1.02
#: Bits of a set's parity sketch (a power of two): each tells whether an odd number of shingle hashes fell on it.
PARITY_BITS = 2048


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).astype(np.uint32) | np.uint32(1)
    return x[:REGISTERS], x[REGISTERS:]


def registers_of(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) for shingle hashes, the sets beginning at `starts`."""
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(starts), REGISTERS), np.uint32)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(*_seeds())):
            out[:, i] = np.minimum.reduceat(low * a ^ high * b, starts)
    exponential = -np.log1p(-(out + 0.5) / 4294967296.0)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = bytes_of(part.column("text"))
                starts, ends, first = words_of(data, offsets)
                h, at = shingles_of(span_hashes(lower_bytes(data), starts, ends), first, k)
                order = np.argsort((at.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)), kind="stable") if part.num_rows < 4096 else np.lexsort((h, at))
                h, at = h[order], at[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (at[1:] != at[:-1]))) if len(h) else np.zeros(0, bool)
                h, at = h[new], at[new]
                n = np.bincount(at, minlength=part.num_rows)
                has = np.flatnonzero(n)
                f1, f2 = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
                sketch = [None] * part.num_rows
                if len(has):
                    begin = (np.cumsum(n) - n)[has]
                    with np.errstate(over="ignore"):
                        f1[has] = mix64(np.add.reduceat(h, begin))
                        f2[has] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), begin)
                    both = np.concatenate((registers_of(h, begin), parities_of(h, begin, PARITY_BITS)), axis=1)
                    for i, r in zip(has.tolist(), both):
                        sketch[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "tie", "n", "node", "check", "sketch"])

    return run


def shingle_set(text: str, k: int) -> frozenset:
    """The exact set: tuples of k words, or the whole shorter sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(k)])) if len(words) >= k else frozenset([tuple(words)])


def _verifier(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last: tuple = (None, None)
            out_a, out_b = [], []
            for a, b, s, t in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]):
                if last[0] != b:
                    last = (b, shingle_set(t, k))
                x, y = shingle_set(s, k), last[1]
                both = len(x & y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    out_a.append(a), out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs: (doc_id, text) -> (doc_id, tie, n_shingles, component_id, kept) of every row; tie is the text's hash."""
    small_batches(session_of(docs))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    rows = cut(texts.select("doc_id", "tie", "text").mapInArrow(_sketcher(k), "doc_id long, tie long, n long, node long, check long, sketch binary"), "sketches")
    classes = rows.where("n > 0").groupBy("node", "check", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("at"), F.first("sketch").alias("sketch"))
    classes = cut(classes, "classes")

    def own_texts(wanted: DataFrame) -> DataFrame:
        """One text of each wanted class. Texts are dealt by the join at any size, so the plan doesn't depend on it."""
        of = wanted.join(classes.select("node", F.col("at.doc_id").alias("k"), F.col("at.tie").alias("t")), "node").hint("merge")
        own = texts.join(of, F.col("tie").eqNullSafe(F.col("t")) & F.col("doc_id").eqNullSafe(F.col("k")))
        return own.select("node", "text").dropDuplicates(["node"])

    found = linked_components(classes.select("node", "n", "sketch"), classes.count(), own_texts, BANDS, ROWS, REGISTERS + PARITY_BITS // 16, setsketch_estimate(percent / 100, BASE, REGISTERS), _verifier(k, percent))
    named = classes.select("node", "check", "at").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("at").alias("at"))
    named = named.select("node", "check", "root").join(ids, "root").select("node", "check", F.col("at.doc_id").alias("component_id"), F.col("at.tie").alias("first_tie"))
    out = rows.select("doc_id", "tie", F.col("n").alias("n_shingles"), "node", "check")
    linked = out.where("n_shingles > 0").join(cut(named, "named"), ["node", "check"]).drop("node", "check")
    drop(classes, found)
    alone = out.where("n_shingles = 0").drop("node", "check").withColumns({"component_id": F.col("doc_id"), "first_tie": F.col("tie")})
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("tie").eqNullSafe(F.col("first_tie"))).drop("first_tie")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component; columns stay, whatever their names."""
    key, tie, own = fresh(docs, "kept_id", "kept_tie", "text_tie")
    kept = near_duplicates(docs.select("doc_id", "text"), k, percent).where("kept").select(F.col("doc_id").alias(key), F.col("tie").alias(tie)).distinct()
    first = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & F.xxhash64("text").eqNullSafe(F.col(tie)), "left_semi")
    return first.withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own]).drop(own)
