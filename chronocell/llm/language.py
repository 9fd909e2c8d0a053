"""Language ID by string-kernel classification.

The kernel of two texts is the cosine of their presence vectors over character n-grams (1 to 3 letters, words joined by
one space). Landmark texts span the n-gram slots that count; Nyström features of a bounded training sample feed
one-versus-rest kernel ridge regression. Landmark kernels, the inverse root and the regression weights are one matrix
over slots in the end, so a batch of texts is scored by one product of its presence matrix with that matrix.

Defined cases: a null text or one without a letter is `und` with score 0; a text whose n-grams no landmark has gets the
first language at 1 / number of languages; rows that repeat get the same result; with no labelled rows every text is
`und`; languages that score alike go by their names; other columns stay, but lang_pred and score take the place of
columns of these names; an empty table gives an empty result; whole texts are read, in training as well, whatever their
length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, session_of, slices, small_batches
from .kernels import bounded_sample, inverse_root

SLOTS = 1 << 20
ORDERS = (1, 2, 3)
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot) of every n-gram occurrence, and which texts have a letter."""
    joined = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(joined).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", dtype=np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in joined], dtype=np.int64))
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    letter = letters()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of what is no letter, the first after a letter stays, as a space
    has = np.bincount(text[letter], minlength=len(texts)) > 0
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    text = text[keep]
    owner, slot = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + (codes[n - 1 :] + np.uint64(n))
            inside = text[:m] == text[n - 1 :]
            owner.append(text[:m][inside])
            slot.append((mix64(h[inside]) & np.uint64(SLOTS - 1)).astype(np.int64))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(owner), np.concatenate(slot), has


class LanguageModel:
    """column: SLOTS -> column or -1; weights: columns x languages; names: the languages."""

    def __init__(self, column: np.ndarray, weights: np.ndarray, names: list[str]):
        self.column, self.weights, self.names = column, weights, names

    def vectors(self, owner: np.ndarray, slot: np.ndarray, texts: int) -> np.ndarray:
        """Unit presence vectors of some texts over the columns."""
        at = self.column[slot]
        out = np.zeros((texts, self.weights.shape[0]), np.float32)
        out[owner[at >= 0], at[at >= 0]] = 1
        return out / np.sqrt(np.maximum(1, out.sum(axis=1, keepdims=True)))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        owner, slot, has = presence(texts)
        f = self.vectors(owner, slot, len(texts)) @ self.weights
        e = np.exp(6.0 * (f - f.max(axis=1, keepdims=True)))
        p = e / e.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.names[b] if ok else "und" for b, ok in zip(best, has)], np.where(has, p[np.arange(len(best)), best], 0.0).astype(float)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, text, label) -> (u, label, slots): the distinct slots of each whole text with a letter, at most SLOTS of them."""
    for batch in batches:
        for part in slices(batch, "text"):
            owner, slot, has = presence([t or "" for t in part.column("text").to_pylist()])
            pairs = np.unique(owner * SLOTS + slot)
            ends = np.searchsorted(pairs, np.arange(1, part.num_rows + 1) * SLOTS)
            own = [x.astype(np.int32).tobytes() for x in np.split(pairs % SLOTS, ends[:-1])]
            yield pa.RecordBatch.from_arrays([part.column("u"), part.column("label"), pa.array(own, pa.binary())], ["u", "label", "slots"]).filter(pa.array(has))


def train_language(labelled: DataFrame, sample: int = 3000, landmarks: int = 192, ridge: float = 1.0, least: int = 20) -> LanguageModel | None:
    """labelled: (doc_id, text, lang). Fits on about `sample` whole texts, as many of each language, but `least` at least.

    The n-gram slots of the texts come to the driver, not the texts: at most SLOTS numbers for each.
    """
    small_batches(session_of(labelled))
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = max(1, labelled.select("lang").distinct().count())
    found = bounded_sample(labelled, "lang", max(least, sample // n)).select("u", "text", "label").mapInArrow(_slots, "u double, label string, slots binary").collect()
    rows = [(r.label, np.frombuffer(r.slots, np.int32)) for r in sorted(found, key=lambda r: (r.u, r.label, r.slots))]
    if not rows:
        return None
    names = sorted({k for k, _ in rows})
    chosen, seen = [], {k: 0 for k in names}
    for i, (k, _) in enumerate(rows):
        if seen[k] < max(4, landmarks // len(names)):
            seen[k] += 1
            chosen.append(i)
    slots, held = np.unique(np.concatenate([rows[i][1] for i in chosen]), return_counts=True)
    slots = slots[held >= min(2, len(chosen))]
    column = np.full(SLOTS, -1, np.int32)
    column[slots] = np.arange(len(slots))
    model = LanguageModel(column, np.zeros((len(slots), 1), np.float32), names)

    def vectors(some: list) -> np.ndarray:
        return model.vectors(np.repeat(np.arange(len(some)), [len(x) for _, x in some]), np.concatenate([x for _, x in some]), len(some))

    marks = vectors([rows[i] for i in chosen])
    root = inverse_root(marks @ marks.T)
    features = np.concatenate([vectors(rows[i : i + 200]) @ marks.T for i in range(0, len(rows), 200)]) @ root
    place = {k: i for i, k in enumerate(names)}
    y = np.full((len(rows), len(names)), -1.0)
    y[np.arange(len(rows)), [place[k] for k, _ in rows]] = 1.0
    w = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ y)
    return LanguageModel(column, (marks.T @ (root @ w)).astype(np.float32), names)


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs: (other columns..., text) -> the same columns without the text, and lang_pred, score in the place of any of these names."""
    spark = session_of(docs)
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    keys = [c for c in docs.columns if c != "text"]
    if model is None:
        return docs.select(*[F.col(f"`{k}`") for k in keys], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast((model.column, model.weights, model.names))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                names, p = own.predict([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(names, pa.string()), pa.array(p, pa.float64())], [*keys, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(score, f"{fields}, lang_pred string, score double" if fields else "lang_pred string, score double")
