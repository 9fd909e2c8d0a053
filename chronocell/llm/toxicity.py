"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two words by the subsequences of four letters they share, each weighted by DECAY for every letter
that its occurrence skips, up to two. Letters lose case and accents, look-alike digits become letters, other signs
inside a word are skipped, single letters in a row are one word, and a mark stands before each word. So gapped, spaced
and padded insults stay near the insult.

Training starts from labelled texts: runs of four letters far more frequent in toxic texts point out the words that made
their sentences toxic; those words, and copies with an inserted letter, are the positive instances, words of clean
texts the negative ones, mined again for the hardest after the first fit. A squared-hinge SVM is fitted on Nyström
features. Landmarks and SVM weights add up to one weight per subsequence, so whole texts are scored in a few vector
passes; a text's score is its worst word's decision value through a logistic curve fitted on the training texts.

Defined cases: a null or empty text, or one without a word of three letters, scores as the mildest word does; with no
labelled rows of both kinds every score is 0; rows that repeat get the same score, and so do ties; other columns stay,
but score takes the place of a column of that name; an empty table gives an empty result; whole texts are read, in
training as well, whatever their length.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, slices, small_batches
from .kernels import bounded_sample, inverse_root

MARK, SPACE_CLASS, CODES = 31, 32, 1 << 20
DECAY, MOST_SKIPPED = 0.5, 2
#: Offsets of the second, third and fourth letter of an occurrence.
OFFSETS = [(a, b, d) for d in range(3, 4 + MOST_SKIPPED) for b in range(2, d) for a in range(1, b)]
#: Signs that stand for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ß": "s"}
_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Code point -> 0 (skipped), 1 to 26 a letter, 27 to 30 other letters, SPACE_CLASS."""
    if not _CLASS:
        out = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            if 0xD800 <= i < 0xE000:
                continue
            c = chr(i)
            if c.isspace():
                out[i] = SPACE_CLASS
            elif i < 128 or c.isalpha():
                base = LOOKALIKE.get(c) or (unicodedata.normalize("NFD", c)[0].lower() if i < 0x2000 else c)
                out[i] = ord(base[0]) - 96 if "a" <= base[0] <= "z" else 27 + i % 4 if c.isalpha() else 0
        _CLASS.append(out)
    return _CLASS[0]


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter classes with a MARK before each word; the starts of words; the text of each word."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", dtype=np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    kind = classes()[np.minimum(codes, 0x10FFFF)]
    used = kind > 0
    kind, text = kind[used], text[used]
    space = kind == SPACE_CLASS
    start = ~space & np.concatenate(([True], space[:-1]))  # the first letter of each word
    at = np.flatnonzero(start)
    after = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
    single = after == at
    joined = single[1:] & single[:-1] & (text[at[1:]] == text[at[:-1]]) if len(at) else np.zeros(0, bool)
    words = at[np.concatenate(([True], ~joined))] if len(at) else at
    letter = ~space
    place = np.cumsum(letter) - 1
    first = place[words] + np.arange(len(words)) if len(words) else words
    out = np.full(int(letter.sum()) + len(words), MARK, np.uint8)
    hole = np.ones(len(out), bool)
    hole[first] = False
    out[hole] = kind[letter]
    return out, first, text[words]


def occurrences(kind: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each set of offsets: positions inside one word, their subsequence codes and the weight."""
    word = np.zeros(len(kind), np.int32)
    word[first] = 1
    word = np.cumsum(word, dtype=np.int32)
    k = kind.astype(np.int32)
    for a, b, d in OFFSETS:
        n = len(k) - d
        if n <= 0:
            continue
        inside = np.flatnonzero(word[:n] == word[d:])
        yield inside, (k[inside] << 15) | (k[inside + a] << 10) | (k[inside + b] << 5) | k[inside + d], DECAY ** (d - 3)


def norms(lengths: np.ndarray) -> np.ndarray:
    """The kernel norm by a word's length (mark included); long words count as of ten letters, so a stem isn't diluted."""
    n = np.minimum(lengths, 10)
    total = sum(DECAY ** (2 * (d - 3)) * np.maximum(0, n - d) for _, _, d in OFFSETS)
    return np.sqrt(np.maximum(total, 1e-9))


def word_lengths(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.append(first, len(kind)))


def word_values(beta: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The decision value of every word, without the bias."""
    if not len(first):
        return np.zeros(0)
    total = np.zeros(len(kind), np.float32)
    for at, code, weight in occurrences(kind, first):
        total[at] += beta[code] * np.float32(weight)
    return np.add.reduceat(total, first) / norms(word_lengths(kind, first))


def text_values(beta: np.ndarray, texts: list[str], floor: float) -> np.ndarray:
    kind, first, text = stream(texts)
    out = np.full(len(texts), floor)
    np.maximum.at(out, text, word_values(beta, kind, first))
    return out


def spell(kind: np.ndarray, first: np.ndarray) -> list[bytes]:
    ends = np.append(first, len(kind))[1:]
    raw = (kind + 64).astype(np.uint8).tobytes()
    return [raw[a + 1 : b] for a, b in zip(first.tolist(), ends.tolist())]


def unspell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    kind = np.frombuffer(b"".join(bytes([MARK + 64]) + w for w in words), np.uint8) - 64
    return kind.astype(np.uint8), np.cumsum(lengths) - lengths


class ToxicityModel:
    def __init__(self, beta: np.ndarray, slope: float, middle: float, floor: float):
        self.beta, self.slope, self.middle, self.floor = beta, slope, middle, floor

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.slope * (text_values(self.beta, texts, self.floor) - self.middle)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _fit(words: list[bytes], y: np.ndarray, marks: list[bytes], cost: float = 4.0) -> np.ndarray:
    """The weight of every subsequence from a squared-hinge SVM on Nyström features of words."""
    kind, first = unspell(marks)
    parts = list(occurrences(kind, first))
    codes = np.unique(np.concatenate([c for _, c, _ in parts])) if parts else np.zeros(0, np.int64)
    column = np.full(CODES, -1, np.int32)
    column[codes] = np.arange(len(codes))

    def vectors(some: list[bytes]) -> np.ndarray:
        kind, first = unspell(some)
        owner = np.searchsorted(first, np.arange(len(kind)), side="right") - 1
        out = np.zeros((len(some), len(codes)), np.float32)
        for at, code, weight in occurrences(kind, first):
            c = column[code]
            ok = c >= 0
            np.add.at(out, (owner[at[ok]], c[ok]), np.float32(weight))
        return out / norms(word_lengths(kind, first))[:, None].astype(np.float32)

    own = vectors(marks)
    root = inverse_root(own @ own.T, 1e-4)
    features = np.concatenate([vectors(words[i : i + 500]) @ own.T for i in range(0, len(words), 500)]) @ root
    features = np.hstack([features, np.ones((len(words), 1))])
    weight = np.where(y > 0, cost, cost * max(0.2, (y > 0).sum() / max(1, (y < 0).sum())))
    w = np.zeros(features.shape[1])
    for _ in range(30):
        active = y * (features @ w) < 1
        x, c = features[active], weight[active]
        new = np.linalg.solve((x * c[:, None]).T @ x + np.eye(len(w)), (x * c[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    beta = np.zeros(CODES, np.float32)
    beta[codes] = own.T @ (root @ w[:-1])
    return beta


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, text, label) -> (u, label, words, counts): the distinct words of each whole text and how often each occurs."""
    for batch in batches:
        for part in slices(batch, "text"):
            kind, first, text = stream([t or "" for t in part.column("text").to_pylist()])
            each = [Counter() for _ in range(part.num_rows)]
            for w, t in zip(spell(kind, first), text.tolist()):
                each[t][w] += 1
            words = pa.array([b" ".join(c) for c in each], pa.binary())
            counts = pa.array([np.array(list(c.values()), np.int32).tobytes() for c in each], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("u"), part.column("label").cast(pa.int32()), words, counts], ["u", "label", "words", "counts"])


class _Sample:
    """Labelled texts as numbers into their common vocabulary."""

    def __init__(self, rows: list):
        number: dict[bytes, int] = {}
        self.label = np.array([r.label for r in rows], int)
        self.ids = [np.array([number.setdefault(w, len(number)) for w in bytes(r.words).split(b" ")], np.int64) if r.words else np.zeros(0, np.int64) for r in rows]
        self.counts = [np.frombuffer(r.counts, np.int32).astype(np.int64) for r in rows]
        self.vocabulary = list(number)
        self.kind, self.first = unspell(self.vocabulary) if number else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        at, code, _ = next(iter(occurrences(self.kind, self.first)), (np.zeros(0, np.int64),) * 3)
        word = np.searchsorted(self.first, at, side="right") - 1
        self.runs = np.split(np.asarray(code, np.int64), np.searchsorted(word, np.arange(1, max(1, len(number)))))  # of four letters, by word

    def values(self, beta: np.ndarray, floor: float, some: np.ndarray) -> np.ndarray:
        value = word_values(beta, self.kind, self.first)
        return np.array([max(floor, value[self.ids[i]].max(initial=floor)) for i in some.tolist()])


def _learn(sample: _Sample, some: np.ndarray, landmarks: int, seed: int) -> tuple[np.ndarray, float] | None:
    """The weight of every subsequence and the value of the mildest words, from some of the texts."""
    label, words, size = sample.label[some], sample.vocabulary, len(sample.vocabulary)
    held, occurs = np.zeros((2, CODES), np.int32), np.zeros((2, size), np.int64)
    for i, t in zip(some.tolist(), label.tolist()):
        if len(ids := sample.ids[i]):
            held[t][np.unique(np.concatenate([sample.runs[w] for w in ids.tolist()]))] += 1
            occurs[t][ids] += sample.counts[i]
    n = np.array([(label == 0).sum(), (label == 1).sum()])
    ratio = ((held[1] + 0.5) / (n[1] + 1)) / ((held[0] + 0.5) / (n[0] + 1))
    telling = (ratio >= 6) & (held[1] >= max(3, 0.002 * n[1]))
    long = np.array([len(w) >= 3 for w in words], bool)
    in_toxic, in_clean = np.flatnonzero(long & (occurs[1] > 0)), np.flatnonzero(long & (occurs[0] > 0))
    if not len(in_toxic) or not len(in_clean):
        return None
    by_weight = sorted(in_toxic.tolist(), key=lambda i: (-occurs[1][i], words[i]))
    positive = [words[i] for i in by_weight if occurs[1][i] > 4 * occurs[0][i] and telling[sample.runs[i]].any()][:2500]
    if not positive:
        positive = [words[i] for i in by_weight if not occurs[0][i]][:200]
    if not positive:
        return None
    rng = np.random.default_rng(seed)
    clean = sorted(words[i] for i in in_clean.tolist())

    def padded(w: bytes) -> bytes:
        i = int(rng.integers(1, max(2, len(w))))
        return w[:i] + bytes([64 + int(rng.integers(1, 27))]) + w[i:]

    negative = [clean[i] for i in rng.permutation(len(clean))[:6000]]
    more = [padded(w) for w in positive[:1200]]
    marks = positive[: landmarks // 2] + negative[: landmarks // 2]
    kind, first = unspell(clean)
    for round_ in range(3):
        y = np.array([1.0] * (len(positive) + len(more)) + [-1.0] * len(negative))
        beta = _fit(positive + more + negative, y, marks)
        if round_ < 2:
            worst = np.argsort(-word_values(beta, kind, first), kind="stable")[:1500]
            known = set(negative)
            negative += [clean[i] for i in worst if clean[i] not in known]
            marks = marks + [clean[i] for i in worst[: landmarks // 4]]
    return beta, float(np.quantile(word_values(beta, kind, first), 0.01))


def train_toxicity(docs: DataFrame, labels: DataFrame | None = None, per_label: int = 3000, landmarks: int = 256, seed: int = 5) -> ToxicityModel | None:
    """docs: (doc_id, text) with labels: (doc_id, toxic), or docs: (doc_id, text, toxic) alone.

    Fits on about per_label whole texts of each label. The ids are chosen before texts are read, and the words of the
    chosen texts come to the driver, not the texts. The cut is set by texts that the weights were not learned from: each
    half of the sample is judged by weights learned from the other half.
    """
    small_batches(session_of(docs))
    if labels is not None:
        ids = labels.where("toxic in (0, 1)").select("doc_id", "toxic").join(docs.select("doc_id"), "doc_id", "left_semi").distinct()
        ids = bounded_sample(ids.withColumn("text", F.lit("")), "toxic", per_label, keys=("doc_id",)).select("doc_id", "label", "u")
        chosen = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")  # as many ids as the sample has
    else:
        chosen = bounded_sample(docs.where("toxic in (0, 1) and text is not null").select("doc_id", "text", "toxic"), "toxic", per_label)
    found = chosen.select("u", "text", "label").mapInArrow(_words, "u double, label int, words binary, counts binary").collect()
    sample = _Sample(sorted(found, key=lambda r: (r.u, r.label, bytes(r.words))))
    label, every = sample.label, np.arange(len(sample.label))
    if len(set(label.tolist())) < 2 or (learned := _learn(sample, every, landmarks, seed)) is None:
        return None
    beta, floor = learned
    values = sample.values(beta, floor, every)
    halves = [every[every % 2 == i] for i in (0, 1)]
    parts = [_learn(sample, halves[1 - i], landmarks, seed) if len(set(label[halves[1 - i]].tolist())) == 2 else None for i in (0, 1)]
    if all(parts):
        for own, (other, low) in zip(halves, parts):
            values[own] = sample.values(other, low, own)
    # the cut with the fewest errors, in the middle of its gap; then a fixed steepness over the spread of values
    order = np.argsort(values, kind="stable")
    rate = np.where(label[order] == 1, 1.0 / (label == 1).sum(), -3.0 / (label == 0).sum())  # a clean text marked is worse than a toxic one missed
    loss = np.concatenate(([0.0], np.cumsum(rate)))
    best = int(np.argmin(loss))
    v = values[order]
    middle = float((v[max(0, best - 1)] + v[min(best, len(v) - 1)]) / 2)
    spread = float(np.median(values[label == 1]) - np.median(values[label == 0]))
    return ToxicityModel(beta, 8.0 / max(abs(spread), 1e-3), middle, floor)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """docs: (other columns..., text) -> the same columns without the text, and score in the place of any of that name."""
    spark = session_of(docs)
    small_batches(spark)
    docs = docs.drop("score")
    keys = [c for c in docs.columns if c != "text"]
    if model is None:
        return docs.select(*[F.col(f"`{k}`") for k in keys], F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast((model.beta, model.slope, model.middle, model.floor))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                p = own.score([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(p, pa.float64())], [*keys, "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(score, f"{fields}score double")
