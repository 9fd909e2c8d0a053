"""Benchmark decontamination by template canonicalisation.

Words lose case and outer signs; numbers, names (capitalised inside a sentence) and units after numbers become typed
placeholders; a run of placeholders of one type inside a sentence is one place. Documents and benchmark items are joined
on the hashes of template windows of WINDOW places: both sides are tables of hashes, and a bitset of fixed size, made of
the benchmark's hashes and broadcast, keeps windows that can't meet any from being rows at all. Texts of the pairs that
meet are then compared. Diagonals (document place minus item place) at most WINDOW apart are chained
in the order of both texts, so words put in or left out do not end a match; on all of a chain the slots behind the
placeholders must agree: one item value always stands for one document value, and one name of the document for one of
the item (numbers may meet by chance: 2 and 3 may be asked again as 5 and 5). So items that were asked again with other
numbers or names are found too.

A capitalised word that opens a sentence may be a name or not, so windows with such openers are indexed and probed in
every form, each opener as a literal word and as a name. The matches of the literal forms alone are judged as well: an
ordinary opener that differs takes nothing from them. Stays out: an opener that is the first of several words of a name
does not join their run, so windows over it don't match a name of one word.

Defined cases: null or empty texts on either side match nothing; an item shorter than a window is one window as long as
itself (at least LEAST_LITERALS literal words); an item without a window (fewer literal words, or dense with placeholders)
is found as a verbatim copy alone, by the hash of all its words without types, and counts as one window: asked again with
other slots it stays out, as do items of signs alone. An item of one common word so marks every document that has it; rows
that repeat get the same result; of chains that tie the exact one counts; ids are cast to long and other columns are left
out, but drop_leaks keeps all columns whatever their names; an empty table on either side gives no matches; whole texts
are read, whatever their length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, drop, fresh, lower_bytes, mix64, session_of, slices, small_batches, span_hashes, words_of

WINDOW, LEAST_LITERALS = 8, 5
#: A task indexes items of about this many bytes together.
BLOCK_CHARS = 1 << 18
#: Bits of the broadcast bitset (a power of two): 8 MB, whatever the benchmark's size.
FILTER_BITS = 1 << 26
#: Units.
UNITS = frozenset(b"km m cm mm kg g mg l ml s ms min h hz khz mhz ghz kb mb gb tb usd eur gbp kwh kw w v a c f mph kmh percent".split())
WITH_UNIT = re.compile(rb"[+-]?[0-9]+(?:[.,][0-9]+)*([a-z]{1,7})")
NUM, NAME, UNIT = 1, 2, 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TYPED = mix64(np.arange(0xC0FFEE, 0xC0FFEE + 4, dtype=np.uint64))


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(257, bool)
    out[list(members)] = True
    return out


_OUTER, _SENTENCE = _table(b"\"'.,;:!?()[]{}<>*_`~$&#@%^=|/\\+-"), _table(b".!?:;\"\n")
_DIGIT, _BIG = _table(b"0123456789"), _table(bytes(range(65, 91)))
_WORDY = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


class Canon:
    """The places of some texts: hashes of their canonical forms, kinds (0: literal), spans of words, each text's first place.

    A place is a word, or a run of placeholders of one type that no sentence's end divides. Case is lost for A-Z and the Latin-1 letters. A name is a capital followed by small letters, not at the start of a
    sentence (there it is an opener, a literal that may be a name); a number has digits and no letters; a unit is a known word after a number, or the letters behind one.
    """

    def __init__(self, texts: pa.Array):
        data, offsets = bytes_of(texts)
        accented = np.zeros(len(data), bool)  # the second byte of a Latin-1 capital
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        self.data = lower_bytes(data)
        self.data[accented] += 0x20
        starts, ends, self.first = words_of(data, offsets)
        last = _SENTENCE[data[ends - 1]]
        while len(move := np.flatnonzero((starts < ends) & _OUTER[data[np.minimum(starts, len(data) - 1)]])):
            starts[move] += 1
        while len(move := np.flatnonzero((starts < ends) & _OUTER[data[ends - 1]])):
            ends[move] -= 1
        self.starts, self.ends = starts, ends
        self.h = span_hashes(self.data, starts, ends)
        self.raw, self.raw_first = self.h.copy(), self.first
        count = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate(([0], np.cumsum(mask, dtype=np.int32))))
        big, letter, digit = count(_BIG[data] | accented), count(_WORDY[data]), count(_DIGIT[data])
        at = np.minimum(starts, len(data) - 1)
        capital = _BIG[data[at]] | accented[np.minimum(at + 1, len(data) - 1)]
        first = np.zeros(len(starts), bool)
        first[self.first[:-1][self.first[:-1] < len(starts)]] = True
        first[1:] |= last[:-1]
        size = ends - starts
        self.kind = np.zeros(len(starts), np.int8)
        name = capital & (big == 1) & (letter == size) & (size > 1 + accented[np.minimum(at + 1, len(data) - 1)])
        self.kind[name & ~first] = NAME
        self.kind[(digit > 0) & (letter == 0)] = NUM
        for i in np.flatnonzero((digit > 0) & (letter > 0) & (size <= 16)):
            if (m := WITH_UNIT.fullmatch(self.word(i))) and m[1] in UNITS:
                self.kind[i] = NUM
        for i in np.flatnonzero(self.kind[:-1] == NUM) + 1:
            if self.word(i) in UNITS:
                self.kind[i] = UNIT
        typed = self.kind > 0
        self.h[typed] = _TYPED[self.kind[typed]]
        head = np.ones(len(starts), bool)
        head[1:] = ~typed[1:] | (self.kind[1:] != self.kind[:-1]) | first[1:]
        places = np.flatnonzero(head)
        self.at = np.append(places, len(starts))
        self.h, self.kind, self.first = self.h[places], self.kind[places], np.searchsorted(places, self.first)
        self.opener = (name & first)[places] & (self.kind == 0)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def run(self, i: int) -> tuple[bytes, ...]:
        """The words of a place."""
        return tuple(self.word(j) for j in range(self.at[i], self.at[i + 1]))


def windows(h: np.ndarray, kind: np.ndarray, opener: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows with enough literal words in every form, their places, and whether an opener is a name in it.

    The windows with literal openers come first, in order.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * _STEP + h[i : i + n]
        literal = np.concatenate(([0], np.cumsum(kind == 0)))
        spare = literal[size:] - literal[:n] - min(LEAST_LITERALS, size)
        places = [np.flatnonzero(spare >= 0)]
        hashes = [out[places[0]]]
        powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _STEP))))[::-1]
        held = np.zeros(n, np.int32)  # bit i: an opener at place i of the window
        for i in range(size):
            held |= opener[i : i + n].astype(np.int32) << i
        some = np.flatnonzero((held > 0) & (spare > 0))
        codes = held[some]
        for code in np.unique(codes).tolist():
            at = some[codes == code]
            form = code
            while form:  # every choice of the openers but none
                bits = [i for i in range(size) if form >> i & 1]
                here = at[spare[at] >= len(bits)]
                if len(here):
                    places.append(here)
                    hashes.append(sum((((_TYPED[NAME] - h[here + i]) * powers[i]) for i in bits), start=out[here]))
                form = (form - 1) & code
    return mix64(np.concatenate(hashes)), np.concatenate(places), np.arange(sum(map(len, places))) >= len(places[0])


def sequences(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` words from each place on."""
    out = np.full(len(at), size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * _STEP + h[at + i]
    return mix64(out)


def _fits(held: dict, more: dict) -> bool:
    """Whether the values of more agree with those held, both ways for names."""
    if any(held.get(k, v) != v for k, v in more.items()):
        return False
    back = {v: k for k, v in held.items() if k[0] == NAME}
    return all(back.get(v, k) == k for k, v in more.items() if k[0] == NAME)


class Benchmark:
    """Sorted window hashes of some items, by window size; whole sequences of words of the items without a window."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: list[tuple[int, list[tuple[bytes, ...]], np.ndarray, np.ndarray, int, int]] = []
        self.ids = [item_id for item_id, _ in items]
        self.numbers: list[int] = []  # of the items in self.words
        by: dict[int, list[tuple[np.ndarray, ...]]] = {}
        c = Canon(pa.array([t for _, t in items], pa.string()))
        verbatim: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for nth, ((item_id, _), a, b, start, end) in enumerate(zip(items, c.first[:-1], c.first[1:], c.raw_first[:-1], c.raw_first[1:])):
            h, kind, opener = c.h[a:b], c.kind[a:b], c.opener[a:b]
            size = min(WINDOW, len(h))
            if size >= LEAST_LITERALS and len((got := windows(h, kind, opener, size))[0]):
                by.setdefault(size, []).append((got[0], np.full(len(got[0]), len(self.words)), *got[1:]))
                self.numbers.append(nth)
                self.words.append((item_id, [c.run(i) for i in range(a, b)], kind, opener, int((~got[2]).sum()), size))
            elif (c.ends[start:end] > c.starts[start:end]).any():
                verbatim[int(end - start)].append((int(start), nth))
        self.tables = {}
        for size, parts in by.items():
            h, *more = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.tables[size] = (h[order], *(x[order] for x in more))
        self.verbatim = {}  # by number of words: the first words' hashes, and the sequences' with their items
        for size, whole in verbatim.items():
            at = np.array([start for start, _ in whole])
            h = sequences(c.raw, at, size)
            order = np.argsort(h, kind="stable")
            self.verbatim[size] = (np.unique(c.raw[at]), h[order], [whole[i][1] for i in order])

    def keys(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(0-based item, size, distinct keys) by which documents meet items: of windows, or of whole sequences (size below 0)."""
        for size, (h, item, *_) in self.tables.items():
            for i in np.unique(item).tolist():
                yield self.numbers[i], size, np.unique(h[item == i])
        for size, (_, h, items) in self.verbatim.items():
            for x, i in zip(h.tolist(), items):
                yield i, -size, np.array([x], np.uint64)

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, bool, bool]]:
        """(text, item_id, matched windows, the item's windows, consistent slots, exact slots) by the best chain of diagonals."""
        c = Canon(texts)
        hits: dict[tuple[int, int], dict[int, dict[int, bool]]] = defaultdict(lambda: defaultdict(dict))
        for size, (table, item, at, as_name) in self.tables.items():
            got, place, named = windows(c.h, c.kind, c.opener, size)
            left = np.searchsorted(table, got, side="left")
            found = np.flatnonzero(table[np.minimum(left, len(table) - 1)] == got)
            text = np.searchsorted(c.first, place[found], side="right") - 1
            for i, t in zip(found.tolist(), text.tolist()):
                if place[i] + size > c.first[t + 1]:
                    continue  # the window goes beyond the text's end
                for j in range(left[i], np.searchsorted(table, got[i], side="right")):
                    spots = hits[t, int(item[j])][int(place[i] - at[j])]
                    spots[int(at[j])] = spots.get(int(at[j]), False) or not (named[i] or as_name[j])
        for (t, item), diagonals in hits.items():
            literal = {shift: own for shift, spots in diagonals.items() if (own := {p for p, plain in spots.items() if plain})}
            whole = {shift: set(spots) for shift, spots in diagonals.items()}
            consistent, n, exact = max(self._best(item, x, c) for x in ((whole, literal) if literal and literal != whole else (whole,)))
            yield t, self.words[item][0], n, self.words[item][4], consistent, exact
        yield from ((t, item_id, 1, 1, True, True) for t, item_id in self._verbatim(c))

    def _verbatim(self, c: Canon) -> list[tuple[int, int]]:
        """(text, item_id) of the items without a window whose words stand in a text as they are."""
        out: dict[tuple[int, int, int], None] = {}
        for size, (heads, table, ids) in self.verbatim.items():
            at = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, c.raw), len(heads) - 1)] == c.raw)
            text = np.searchsorted(c.raw_first, at, side="right") - 1
            inside = at + size <= c.raw_first[text + 1]
            at, text = at[inside], text[inside]
            got = sequences(c.raw, at, size)
            left, right = np.searchsorted(table, got, side="left"), np.searchsorted(table, got, side="right")
            for t, a, b in sorted(set(zip(text[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist()))):
                out |= dict.fromkeys((t, size, j) for j in range(a, b))
        return [(t, self.ids[self.verbatim[size][2][j]]) for t, size, j in out]

    def _slots(self, item: int, shift: int, spots: set[int], c: Canon) -> tuple[bool, dict, bool]:
        """Whether the slots of a diagonal agree, the document's values by the item's, and whether they are equal."""
        _, words, kinds, opener, _, size = self.words[item]
        covered = {p + k for p in spots for k in range(size)}
        names = {x for w, k in zip(words, kinds) if k == NAME for x in w}
        to: dict[tuple, tuple] = {}
        back: dict[tuple, tuple] = {}
        consistent = exact = True
        for p in sorted(covered):
            if not kinds[p] and not opener[p]:
                continue
            a, b = words[p], c.run(p + shift)
            if not kinds[p] and a == b and a[0] not in names:
                continue  # an opener that stays as it is
            n = min(len(a), len(b))
            if p - 1 not in covered:  # where the match begins or ends, either run may go on beyond it
                a, b = a[-n:], b[-n:]
            elif p + 1 not in covered:
                a, b = a[:n], b[:n]
            for x, y in [((x,), (y,)) for x, y in zip(a, b)] if len(a) == len(b) else [(a, b)]:
                slot = (int(kinds[p]) or NAME, x)
                consistent &= to.setdefault(slot, y) == y
                consistent &= slot[0] != NAME or back.setdefault(y, x) == x
                exact &= x == y
        return consistent, to, exact

    def _best(self, item: int, diagonals: dict[int, set[int]], c: Canon) -> tuple[bool, int, bool]:
        """(consistent, windows, exact) of the best diagonal or chain of diagonals."""
        slots = {shift: self._slots(item, shift, spots, c) for shift, spots in diagonals.items()}
        best = max((slots[shift][0], len(spots), slots[shift][2]) for shift, spots in diagonals.items())
        group: list[int] = []
        for shift in [*sorted(s for s in diagonals if slots[s][0]), None]:
            if group and (shift is None or shift - group[-1] > WINDOW):
                if len(group) > 1 and len(set().union(*(diagonals[s] for s in group))) > best[1]:
                    best = max(best, self._chain(group, diagonals, slots))
                group = []
            group.append(shift)
        return best

    def _chain(self, group: list[int], diagonals: dict[int, set[int]], slots: dict) -> tuple[bool, int, bool]:
        """The most windows in the order of both texts over near diagonals whose slots agree; group: consistent ones, sorted."""
        agree: dict[tuple[int, int], bool] = {}

        def agreeing(s: int, t: int) -> bool:
            if (s, t) not in agree:
                agree[s, t] = agree[t, s] = _fits(slots[s][1], slots[t][1])
            return agree[s, t]

        near = {s: [t for t in group if abs(t - s) <= WINDOW] for s in group}
        spots: dict[int, list[int]] = {s: [] for s in group}
        ends: dict[int, list[tuple[int, int, int]]] = {s: [] for s in group}  # windows so far, diagonal and number of the one before
        for p, s in sorted((p, s) for s in group for p in diagonals[s]):
            n, back, nth = 0, s, -1
            for t in near[s]:
                i = bisect_right(spots[t], p - 1 - max(0, t - s)) - 1  # places before this one in the item and in the document
                if i >= 0 and ends[t][i][0] > n and (t == s or agreeing(s, t)):
                    n, back, nth = ends[t][i][0], t, i
            spots[s].append(p)
            ends[s].append((n + 1, back, nth))
        s = max(group, key=lambda s: ends[s][-1][0])
        taken: dict[int, int] = defaultdict(int)
        nth = len(ends[s]) - 1
        while nth >= 0:
            taken[s] += 1
            _, s, nth = ends[s][nth]
        to: dict = {}
        n, exact = 0, True
        for s in sorted(taken, key=lambda s: (-taken[s], s)):  # a smaller piece whose slots contradict the greater ones adds nothing
            if _fits(to, slots[s][1]):
                to |= slots[s][1]
                n += taken[s]
                exact &= slots[s][2]
        return True, n, exact


KEY = np.uint64(0xA24BAED4963EE407)


def keyed(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of a size as the keys of the join: sizes don't meet each other."""
    with np.errstate(over="ignore"):
        return mix64(h + np.uint64(size % (1 << 32)) * KEY).view(np.int64)


def _item_keys(block_chars: int):
    """Rows (item, text) -> (item, size, key) of every key of each item, and under a null item the keys of the first words of sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", block_chars):
                items = part.column("item").to_pylist()
                held = Benchmark(list(zip(items, part.column("text").to_pylist())))
                rows = [(items[i], size, keyed(h, size)) for i, size, h in held.keys()]
                rows += [(None, -size, keyed(heads, 0)) for size, (heads, *_) in held.verbatim.items()]
                for item, size, key in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(key), pa.int64()), pa.array([size] * len(key), pa.int64()), pa.array(key)], ["item", "size", "key"])

    return run


class KeyFilter:
    """Which keys the benchmark may have; one bit of FILTER_BITS for each."""

    def __init__(self, words: np.ndarray, sizes: list[int]):
        self.words, self.sizes = words, sizes

    def may_have(self, key: np.ndarray) -> np.ndarray:
        spot = key.view(np.uint64) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
        return (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of the keys of texts that pass, each once."""
        c, found = Canon(texts), []
        for size in self.sizes:
            if size > 0:
                h, place, _ = windows(c.h, c.kind, c.opener, size)
                first, length = c.first, size
            else:
                place = np.flatnonzero(self.may_have(keyed(c.raw, 0)))
                first, length = c.raw_first, -size
                place = place[place + length <= len(c.raw)]
                h = sequences(c.raw, place, length)
            key = keyed(h, size)
            ok = self.may_have(key)
            key, place = key[ok], place[ok]
            text = np.searchsorted(first, place, side="right") - 1
            inside = place + length <= first[text + 1]  # no window goes beyond its text's end
            found.append((text[inside], key[inside]))
        text, key = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, bool)
        return text[new], key[new]


def key_filter(keys: DataFrame) -> KeyFilter:
    """The filter of (item, size, key) rows: at most FILTER_BITS / 64 words and one number for each size come to the driver."""
    spot = F.shiftrightunsigned("key", 64 - FILTER_BITS.bit_length() + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").bitwiseAND(63).cast("int"))
    rows = keys.select(spot.alias("spot")).select(F.shiftright("spot", 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return KeyFilter(words.view(np.uint64), sorted(r["size"] for r in keys.where("item is not null").select("size").distinct().collect()))


def _candidates(shared):
    """Rows (doc_id, tie, text) -> those that may meet an item, with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, key = shared.value.of(part.column("text"))
                if not len(text):
                    continue
                which, start = np.unique(text, return_index=True)
                own = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)), pa.int32()), pa.array(key))
                rows = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", "tie", "text")], own], ["doc_id", "tie", "text", "keys"])

    return run


FOUND = "doc_id long, tie long, item_id long, windows long, item_windows long, consistent boolean, exact boolean"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tie, text, item_id, item_text), best in runs of one item -> what the texts share."""
    names = [x.split(" ")[0] for x in FOUND.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
    for batch in batches:
        ids, ties, items, said = (batch.column(c).to_pylist() for c in ("doc_id", "tie", "item_id", "item_text"))
        start, rows = 0, []
        while start < len(ids):
            stop = start
            while stop < len(ids) and (items[stop], said[stop]) == (items[start], said[start]):
                stop += 1
            held = Benchmark([(items[start], said[start])])
            for few in slices(batch.slice(start, stop - start), "text"):
                rows += [(ids[start + t], ties[start + t], *m) for t, *m in held.matches(few.column("text"))]
                start += few.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs: (doc_id, text), benchmark: (item_id, text) -> one row per document and item that share a window:
    doc_id, tie (hash of the text), item_id (-1 for null), windows, item_windows, consistent, exact, contaminated.

    contaminated: slots are consistent and at least `coverage` of the item's windows match on one chain of diagonals.
    """
    spark = session_of(docs)
    small_batches(spark)
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text", F.xxhash64("item_id", "text").alias("item"))
    items = cut(items.dropDuplicates(["item"]), "items")
    keys = cut(items.select("item", "text").mapInArrow(_item_keys(block_chars), "item long, size long, key long"), "item-keys")
    shared = spark.sparkContext.broadcast(key_filter(keys))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    near = cut(texts.mapInArrow(_candidates(shared), "doc_id long, tie long, text string, keys array<long>"), "candidates")
    # rows equal in doc_id and text meet the same items, so they go through once and count as often as they stand there
    asked = near.select("doc_id", "tie", F.explode("keys").alias("key")).distinct()
    pairs = cut(asked.join(keys.where("item is not null").select("item", "key"), "key").select("doc_id", "tie", "item").distinct(), "pairs")
    met = pairs.withColumnsRenamed({"doc_id": "k", "tie": "t"}).join(near.drop("keys"), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")))
    met = met.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").select("doc_id", "tie", "text", "item_id", "item_text")
    found = cut(met.sortWithinPartitions("item_id").mapInArrow(_compare, FOUND), "leaks")
    drop(items, keys, near, pairs)
    return found.withColumn("contaminated", F.col("consistent") & (F.col("windows") >= coverage * F.col("item_windows")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """docs without the contaminated ones."""
    key, tie = fresh(docs, "leak_id", "leak_tie")
    bad = find_leaks(docs.select("doc_id", "text"), benchmark, coverage).where("contaminated").select(F.col("doc_id").alias(key), F.col("tie").alias(tie)).distinct()
    bad = cut(bad, "leaks")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(tie)), "left_anti")
