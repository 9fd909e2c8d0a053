"""Operators and pipeline stages against brute force, and their defined cases."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronocell.llm import common, decontam, fingerprints, kernels, language, licenses, linededup, lmscore, mixing, neardup, secrets, simjoin, toxicity

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(n, links):
    parent = list(range(n))
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(n)]


def alike(sets, threshold):
    """Index pairs of sets with at least that Jaccard: sets that meet it share an element of their rarest ones."""
    held, met, links = Counter(x for s in sets for x in s), defaultdict(list), set()
    for i, s in enumerate(sets):
        rare = sorted(s, key=lambda x: (held[x], str(x)))[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]
        for j in {j for x in rare for j in met[x]}:
            both = len(s & sets[j])
            if both >= threshold * (len(s) + len(sets[j]) - both) - 1e-9:
                links.add((j, i))
        for x in rare:
            met[x].append(i)
    return links


def gone_lines(docs, threshold=0.8):
    """{doc_id: places} of the lines that go."""
    places = [((i is None, i or 0, j), line.lower().strip(" ")) for i, t in docs for j, line in enumerate((t or "").split("\n"))]
    places = [(spot, line) for spot, line in places if line]
    lines = sorted({line for _, line in places})
    raw = [line.encode() for line in lines]
    root = components(len(lines), alike([frozenset(x[k : k + 7] for k in range(max(1, len(x) - 6))) for x in raw], threshold))
    at, best, gone = {line: root[k] for k, line in enumerate(lines)}, {}, defaultdict(set)
    for spot, line in places:
        best[at[line]] = min(best.get(at[line], spot), spot)
    for spot, line in places:
        if spot != best[at[line]]:
            gone[spot[1]].add(spot[2])
    return gone


def without(docs, gone):
    return {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, t in docs}


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_line_dedup_equals_an_exact_join(spark, corpus):
    docs = pairs(corpus)
    rng = np.random.default_rng(1)
    word = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(40)]
    base = [" ".join(rng.choice(word, 12)) for _ in range(60)]
    near = [" ".join(w if rng.random() > 0.06 else rng.choice(word) for w in b.split()) for b in base for _ in range(12)]
    docs += [(10_000 + i, "\n".join(near[i::30] + ["A short LINE ", "", "x"])) for i in range(30)]
    found = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(docs, TEXTS)).collect()}
    gone = gone_lines(docs)
    wanted = without(docs, gone)
    assert {i: r.text for i, r in found.items()} == wanted
    assert {i: r.n_dropped for i, r in found.items()} == {i: len(gone[i]) for i, _ in docs}


def test_one_very_common_line(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_SHARE", 0.2)
    monkeypatch.setattr(simjoin, "HOT", 2)
    monkeypatch.setattr(simjoin, "BLOCK", 3)
    docs = [(i, f"the very common line of all\nthe very common line of all {i % 9}\nown words {chr(97 + i) * 30}") for i in range(25)]
    found = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, TEXTS)).collect()}
    assert found == without(docs, gone_lines(docs))


def test_blocks_of_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "HOT", 2)
    monkeypatch.setattr(simjoin, "BLOCK", 4)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, 60)) for _ in range(4)]
    texts = [" ".join(w if rng.random() > p else str(rng.choice(words)) for w in b) for b in base for p in [0.01] * 15 + [0.05] * 15]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), TEXTS), 3, 60).collect()}
    root = components(len(texts), alike([neardup.shingle_set(t, 3) for t in texts], 0.6))
    assert found == dict(enumerate(root)) and len(set(root)) > 4


def test_setsketch_registers_merge():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    one = lambda *x: neardup.registers_of(np.concatenate(x), np.array([0]))
    assert (neardup.merge(one(a), one(b)) == one(a, b)).all()


def test_union_find_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "ONE_TASK_EDGES", -1)
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 600)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (250, 2))] + [(5, 5)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    root = components(1400, edges)
    assert found == {i: root[i] for e in edges if e[0] != e[1] for i in e}


def test_mixing_is_the_greedy_order_whatever_the_bins(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{i % 4}" if i % 3 else "s0") for i in range(400)], "doc_id long, text string, source string")
    few, many = (sorted(map(tuple, mixing.pareto_mix(docs, bin_rows=n).collect())) for n in (7, 10_000))
    assert few == many
    by = defaultdict(list)
    hashed = docs.select("doc_id", "source", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(7)).alias("h"), F.xxhash64("text").alias("tie"))
    hashes = {r.doc_id: r for r in hashed.collect()}
    for r in mixing.pareto_mix(docs).collect():
        by[hashes[r.doc_id].source].append(r)
    for own in by.values():
        size, target = own[0].source_size, own[0].target
        whole = math.floor(target / size + 1e-9)
        rest = max(0.0, target - whole * size)
        f = min(max(rest / size, 1e-12), 1 - 1e-12)

        def key(r):
            u = ((hashes[r.doc_id].h % (1 << 52)) + 0.5) / float(1 << 52)
            q = math.exp(min(max(math.log(u / (1 - u)) - 0.5 * math.log(r.size * len(own) / size) - math.log(f / (1 - f)), -600.0), 600.0))
            return min(math.floor(q / (1 + q) * float(1 << 48)), (1 << 48) - 1), r.doc_id

        extra = set()
        for _ in range(mixing.FILLS):
            left = rest
            for r in sorted((r for r in own if r.doc_id not in extra and r.size <= rest), key=key):
                if r.size > left:
                    break
                left -= r.size
                extra.add(r.doc_id)
            rest = left
        extra |= set([r.doc_id for r in sorted(own, key=key) if r.doc_id not in extra and r.size < 2 * rest][:1])
        assert {r.doc_id: r.copies for r in own} == {r.doc_id: min(3, whole + (r.doc_id in extra)) for r in own}


def test_toxicity_kernel_is_the_plain_one():
    words = [b"ABCDE", b"AXBCDE", b"MORONIC", b"ABC", b"AAAAAAA"]
    kind, first = toxicity.unspell(words)
    rng = np.random.default_rng(6)
    beta = rng.normal(size=toxicity.CODES).astype(np.float32)
    found = toxicity.word_values(beta, kind, first)
    for w, value in zip(words, found):
        x = [toxicity.MARK] + [c - 64 for c in w]
        total = 0.0
        for i, j, k, m in combinations(range(len(x)), 4):
            if m - i <= 3 + toxicity.MOST_SKIPPED:
                total += toxicity.DECAY ** (m - i - 3) * beta[(x[i] << 15) | (x[j] << 10) | (x[k] << 5) | x[m]]
        assert math.isclose(value, total / toxicity.norms(np.array([len(x)]))[0], rel_tol=1e-3, abs_tol=1e-4)


def test_language_kernel_is_the_plain_one():
    texts = ["The house, near 2 rivers!", "the HOUSE of cards", "été à Paris", "...", "a"]
    owner, slot, has = language.presence(texts)
    slots = [set(slot[owner == i].tolist()) for i in range(len(texts))]

    def grams(t):
        joined = "".join(w + " " for w in re.findall(r"[^\W\d_]+", t.lower()))
        return {joined[i : i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1)}

    plain = [grams(t) for t in texts]
    assert has.tolist() == [True, True, True, False, True]
    assert all(len(slots[i] & slots[j]) == len(plain[i] & plain[j]) for i in range(5) for j in range(5))


def test_models_learn_from_whole_texts_and_all_labels(spark):
    filler = "some quiet words of no weight at all and more of them " * 400
    bad = spark.createDataFrame([(i, filler + (" you idiot moron" if i % 2 else " my friend"), i % 2) for i in range(60)], "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(bad)
    assert model.score(["what an idiot"])[0] > 0.5 > model.score(["a quiet friend"])[0]
    many = spark.createDataFrame([(i, "".join(chr(0x4E00 + i % 300 * 7 + k) for k in range(5)), f"l{i % 300}") for i in range(1200)], "doc_id long, text string, lang string")
    trained = language.train_language(many)
    assert len(trained.names) == 300
    tail = spark.createDataFrame([(i, "x " * 6000 + ("der die das und" if i % 2 else "the of and to") * 3, "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    assert language.train_language(tail).predict(["der und die", "the and of"])[0] == ["de", "en"]


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 50 == 0).cast("int").alias("toxic"))
    held = {r.label: r["count"] for r in kernels.bounded_sample(rows, "toxic", 500).groupBy("label").count().collect()}
    assert held[1] == 400 and 500 < held[0] < 800


@pytest.mark.parametrize("bound", [lmscore.BROADCAST_BYTES, 0])
def test_language_model_scores(spark, corpus, bound):
    """Levels read back exactly but for the few probes that a Bloom filter answers wrongly."""
    docs = corpus.select("doc_id", (kernels.remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    found = {r.doc_id: r for r in lmscore.score_texts(docs, bound).collect()}
    words = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in pairs(corpus)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    ones, twos = Counter(), Counter()
    for i, w in words.items():
        if not held[i]:
            ones.update(w)
            twos.update(zip([b"\n", *w], w))
    level = lambda c: c.bit_length()
    mean = lambda counts: {q: sum(x) / len(x) for q, x in {q: [c for c in counts.values() if level(c) == q] for q in {level(c) for c in counts.values()}}.items()}
    m1, m2, n, v = mean(ones), mean(twos), sum(ones.values()), len(ones)
    off = []
    for i, w in words.items():
        total = 0.0
        for a, b in zip([b"\n", *w], w):
            first, last = m1.get(level(ones[a]), 0.0), m1.get(level(ones[b]), 0.0)
            both = min(m2.get(level(twos[a, b]), 0.0), first) if last else 0.0
            total += math.log10(min(1.0, lmscore.WEIGHT * both / max(first, 1.0) + (1 - lmscore.WEIGHT) * (last + 1) / (n + v + 1)))
        off.append(abs(found[i].score - total) / abs(total))
        assert found[i].train_tokens == n and found[i].held_out == held[i]
    assert np.median(off) < 0.01 and max(off) < 0.1


def test_language_model_shards_are_lean():
    """Exact sums, and few bytes for each word or bigram that the chunks send."""
    import tracemalloc

    rng, ones, twos = np.random.default_rng(3), Counter(), Counter()
    vocab = np.array([f"w{i}é".encode() for i in range(20_000)] + [b"\n"], object)
    words, pairs_ = [], []
    for chunk in range(100):
        own, n = rng.choice(len(vocab), 2000, replace=False), rng.integers(0, 9, 2000)
        ones.update(dict(zip(vocab[own].tolist(), n.tolist())))
        words.append(("words", chunk, 0, b" ".join(vocab[own]), n.astype(np.uint32).tobytes()))
        h = np.unique(rng.integers(0, 50_000, 8000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        twos.update(h.tolist())
        pairs_.append(("bigrams", chunk, 0, h.tobytes(), np.ones(len(h), np.uint32).tobytes()))

    def peak(rows):
        table = pa.Table.from_batches([lmscore._messages(rows[i : i + 30]) for i in range(0, len(rows), 30)])
        tracemalloc.start()
        out = lmscore._add(1)(table).to_pylist()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    (bits, *sums), most = peak(words)
    assert most < 80 * 200_000
    kind = np.uint32 if len(sums[0]["data"]) == 4 * 2000 else np.int64
    for sent, back in zip(words, sums):
        own = sent[3].split(b" ")
        assert back["chunk"] == sent[1] and np.frombuffer(back["data"], kind).tolist() == [ones[w] for w in own]
        off = np.frombuffer(back["more"], np.uint8) - np.array([ones[w].bit_length() for w in own])
        assert (off >= 0).all() and off.mean() < 0.01
    assert np.frombuffer(bits["more"], np.float64).reshape(2, -1)[1].sum() == sum(ones.values())
    (bits,), most = peak(pairs_)
    assert most < 80 * sum(len(x[3]) // 8 for x in pairs_)
    model = lmscore.Filter(1, {0: bits["data"]})
    assert (model.levels(np.array(list(twos), np.uint64)) >= [n.bit_length() for n in twos.values()]).all()


def test_band_keys_travel_thin(monkeypatch):
    """The keys of a message take less than their eight bytes, and shards find the buckets that whole keys have."""
    rng = np.random.default_rng(5)
    registers = rng.integers(0, 1 << 16, (63_000, 64)).astype(np.uint16)
    registers[1000:1040] = registers[1000]  # a hot key in each band
    registers[2000:2010, :4] = registers[2000, :4]
    node = rng.integers(-(1 << 62), 1 << 62, len(registers))
    monkeypatch.setattr(simjoin, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 7)}))}))
    ends = np.arange(len(registers) + 1, dtype=np.int32) * 128
    sketch = pa.Array.from_buffers(pa.binary(), len(registers), [None, pa.py_buffer(ends), pa.py_buffer(registers.tobytes())])
    batch = pa.RecordBatch.from_arrays([pa.array(node), sketch], ["node", "sketch"])
    messages = pa.Table.from_batches(simjoin._packer(16, 4, 64, 32)(iter([batch])))
    whole, entries = sum(len(x) for name in ("keys", "nodes") for x in messages.column(name).to_pylist()), 16 * len(node)
    assert sum(len(x) for x in messages.column("nodes").to_pylist()) == 8 * entries and whole < 14.5 * entries
    found = defaultdict(set)
    for shard in set(messages.column("shard").to_pylist()):
        for r in simjoin._shared_keys(messages.filter(pa.compute.equal(messages.column("shard"), shard))).to_pylist():
            found[r["bucket"]].add(r["node"])
    expected = defaultdict(set)
    for n, keys in zip(node.tolist(), simjoin.band_keys(registers, 16, 4).view(np.int64).tolist()):
        for k in keys:
            expected[k].add(n)
    assert {k: v for k, v in found.items() if len(v) > 1} == {k: v for k, v in expected.items() if len(v) > 1}
    for keys in ([], [5], [9, 9, 9], [3, 2, 1 << 63, (1 << 64) - 1, 0]):
        keys = np.array(keys, np.uint64)
        assert simjoin._thick(simjoin._thin(keys), len(keys)).tolist() == keys.tolist()


def test_shards_count_their_buckets(monkeypatch):
    """A node packed twice makes no bucket of its own; sizes are counted in the shard, but for keys that are hot in a batch."""
    rng = np.random.default_rng(6)
    registers = rng.integers(0, 1 << 16, (300, 64)).astype(np.uint16)
    registers[10:13, :4] = registers[10, :4]
    registers[100:140] = registers[100]  # hot in each band
    registers[201] = registers[200]
    node = rng.integers(-(1 << 62), 1 << 62, len(registers))
    monkeypatch.setattr(simjoin, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 7)}))}))

    def messages(at):
        batch = pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([r.tobytes() for r in registers[at]], pa.binary())], ["node", "sketch"])
        return list(simjoin._packer(16, 4, 64, 32)(iter([batch])))

    # the first task meets one node twenty times more than the one that shares its keys, the second most nodes again
    packed = pa.Table.from_batches(messages(np.r_[0:120, [200] * 20, 201]) + messages(np.r_[5:200, 202:300]))
    found, sizes = defaultdict(set), defaultdict(set)
    for shard in set(packed.column("shard").to_pylist()):
        for r in simjoin._shared_keys(packed.filter(pa.compute.equal(packed.column("shard"), shard))).to_pylist():
            found[r["bucket"]].add(r["node"]), sizes[r["bucket"]].add(r["size"])
    expected = defaultdict(set)
    for n, keys in zip(node.tolist(), simjoin.band_keys(registers, 16, 4).view(np.int64).tolist()):
        for k in keys:
            expected[k].add(n)
    assert found == {k: v for k, v in expected.items() if len(v) > 1}
    assert sizes == {k: {len(v) if len(v) < 40 else 0} for k, v in found.items()}


def test_lines_carry_registers_and_full_signatures_only_in_buckets():
    """A line's row holds 64 registers and nothing more; the full signature of a line in a bucket begins with the same ones."""
    texts = ["A line of its own\n\n  a Line of its own  \nshort", "-" * 300 + "\nein längerer Text über 7 Äpfel, über 7 Äpfel", None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array(texts)], ["doc_id", "tie", "text"])
    lines = pa.Table.from_batches(linededup._signer(iter([batch])))
    first = lines.filter(pa.compute.is_valid(lines.column("sketch"))).combine_chunks()
    assert lines.num_rows == 5 and first.num_rows == 4 and {len(x) for x in first.column("sketch").to_pylist()} == {2 * linededup.HASHES}
    rows = first.select(["node", "norm"]).rename_columns(["node", "text"]).to_batches()[0]
    full = pa.Table.from_batches(linededup._full_signer(iter([rows])))
    assert [x[: 2 * linededup.HASHES] for x in full.column("sketch").to_pylist()] == first.column("sketch").to_pylist()
    sets = [{x.encode()[i : i + 7] for i in range(max(1, len(x.encode()) - 6))} for x in rows.column("text").to_pylist()]
    assert full.column("n").to_pylist() == [len(x) for x in sets] and full.column("node").to_pylist() == rows.column("node").to_pylist()


def plain_leaks(docs, bench):
    """(doc, item) pairs of texts without names and numbers: half of an item's windows stand in the document."""
    words = lambda t: [w for w in ((x.strip("\"'.,;:!?()[]{}<>*_`~$&#@%^=|/\\+-")).lower() for x in (t or "").split())]
    out = set()
    grams = {i: {tuple(w[k : k + 8]) for k in range(len(w) - 7)} for i, w in ((i, words(t)) for i, t in docs)}
    for item, t in bench:
        w = words(t)
        own = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        out |= {(i, item) for i, g in grams.items() if own and sum(x in g for x in own) >= 0.5 * len(own)}
    return out


def test_decontamination_equals_plain_windows(spark, corpus):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(corpus, bench).where("contaminated").collect()}
    assert found == plain_leaks(pairs(corpus), [(r.item_id, r.text) for r in bench.collect()]) and found
    again = {(r.doc_id, r.item_id) for r in decontam.find_leaks(corpus, bench, block_chars=2000).where("contaminated").collect()}
    assert again == found


def test_slots_agree_both_ways_for_names():
    item = "So when the old train leaves the station Anna sees that Bob is late and waits for him there with Anna and Bob"
    one = decontam.Benchmark([(1, item)])
    match = lambda t: next(iter(one.matches(pa.array([t]))))
    assert match(item.replace("Anna", "Carl").replace("Bob", "Dora"))[4]
    merged = match(item.replace("Anna", "Carl").replace("Bob", "Carl"))
    assert not (merged[4] and merged[2] == merged[3])


def test_licenses_are_not_named_after_siblings(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "licensed under the gnu general public license version 3", None, ""]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), TEXTS)).collect()}
    assert [found[i].labels for i in range(6)] == ["cc-by,cc-by-nc", "cc-by", "cc-by,cc-by-sa", "gpl", "", ""]


def test_edits_are_located_by_branches(spark):
    base = "first section here\nwith two lines in it\n\nsecond one is short\n\nthird one has three lines\nthe middle one of them\nand the last"
    texts = {"same": base, "front": "a new section\n\n" + base, "inside": base.replace("middle", "centre"), "gone": base.split("\n\n", 1)[1]}
    df = spark.createDataFrame([(k, base, v) for k, v in texts.items()], "k string, a string, b string")
    both = fingerprints.with_tree(fingerprints.with_tree(df, "a", "x"), "b", "y")
    found = {r.k: r for r in both.select("k", fingerprints.likeness("x", "y").alias("near"), *[v.alias(n) for n, v in fingerprints.edits("x", "y").items()], (fingerprints.as_string("x") == fingerprints.as_string("y")).alias("equal")).collect()}
    assert (found["same"].equal, found["same"].near, found["same"].changed_sections) == (True, 1.0, "")
    assert (found["front"].changed_sections, found["front"].equal) == ("", False) and found["front"].near > 0.8
    assert (found["inside"].changed_sections, found["inside"].changed_paragraphs) == ("2", "2.1")
    assert (found["gone"].changed_sections, found["gone"].changed_paragraphs) == ("0", "0.0,0.1")


def test_ledger_on_disk(spark):
    rules = secrets.RULES
    texts = [(1, 'token = "abcdefghijklmnop"'), (2, "nothing"), (3, None), (4, 'token = "abcdefghijklmnop"')]
    one, two = (spark.createDataFrame(x, TEXTS) for x in (texts[:2], texts + [(5, "0123456789abcdef01")]))
    ledger = secrets.SecretLedger(spark)
    ledger.push(one)
    assert (ledger.pairs().count(), ledger.findings().count()) == (2, 1)
    ledger.push(two)
    assert (ledger.pairs().count(), ledger.findings().count()) == (4, 2)
    assert ledger.findings(rules[:2]).count() == 0 and secrets.version_of(rules) != secrets.version_of(rules[:2])
    found = sorted((r.doc_id, r.n_assign, r.n_hex) for r in secrets.scan_history([one, two], ledger).collect())
    assert found == [(1, 1, 0), (1, 1, 0), (2, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (5, 0, 1)]


def test_columns_of_clashing_names(spark):
    long = " ".join(f"word{i}" for i in range(30))
    extra = "doc_id long, text string, source string, places string, __k long, gone_id long, size long, copies long, taken long, score string, lang_pred int, n_lines int, tie long, kept boolean"
    rows = [(i, long if i < 3 else f"{long} {i}", "s", "p", 7, 7, 7, 7, 7, "x", 7, 7, 7, True) for i in range(6)]
    docs = spark.createDataFrame(rows, extra)
    lines = linededup.dedup_lines(docs)
    assert lines.columns.count("n_lines") == 1 and {r.places for r in lines.collect()} == {"p"}
    mixed = mixing.apply_mix(docs, mixing.pareto_mix(docs))
    assert mixed.columns.count("size") == 1 and {r.size for r in mixed.collect()} == {30, 31}
    assert neardup.drop_near_duplicates(docs).columns == docs.columns and neardup.drop_near_duplicates(docs).count() == 1
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    assert decontam.drop_leaks(docs, bench).columns == docs.columns and decontam.drop_leaks(docs, bench).count() == 0
    model = language.train_language(spark.createDataFrame([(i, "word one", "en") for i in range(5)], "doc_id long, text string, lang string"))
    for m in (model, None):
        out = language.predict_language(docs, m)
        assert out.columns.count("score") == 1 and {r.lang_pred for r in out.collect()} <= {"en", "und"}
    for judge in (None, toxicity.ToxicityModel(np.zeros(toxicity.CODES, np.float32), 1.0, 0.0, 0.0)):
        out = toxicity.score_toxicity(docs, judge)
        assert out.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in out.collect())


def test_repeated_rows_and_ties(spark):
    twice = [(1, "same words here and there\nown line one"), (1, "same words here and there\nown line one"), (2, "same words here and there\nown line two x")]
    found = linededup.dedup_lines(spark.createDataFrame(twice, TEXTS)).collect()
    assert len(found) == 3 and len({r.text for r in found if r.doc_id == 1}) == 1
    mixed = mixing.pareto_mix(spark.createDataFrame([(1, "a b", "s")] * 3 + [(2, "a b", "s")], "doc_id long, text string, source string")).collect()
    assert len(mixed) == 4 and sum(r.taken for r in mixed) <= 8
    model = toxicity.ToxicityModel(np.ones(toxicity.CODES, np.float32), 1.0, 0.0, 0.0)
    assert toxicity.score_toxicity(spark.createDataFrame([], TEXTS), model).count() == 0
    scores = {r.score for r in toxicity.score_toxicity(spark.createDataFrame(twice[:2], TEXTS), model).collect()}
    assert len(scores) == 1


def test_stages_do_their_work(spark, corpus, tmp_path):
    """Every stage of the pipeline on what the one before kept, against plain Python."""
    docs = corpus
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs)
        docs = common.cut(stage(spark, docs, SF), name)
        if name != "mix":
            assert docs.columns == corpus.columns
        kept[name] = (before, pairs(docs))
    before, after = kept["language_id"]
    assert sorted(after) == sorted((i, t) for i, t in before if any(c.isalpha() for c in t or ""))
    before, after = kept["line_dedup"]
    left = without(before, gone_lines(before))
    assert dict(after) == {i: t for i, t in left.items() if t.strip(" ")}
    before, after = kept["near_dedup"]
    order = sorted(before)
    root = components(len(order), alike([neardup.shingle_set(t, 5) for _, t in order], 0.8))
    assert sorted(after) == [x for k, x in enumerate(order) if root[k] == k]
    before, after = kept["decontaminate"]
    leaks = {i for i, _ in plain_leaks(before, bench)}
    assert sorted(after) == sorted(x for x in before if x[0] not in leaks)
    before, after = kept["mix"]
    plan = {r.doc_id: r for r in mixing.pareto_mix(spark.createDataFrame(before, TEXTS).join(corpus.select("doc_id", "source"), "doc_id")).collect()}
    assert {r.doc_id: (r.size, r.copies, r.taken) for r in docs.collect()} == {i: (r.size, r.copies, r.taken) for i, r in plan.items() if r.copies}


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, and no rows at all."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "alpha beta gamma", None, None, None), (None, "other words of their own", "en", "a", 1), (1, None, "en", "a", 0), (1, "", None, "b", 0), (2, "long " * 30_000, "en", "b", 1), (2, "long " * 30_000, "en", "b", 1), (3, "123 456", "en", None, 7)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a benchmark item"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([], columns)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = common.cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == (0 if not n else 3)
