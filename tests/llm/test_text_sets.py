import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark import Broadcast
from pyspark.sql import functions as F

from shelfmart.llm import components as C, decontaminate, jaccard, substrings, toxicity
from tests.llm.conftest import prose


# Decontamination


def _windows(words, window):
    if len(words) < window:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}


def _hits(words, items, window):
    hit, found = set(), set()
    for name, item in items:
        for w in _windows(item, window):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(name)
    return hit, found


def test_automaton_finds_every_window():
    rng = random.Random(0)
    for _ in range(400):
        letters, window = "abc"[: rng.choice([2, 3])], rng.choice([2, 3, 4])
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(0, 7))]) for i in range(rng.randint(1, 5))]
        automaton = decontaminate.SuffixAutomaton(items, window)
        words = [rng.choice(letters + "z") for _ in range(rng.randint(0, 14))]
        places, found = automaton.hits(words)
        hit, names = _hits(words, items, window)
        assert {k for a, b in places for k in range(a, b)} == hit
        assert {automaton.names[k] for k in found} == names


@pytest.mark.parametrize("share", [1 << 19, 100])
def test_decontamination_of_edge_rows(spark, edge_docs, edge_rows, monkeypatch, share):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", share)
    page = prose(2, 120).split()
    items = [(10, " ".join(page[5:30])), (9, "ONE two, three"), (8, ""), (7, None), (None, "one two three"), (6, "!!"), (5, " ".join(page[20:60]))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, found string")
    out = decontaminate.matches(edge_docs.withColumn("n_hit", F.lit("x")), benchmark).collect()
    assert len(out) == len(edge_rows)
    plain = [(str(i), decontaminate.words_of(t)) for i, t in items if i is not None]
    want = Counter()
    for key, text in edge_rows:
        words = decontaminate.words_of(text)
        hit, names = _hits(words, plain, 13) if len(words) < 5000 else (set(), set())
        want[key, len(words), len(hit), ",".join(sorted(names)), bool(hit) and 20 * len(hit) >= len(words)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids), r.contaminated) for r in out)
    assert got == want
    assert decontaminate.matches(edge_docs.limit(0), benchmark).count() == 0
    assert decontaminate.matches(edge_docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_one_part_of_a_benchmark_is_held_at_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 2000)
    held, most, put, destroy = [], [], type(spark.sparkContext).broadcast, Broadcast.destroy

    def record(self, value):
        made = put(self, value)
        held.append(made)
        most.append(len(held))
        return made

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", record)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (held.remove(self), destroy(self, *a)))
    items = [(k, prose(500 + k, 60)) for k in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    both = " ".join(items[0][1].split()[:20] + items[1][1].split()[:20])
    docs = spark.createDataFrame([(1, both), (2, prose(900, 50)), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in decontaminate.matches(docs, benchmark).collect()}
    assert (out[1].n_words, out[1].n_hit, out[1].item_ids, out[1].contaminated) == (40, 40, ["0", "1"], True)
    assert (out[2].n_hit, out[3].n_words) == (0, 0)
    assert len(most) > 3 and max(most) == 1


def test_stretches_are_cut_out():
    text = "Äb, eins zwei drei! vier"
    assert decontaminate.words_of(text) == ["Äb".encode(), b"eins", b"zwei", b"drei", b"vier"]
    assert decontaminate.without_stretches(text, [{"start": 1, "end": 3}]) == "Äb,  drei! vier"


# Components and the Jaccard join


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (100, 102)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def _set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _component_ids(rows):
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    return Counter((i, len(sets[k]), min((x for x in ids[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows))


def _variants():
    """Families of texts that differ in some words: links on both sides of the threshold, chains among them."""
    rng = random.Random(3)
    rows = []
    for family in range(6):
        words = prose(50 + family, rng.randint(5, 80)).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 3)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("tile_rows", [2000, 3])
def test_jaccard_components(spark, edge_rows, monkeypatch, tile_rows):
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile_rows)
    rows = [(i if i is None else i + 1000, t) for i, t in edge_rows] + _variants()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string")
    out = jaccard.join(docs)
    got = out.collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _component_ids(rows)
    assert all(r.component_id == r.doc_id for r in got if r.keep and r.doc_id is not None)


@pytest.mark.parametrize("few, tile_rows", [(1, 2000), (1, 3), (4, 3)])
def test_jaccard_components_of_large_groups(spark, edge_rows, monkeypatch, few, tile_rows):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(jaccard, "SMALL_TILE", tile_rows)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "AGREE", jaccard.KEYS + 1)  # no set has a likely partner
    rows = [(i if i is None else i + 1000, t) for i, t in edge_rows] + _variants()
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _component_ids(rows)


def test_near_copies_are_not_met_by_every_shingle(spark, monkeypatch):
    rows, kept, write = [], [], jaccard.written
    for k in range(200):
        words = prose(7, 120).split()
        words[k % 120] = f"changed{k}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(jaccard, "written", lambda df, name: kept.append((name, write(df, name))) or kept[-1][1])
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, 0) for k in range(200)}
    made = {name: df.count() for name, df in kept}
    assert max(made.values()) <= 3 * len(rows), made


def test_jaccard_of_no_rows(no_docs):
    assert jaccard.join(no_docs).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 90), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(1, 20), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        size = min(len(x), len(y))
        assert jaccard.most_overlap(jaccard.folded(x, size), jaccard.folded(y, size), len(a), len(b)) >= both


# Repeated substrings


def _covered(rows, length=50):
    first = {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        for s in range(len(t) - length + 1):
            first.setdefault(t[s : s + length], i)
    out = []
    for i, t in rows:
        marks = np.zeros(len(t) + 1, dtype=bool)
        if i is not None:
            for s in range(len(t) - length + 1):
                if first[t[s : s + length]] < i:
                    marks[s : s + length] = True
        kept = np.frombuffer(t, dtype=np.uint8)[~marks[:-1]].tobytes()
        spans = int((np.diff(np.r_[0, marks[:-1].astype(int)]) == 1).sum())
        out.append((i, len(t), int(marks.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [2000, 0])
def test_repeated_substrings(spark, edge_rows, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_BLOCKS", hot)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 20_000)
    rng = random.Random(2)
    pool = [prose(200 + k, 9) for k in range(5)] + ["ab" * 40, "a" * 90]
    rows = [(i, t[:40_000] if t else t) for i, t in edge_rows]
    rows += [(200 + k, " ".join(rng.choice(pool) if rng.random() < 0.7 else prose(900 + k, 3) for _ in range(4))) for k in range(20)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = substrings.deduplicate(docs)
    assert Counter(tuple(r)[:5] for r in got.collect()) == _covered([(i, (t or "").encode()) for i, t in rows])
    assert substrings.deduplicate(docs.limit(0)).count() == 0


def test_anchors_of_repeated_rows_are_shared_in_any_order():
    for ids in ([1, 2, 1], [1, 1, 2], [2, 1, 2], [5, 5, 5]):
        rows = pd.DataFrame({"k": ids, "t": [prose(2, 120)] * 3, "named": [True] * 3})
        asked = np.concatenate([np.frombuffer(data, dtype=np.uint64) for _, data in substrings.Block(rows, 1).questions()])
        assert len(asked) and (asked & np.uint64(1) == (len(set(ids)) > 1)).all(), ids


def test_anchors_fall_evenly_on_the_buckets():
    texts = ["".join(random.Random(k).choices("abcdefgh ", k=2000)) for k in range(40)]
    rows = pd.DataFrame({"k": range(40), "t": texts, "named": True})
    sizes = [len(blob) for _, blob in substrings.Block(rows, 32).questions()]
    assert len(sizes) == 32 and max(sizes) < 2 * np.mean(sizes), sizes


def test_suffix_order_and_collisions(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(40)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.array([60 * k + rng.randrange(10) for k in range(40)])
    group = np.arange(40) // 7
    order = substrings.suffix_order(data, substrings.PrefixHashes(data), starts, group, 50)
    keys = [(int(group[k]), data[starts[k] : starts[k] + 50].tobytes()) for k in order]
    assert keys == sorted(keys)
    stretches = [bytes([0]) + b"x" * 20 + bytes([97 + k % 3]) * 30 for k in range(9)]
    want = substrings.least_of_windows(stretches, np.arange(9))[1].tolist()
    assert want == [0, 1, 2] * 3
    same = lambda self, starts, lengths: np.zeros(len(starts), dtype=np.uint64)
    monkeypatch.setattr(substrings.PrefixHashes, "of", same)
    assert substrings.least_of_windows(stretches, np.arange(9))[1].tolist() == want


def test_a_stretch_is_sorted_once_and_not_once_a_window(monkeypatch):
    rng, sorted_ = random.Random(6), []
    some = lambda n: bytes(rng.choice(b"ab\0") for _ in range(n))
    befores, afters = [some(30) for _ in range(4)], [some(30) for _ in range(4)]
    stretches = []
    for _ in range(60):
        place, more = rng.randrange(31), rng.randrange(31)
        head, tail = rng.choice(befores)[30 - place :], rng.choice(afters)[: max(more, 30 - place)]
        stretches.append(bytes([place]) + head + b"x" * 20 + tail)
    stretches = list(dict.fromkeys(stretches))
    order = substrings.suffix_order
    monkeypatch.setattr(substrings, "suffix_order", lambda d, h, starts, *more: sorted_.append(len(starts)) or order(d, h, starts, *more))
    least = np.arange(len(stretches))[::-1].copy()
    first, out = substrings.least_of_windows(stretches, least)
    best = {}
    windows = [(k[0] - s, k[1 + s : 51 + s], least[i]) for i, k in enumerate(stretches) for s in range(len(k) - 50)]
    for place, window, i in windows:
        best[place, window] = min(best.get((place, window), i), i)
    assert out.tolist() == [best[place, window] for place, window, _ in windows] and first[-1] == len(windows)
    assert sum(sorted_) == 2 * len(stretches) < len(windows)


def test_places_of_stretches_survive_packing():
    rng = np.random.default_rng(3)
    places = substrings.Places(
        np.sort(rng.integers(0, 9, 200)), np.arange(200) * 40, rng.integers(1, 32, 200), np.r_[np.arange(150), np.full(50, -1)]
    )
    again = substrings.Places.unpacked(places.packed())
    for name in ("doc", "start", "count", "stretch"):
        assert getattr(again, name).tolist() == getattr(places, name).tolist()
    bits = rng.integers(0, 1 << 31, 150).astype(np.uint32) & rng.integers(0, 1 << 31, 150).astype(np.uint32)
    marked = {}
    for doc, start, count, stretch in zip(places.doc, places.start, places.count, places.stretch):
        for nth in range(count):
            if stretch < 0 or bits[stretch] >> nth & 1:
                marked.setdefault(int(doc), set()).update(range(start + nth, start + nth + 50))
    runs = {d: {x for a, b in r for x in range(a, b)} for d, r in again.covered(bits).items()}
    assert runs == marked
    assert all(b < c for r in again.covered(bits).values() for (_, b), (c, _) in zip(r[:-1], r[1:]))


# Toxicity


def _labelled(n):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.15
        words = prose(1000 + i % 50, 30).split()
        if bad:
            words[rng.randrange(30)] = rng.choice(["vile", "rotten", "nasty"])
            words[rng.randrange(30)] = "nasty"
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = _labelled(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = toxicity.scored(docs, model).where(toxicity.is_held_out(F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in rows}
    assert len(held) > 150
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_held_out_labels_are_not_learned_from(spark):
    rows = _labelled(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_toxicity_of_edge_rows(spark, edge_docs, edge_rows):
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, toxic int")
    out = toxicity.scored(edge_docs, toxicity.fit(edge_docs, labels))
    got = out.collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert toxicity.fit(edge_docs.limit(0), labels.limit(0)).weights == {}
    assert toxicity.scored(edge_docs.limit(0), toxicity.Model({}, 0.0)).count() == 0


def test_negative_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(1)
    common = [b"w%d" % k for k in range(30)]
    make = lambda bad: [*rng.choice(common, 8).tolist(), *([b"bad"] if bad else [])]
    numbers = {}
    positive, unlabelled = toxicity.Documents(numbers), toxicity.Documents(numbers)
    for _ in range(60):
        positive.add(make(True))
    for k in range(600):
        unlabelled.add(make(k % 10 == 0))
    model = toxicity.train(positive, unlabelled, 0.1)
    assert model.score("bad w1 w2") > 0.5 > 0.3 > model.score("w1 w2")
