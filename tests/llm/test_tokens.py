import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmart.llm import grammar, packing, wordpieces
from shelfmart.llm.common import tokenizer_path
from shelfmart.llm.packing import Plan
from shelfmart.llm.tokens import Encoder

ODD = [
    "", None, "<|endoftext|> x <|ENDOFTEXT|>", "don't we'll I'M 'S", "a\x1cb c\x85d e f g", "ΣΑΣ ΣΑΣ. Ǆ İ ß ẞ",
    "é ́x", "x²½ 12a3 ªº µm", "日本語 テスト 🎉🎉!", "!!.. a.b,c ;;' '", "tab\tnew\nline\r\nx", "A" * 3000, "\x00 ﻿​ x",
]


@pytest.fixture(scope="module")
def coder():
    return Encoder(tokenizer_path())


def ids_of(coder, text):
    return np.array(coder.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_encoder_gives_the_tokenizers_ids(coder):
    rng = random.Random(1)
    signs = "aB'.,! \n\t1é<|endoftext|>ßÀ́ ²_-"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(60)) for _ in range(500)]
    for text, data in zip(texts, coder.encode(texts), strict=True):
        assert data == ids_of(coder, text).tobytes(), text


def _lengths_placed(plan, counts):
    """Sequences as lists of (offset, length), from the plan's runs."""
    table, out = plan.table(), defaultdict(list)
    runs = list(zip(*[c.tolist() for c in table.values()], strict=True))
    for k, (length, rank, sequence, each, offset) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
        for i in range(end - rank):
            out[sequence + i // each].append((offset + i % each * length, length))
    return out


def _fewest(lengths, capacity):
    best = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
            rooms[j] -= lengths[k]
            go(k + 1, rooms)
            rooms[j] += lengths[k]
        go(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


@pytest.mark.parametrize("capacity", [7, 20, 100])
def test_plan_places_every_piece_without_gaps(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 150)))
        plan = Plan(dict(counts), capacity)
        placed = _lengths_placed(plan, counts)
        assert Counter(n for v in placed.values() for _, n in v) == counts
        assert len(placed) == plan.sequences
        for pieces in placed.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(8)]
        plan = Plan(dict(Counter(lengths)), 20)
        rest = Counter(lengths)
        placed = _lengths_placed(plan, Counter(lengths))
        for sequence in range(plan.fixed_sequences):
            rest.subtract(n for _, n in placed[sequence])
        left = list(rest.elements())
        assert plan.fixed_sequences + (_fewest(left, 20) if left else 0) == _fewest(lengths, 20)


def test_packing_of_edge_rows(coder, edge_docs, edge_rows):
    packed = packing.pack(edge_docs, tokenizer_path(), keep_ids=True)
    rows = packed.collect()
    want = Counter()
    for key, text in edge_rows:
        ids = np.append(ids_of(coder, text), np.uint32(1)).astype("<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096].tobytes()
            want[key, piece, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for sequence, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            assert whole[sequence][4 * at : 4 * (at + r.length)] == bytes(r.ids)
            at += r.length
        assert at <= 4096


def test_packing_of_no_rows(no_docs):
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_grammar_round_trips():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 5, 3000), np.zeros(999, int), np.array([], int), np.array([7]), np.tile(np.arange(9), 400)):
        g = grammar.compress(ids, 50_000)
        assert grammar.expand(g).tolist() == ids.tolist()
        for start, n in ((0, 5), (3, 17), (len(ids) - 4, 4)):
            if 0 <= start and start + n <= len(ids):
                assert grammar.slice_ids(g, start, n).tolist() == ids[start : start + n].tolist()
    assert len(grammar.compress(np.tile(np.arange(9), 400), 50_000).symbols) < 500


def test_grammar_ends_when_no_pair_occurs_twice():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 40_000, 1000)
    copies = np.concatenate([passage, [40_001], passage, [40_002], passage])
    g = grammar.compress(copies, 50_000)
    assert len(g.symbols) == 5 and g.rule_lengths.max() == 1000  # before: no rule
    words = np.tile(rng.integers(0, 300, 3000), 3)
    for ids in (rng.integers(0, 5, 3000), np.zeros(999, int), words, np.r_[np.zeros(500, int), words]):
        g = grammar.compress(ids, 50_000)
        assert grammar.expand(g).tolist() == ids.tolist()
        seen, last, symbols = Counter(), {}, g.symbols.tolist()
        for k, pair in enumerate(zip(symbols, symbols[1:])):
            if last.get(pair) != k - 1 or pair[0] != pair[1]:
                seen[pair] += 1
                last[pair] = k
        assert max(seen.values(), default=0) < 2
        assert len({tuple(r) for r in g.rules.tolist()}) == len(g.rules)


def test_token_files_of_edge_rows(spark, coder, edge_docs, edge_rows, tmp_path):
    grammar.write(edge_docs, str(tmp_path / "ids"), tokenizer_path())
    rows = grammar.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = Counter((i, (np.append(ids_of(coder, t), np.uint32(1)).astype("<u4")).tobytes()) for i, t in edge_rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want


def test_token_files_of_no_rows(spark, no_docs, tmp_path):
    grammar.write(no_docs, str(tmp_path / "ids"), tokenizer_path())
    assert grammar.read(spark, str(tmp_path / "ids")).count() == 0


def _greedy(word, first, later):
    n = at = 0
    while at < len(word):
        pieces = first if at == 0 else later
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_piece_automaton_is_greedy():
    rng = random.Random(0)
    for _ in range(300):
        first, later = ({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 8))} for _ in range(2))
        automaton = wordpieces.PieceAutomaton(first, later)
        for _ in range(10):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            assert automaton.count(word) == _greedy(word, first, later)


def test_token_counts_match_a_word_piece_model(edge_docs, edge_rows):
    from tokenizers import Tokenizer, models

    path = tokenizer_path("piece_bpe_32k.model")
    first, later = wordpieces.vocabulary(path)
    names = ["[UNK]", *first, *["##" + p for p in later]]
    model = Tokenizer(models.WordPiece({n: k for k, n in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=10**6))
    want = Counter()
    for key, text in edge_rows:
        words = (text or "").split()
        want[key, len(words), sum(len(model.encode(w).ids) for w in words)] += 1
    out = wordpieces.token_counts(edge_docs.withColumn("n_words", F.lit("x")), path)
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in out.collect()) == want
    assert wordpieces.token_counts(edge_docs.limit(0), path).count() == 0


def test_a_repeated_chain_takes_few_rounds(monkeypatch):
    """A passage of ascending ids that occurs twice: links of one frequency are taken many at a time."""
    rounds = []
    chosen = grammar._chosen
    monkeypatch.setattr(grammar, "_chosen", lambda *a: rounds.append(1) or chosen(*a))
    ids = np.tile(np.arange(8_000, dtype=np.uint32), 2)
    g = grammar.compress(ids, 10_000)
    assert len(rounds) < 60 and grammar.expand(g).tolist() == ids.tolist()
    assert g.rule_lengths.sum() < 40 * len(ids)


def test_a_slice_opens_few_rules():
    class Counted(np.ndarray):
        opened = 0

        def __getitem__(self, key):
            if np.isscalar(key):
                Counted.opened += 1
            return np.asarray(super().__getitem__(key))

    ids = np.tile(np.arange(4_000, dtype=np.uint32), 4)
    g = grammar.compress(ids, 10_000)
    g.rules = g.rules.view(Counted)
    for start in (0, 1, 3_999, 7_777, len(ids) - 1):
        Counted.opened = 0
        assert grammar.slice_ids(g, start, 1).tolist() == ids[start : start + 1].tolist()
        assert Counted.opened < 200 < len(g.rules)


def test_encoder_looks_up_a_repeated_word_once(coder, monkeypatch):
    class Counted(dict):
        looked_up = 0

        def get(self, key, default=None):
            Counted.looked_up += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.looked_up += 1
            return super().__getitem__(key)

    monkeypatch.setattr(coder, "lowered", Counted())
    texts = ["one two, three. " * 500, "Two THREE; one"]
    assert coder.encode(texts) == [ids_of(coder, t).tobytes() for t in texts]
    assert Counted.looked_up < 30  # before: a lookup for each of 1,503 words


def test_encoder_on_latin_characters(coder):
    rng = random.Random(2)
    signs = [chr(k) for k in range(1, 0x100)]
    texts = ["".join(rng.choice(signs[: rng.choice([127, 255])]) for _ in range(rng.randint(1, 20))) for _ in range(400)]
    for text, data in zip(texts, coder.encode(texts), strict=True):
        assert data == ids_of(coder, text).tobytes(), text


def test_rounds_look_up_no_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    ids = np.tile(rng.integers(0, 900, 5_000), 2)
    monkeypatch.setattr(np, "searchsorted", None)  # before: all places of a round were looked up among its pairs
    assert grammar.expand(grammar.compress(ids, 1_000)).tolist() == ids.tolist()


def test_rules_are_expanded_many_at_a_time(monkeypatch):
    ids = np.tile(np.arange(8_000, dtype=np.uint32), 2)
    g = grammar.compress(ids, 10_000)
    opened, calls = grammar._opened, []
    monkeypatch.setattr(grammar, "_opened", lambda *a: calls.append(1) or opened(*a))
    assert grammar.expand(g).tolist() == ids.tolist()
    assert len(calls) < 61 < len(g.rules)  # before: one rule after another


def test_grammar_of_symbols_too_wide_for_one_number():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 40_000, 40_000)
    ids = np.r_[passage, np.zeros(99, int), passage]
    g = grammar.compress(ids, 1 << 24)  # two symbols of 25 bits and a place of 17
    assert len(g.symbols) < 50 and grammar.expand(g).tolist() == ids.tolist()


def test_token_files_of_long_texts(spark, coder, tmp_path):
    """Texts longer than those encoded at once, in several blocks."""
    texts = [None, "Ab, c " * 900_000, "d e " * 10, "f. " * 400_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    grammar.write(docs, str(tmp_path / "ids"), tokenizer_path())
    rows = grammar.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [0, 1, 2, 3]
    for r, part, times in zip(rows, ("", "Ab, c", "d e", "f."), (0, 900_000, 10, 400_000)):
        assert bytes(r.ids) == ids_of(coder, part).tobytes() * times + (1).to_bytes(4, "little")
