"""First-fit decreasing with cuts: plans against a plain first fit, whole packings against the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfmart.llm import tournament
from shelfmart.llm.bytetokens import ByteEncoder
from shelfmart.llm.common import tokenizer_path
from shelfmart.llm.packing import sequences
from tests.llm.test_tokens import ODD

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return ByteEncoder(PATH)


def ids_of(coder, text):
    return np.array(coder.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_encoder_gives_the_tokenizers_ids(coder, monkeypatch):
    rng = random.Random(1)
    signs = "aB'.,! \n\t1é<|endoftext|>ßÀ́ ²_-ªº½\x1c\xa0\x85\xad"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(60)) for _ in range(800)]
    for text, data in zip(texts, coder.encode(texts), strict=True):
        assert data == ids_of(coder, text).tobytes(), text
    monkeypatch.setattr("shelfmart.llm.bytetokens.CACHE_ENTRIES", 50)
    for at in range(0, len(texts), 20):
        for text, data in zip(texts[at : at + 20], coder.encode(texts[at : at + 20]), strict=True):
            assert data == ids_of(coder, text).tobytes(), text


def _plain_first_fit(lengths, capacity):
    rooms, out = [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = next((i for i, r in enumerate(rooms) if r >= lengths[k]), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
            out.append([])
        rooms[at] -= lengths[k]
        out[at].append(k)
    return out


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_tree_finds_the_first_sequence(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 70))]
        assert tournament.first_fit_decreasing(lengths, capacity) == _plain_first_fit(lengths, capacity)


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_every_id_once_and_no_padding(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        lengths = [rng.randint(1, 3 * capacity) for _ in range(rng.randint(0, 40))]
        covered = defaultdict(list)
        for pieces in tournament.pack_group(lengths, capacity):
            n = sum(k for _, _, k in pieces)
            assert n == capacity or n < capacity and n & (n - 1) == 0
            for row, start, length in pieces:
                assert length > 0
                covered[row] += range(start, start + length)
        assert {r: sorted(c) for r, c in covered.items()} == {k: list(range(n)) for k, n in enumerate(lengths)}


def _checked(coder, edge_rows, out, capacity):
    wanted = Counter((i, np.append(ids_of(coder, t), 1).astype("<u4").tobytes()) for i, t in edge_rows)
    in_sequence, at = defaultdict(list), defaultdict(list)
    for r in out:
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        in_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        at[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    for pieces in in_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == capacity or end < capacity and end & (end - 1) == 0
    # pieces of rows with one id and length may be of either, so count the bytes at each start
    for (doc, n), pieces in at.items():
        rows = [d for (i, d), times in wanted.items() if i == doc and len(d) == 4 * n for _ in range(times)]
        starts = Counter(start + k for start, ids in pieces for k in range(len(ids) // 4))
        assert starts == {k: len(rows) for k in range(n)}
        if len(set(rows)) == 1:
            assert all(rows[0][4 * start :].startswith(ids) for start, ids in pieces)
    assert sum(r["length"] for r in out) == sum(len(d) // 4 * times for (_, d), times in wanted.items())


@pytest.mark.parametrize("group_bytes", [1 << 22, 20_000])
def test_packing(coder, edge_rows, edge_docs, no_docs, monkeypatch, group_bytes):
    monkeypatch.setattr(tournament, "GROUP_BYTES", group_bytes)
    packed = tournament.pack(edge_docs, PATH, keep_ids=True).cache()
    _checked(coder, edge_rows, packed.collect(), tournament.CAPACITY)
    assert tournament.padding(packed).first()["padding"] == 0
    whole = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    tokens = sum(len(ids_of(coder, t)) + 1 for _, t in edge_rows)
    assert sum(len(v) for v in whole.values()) == 4 * tokens
    assert tournament.pack(no_docs, PATH).collect() == []
    assert tournament.pack(no_docs, PATH).columns == packed.drop("ids").columns


def test_other_capacity_and_columns(coder, edge_rows, edge_docs):
    renamed = edge_docs.select("text", "doc_id").withColumnsRenamed({"doc_id": "t", "text": "k"})
    out = tournament.pack(renamed, PATH, capacity=100, keep_ids=True, doc_id="t", text="k").collect()
    _checked(coder, edge_rows, out, 100)


def test_query_has_no_padding(spark, small):
    packed = tournament.op11_tournament_packing(spark, small).cache()
    figures = tournament.padding(packed).first()
    assert figures["padding"] == 0 and figures["tokens"] == packed.selectExpr("sum(length)").first()[0]
    documents = spark.read.parquet(f"{small}/documents.parquet").count()
    assert packed.where("start + length = doc_tokens").count() == documents
