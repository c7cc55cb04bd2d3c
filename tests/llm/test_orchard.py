"""Product codes against plain searches and a plain fit."""

import math
import random

import numpy as np
import pytest

from shelfmart.llm import orchard
from tests.conftest import rows

SCHEMA = "vec_id long, embedding array<double>, label int, code string, q string, error string, n string"


def _plain(book, points):
    d = ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("entries, width, spread", [(1, 1, 5), (3, 2, 2), (64, 4, 3), (64, 4, 500), (256, 1, 40), (40, 8, 9)])
def test_search_finds_the_nearest_and_lowest(entries, width, spread):
    rng = np.random.default_rng(entries)
    for _ in range(10):
        book = rng.integers(-spread, spread + 1, (entries, width))
        points = rng.integers(-2 * spread, 2 * spread + 1, (300, width))
        entry, distance = orchard.Orchard(book).nearest(points)
        wanted_entry, wanted = _plain(book, points)
        assert (entry == wanted_entry).all() and (distance == wanted).all()
    assert len(orchard.Orchard(book).nearest(points[:0])[0]) == 0


def test_search_skips_entries(monkeypatch):
    rng = np.random.default_rng(7)
    search = orchard.Orchard(rng.integers(-500, 500, (64, 4)))
    compared = []
    squared = orchard.Orchard._squared
    monkeypatch.setattr(orchard.Orchard, "_squared", lambda self, p, e: compared.append(len(p)) or squared(self, p, e))
    search.nearest(rng.integers(-500, 500, (1000, 4)))
    assert sum(compared) < 1000 * 64 / 2


def _expected(table, entries, rounds):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, v, y) for i, v, y in table if ok(v)]
    whole = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not whole:
        return []
    width = len(whole[0][1]) // 16
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in whole[:entries]] for p in range(16)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(v, p):
        return min((square(part(v, p), e), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = [[[] for _ in book] for book in books]
        for _, v, _ in whole:
            for p in range(16):
                moved[p][nearest(v, p)[1]].append(part(v, p))
        books = [
            [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(book, ms, strict=True)]
            for book, ms in zip(books, moved, strict=True)
        ]
    coded = []
    for i, v, y in whole:
        found = [nearest(v, p) for p in range(16)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
    of_label = {}
    for _, _, error, y in coded:
        of_label[y] = of_label.get(y, 0) + error
    text = ",".join(str(x) for book in books for e in book for x in e)
    import hashlib

    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, y, c, e, of_label[y], sha) for i, c, e, y in coded), key=lambda r: [(x is None, x) for x in r])


def _table(n, seed):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([rng.uniform(-2, 2), rng.randint(-3, 3) / 256, -0.001]) for _ in range(32)]
    out = [(i, vector(), rng.choice([None, 1, 2, i])) for i in range(n)]
    same = vector()
    out += [(n + k % 3, same, 1) for k in range(9)] + [(None, same, None), (None, vector(), 5)]
    return out


ODD_ROWS = [
    (1, None, 1), (2, [None] + [0.5] * 31, 2), (3, [float("nan")] + [0.5] * 31, None), (4, [float("-inf")] + [0.1] * 31, 1),
    (5, [0.0] * 32, 3),
]


@pytest.mark.parametrize("n, entries, rounds", [(150, 8, 2), (40, 64, 2), (0, 64, 2), (60, 5, 0)])
def test_codes(spark, monkeypatch, n, entries, rounds):
    table = _table(n, n) + ODD_ROWS
    monkeypatch.setattr(orchard, "HOT_LABELS", 4)  # both kinds of labels
    docs = spark.createDataFrame([(*r, "x", "y", "z", "n") for r in table], SCHEMA).repartition(3)
    assert rows(orchard.encode(docs, entries, rounds)) == _expected(table, entries, rounds)


def test_no_rows_and_odd_lengths(spark):
    none = spark.createDataFrame([(r[0], r[1], r[2]) for r in ODD_ROWS[:4]], "vec_id long, embedding array<double>, label int")
    for empty in (none, none.limit(0)):
        found = orchard.encode(empty)
        assert found.collect() == []
        assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    for bad in ([[1.0] * 32, [1.0] * 16], [[1.0] * 17], [[]], [[1e6] * 16], [[-1e300] * 16]):
        table = spark.createDataFrame([(k, v, 1) for k, v in enumerate(bad)], none.schema)
        with pytest.raises(ValueError):
            orchard.encode(table)
