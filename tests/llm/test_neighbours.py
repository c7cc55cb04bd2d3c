"""Nearest neighbours against brute force, with ties, odd vectors and several lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmart.llm import neighbours
from tests.conftest import rows

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score string, uid string, ids string"


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def _expected(table, k):
    """All candidates of every query, best first, cut at k; repeated rows once."""
    kept = {(i, tuple(v)) for i, v, *_ in table if i is not None and _usable(v)}
    out = []
    for query in sorted({i for i, _ in kept if i % 20 == 0}):
        mine = [np.array(q) for j, q in kept if j == query]
        scored = {
            (max(float(np.add.reduce(np.array(x) * q)) for q in mine), i, x) for i, x in kept if i != query
        }
        best = sorted(scored, key=lambda s: (-s[0], s[1]))[:k]
        out += [(query, n, i, score) for n, (score, i, _) in enumerate(best, start=1)]
    return out


def _found(spark, table, k):
    rows_ = [(i, v, 1, "a", "b", "c", "d") for i, v, *_ in table]
    frame = spark.createDataFrame(rows_, SCHEMA).repartition(3)
    return rows(neighbours.search(frame, F.col("vec_id") % 20 == 0, k).select("query_id", "rank", "vec_id", "score"))


ODD = [(500, None), (520, [0.0] * 4), (540, [1.0, None, 0.0, 0.0]), (560, [float("nan"), 1.0, 0.0, 0.0]), (580, [float("inf"), 1.0, 0.0, 0.0]),
       (None, [1.0, 2.0, 3.0, 4.0])]


def test_few_rows_with_nulls_ties_and_repeats(spark):
    rng = random.Random(1)
    table = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(120)]
    table += table[:7] + ODD + [(1000 + i, table[3][1]) for i in range(30)]
    assert _found(spark, table, 20) == _expected(table, 20)


def test_many_different_vectors_of_one_score(spark):
    """199 vectors with the same product with the query: the smaller ids win."""
    table = [(200, [1.0, 0.0, 0.0, 0.0])] + [(i, [1.0, float(i), float(-i), 2.0]) for i in range(199, 0, -1)]
    found = [r for r in _found(spark, table, 20) if r[0] == 200]
    assert [r[2] for r in found] == list(range(1, 21)) and {r[3] for r in found} == {1.0}


def test_an_id_with_several_vectors_is_not_its_own_neighbour(spark):
    rng = random.Random(2)
    table = [(20, [9.0, 9.0, 9.0, float(k)]) for k in range(6)] + [(i, [rng.random() for _ in range(4)]) for i in range(1, 10)]
    assert [r[2] for r in _found(spark, table, 4)] == [r[2] for r in _expected(table, 4)]


def test_no_rows_and_mixed_lengths(spark):
    frame = spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in ODD], SCHEMA)
    for none in (frame, frame.limit(0)):
        assert neighbours.search(none, F.col("vec_id") % 20 == 0).collect() == []
    mixed = spark.createDataFrame([(1, [1.0], 1, *"abcd"), (2, [1.0, 2.0], 1, *"abcd")], SCHEMA)
    with pytest.raises(ValueError):
        neighbours.search(mixed, F.col("vec_id") % 20 == 0)


@pytest.mark.parametrize("spread", [0.2, 1.0])
def test_recall_over_several_lists(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 1500)] + spread * rng.normal(size=(1500, 16))
    table = [(i, v.tolist()) for i, v in enumerate(vectors)]
    wanted = {(q, i) for q, _, i, _ in _expected(table, 10)}
    found = {(q, i) for q, _, i, _ in _found(spark, table, 10)}
    assert len(found & wanted) >= 0.9 * len(wanted) and len(found) == len(wanted)
