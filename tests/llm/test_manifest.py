"""The manifest against a plain tree."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from shelfmart.llm import manifest
from tests.conftest import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, n string, pos string, path string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(field, (doc_id, source, lang, n_chars, text)))


def _tree(hashes):
    """The root, and each leaf's siblings level by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            paths[k].append(("".join(hashes[run:i]), "".join(hashes[i + 1 : run + 3])))
            at[k] = i // 3
        hashes = [H(*hashes[i : i + 3]) for i in range(0, len(hashes), 3)]
    return hashes[0], paths


def _expected(table):
    by_source = {}
    for doc_id, text, lang, source, n_chars in table:
        other = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            other = text.replace("\n", "")
        leaf = _leaf(doc_id, source, lang, n_chars, text)
        by_source.setdefault(source, []).append((doc_id, leaf, _leaf(doc_id, source, lang, n_chars, other)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source, found in by_source.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = _tree([leaf for _, leaf, _ in found])
    if not order:
        return []
    root, upper = _tree([trees[s][0] for s in order])
    out = []
    for source, up in zip(order, upper, strict=True):
        subroot, paths = trees[source]
        for (doc_id, leaf, other), path in zip(by_source[source], paths, strict=True):
            proof = H(*[a + b for a, b in path + up])
            folded = other
            for a, b in path + up:
                folded = H(a, folded, b)
            out.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=lambda r: [(v is None, v) for v in r])


def _table(n, sources, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "a\nb\n", "é\n日本", "x" * rng.randint(1, 50), "\n"])
        source = None if rng.random() < 0.1 else f"s{rng.randint(0, sources - 1)}"
        out.append((rng.choice([i, i, i, None, 3]), text, rng.choice([None, "en"]), source, rng.choice([None, len(text or "")])))
    return out + out[:4]


def _docs(spark, table):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in table], SCHEMA).repartition(3)


@pytest.mark.parametrize("n, sources, levels", [(400, 5, 2), (60, 40, 1), (90, 12, 6)])
def test_manifest(spark, n, sources, levels):
    table = _table(n, sources, n)
    assert rows(manifest.manifest(_docs(spark, table), levels)) == _expected(table)


@pytest.mark.parametrize("count", [1, 2, 4, 9, 28])
def test_small_trees(spark, count):
    table = [(i, f"t\n{i}", "en", "one", 3) for i in range(count)]
    assert rows(manifest.manifest(_docs(spark, table), 2)) == _expected(table)


def test_one_row_of_several_sources(spark):
    table = [(1, None, None, None, None), (2, "a\n", "en", "", 2), (4, "b" * 200_000, "en", "Z", 9), (5, "b", "en", "é", 1), (7, "b", "en", "a", 1)]
    assert rows(manifest.manifest(_docs(spark, table))) == _expected(table)


def test_no_rows(spark):
    found = manifest.manifest(_docs(spark, [(1, "a", "b", "c", 1)]).limit(0))
    assert found.collect() == []
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_ranks_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEAST_ROWS_A_RANGE", 10)
    table = [(i % 50, "hot" if i % 3 else f"s{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(table, "k long, tree string, i long")
    found = manifest.ranked(df, ["k"]).collect()
    for tree in {t for _, t, _ in table}:
        mine = sorted((r["pos"], r["k"], r["n"]) for r in found if r["tree"] == tree)
        assert [p for p, _, _ in mine] == list(range(len(mine))) and {n for _, _, n in mine} == {len(mine)}
        assert [k for _, k, _ in mine] == sorted(k for k, t, _ in table if t == tree)


def test_proofs_are_emitted_without_joins(spark):
    rows_ = spark.createDataFrame([(i, "t") for i in range(30)], "i long, tree string")
    nodes = manifest.ranked(rows_, ["i"]).select("tree", "pos", "n", F.struct(F.sha2(F.col("i").cast("string"), 256).alias("hash")).alias("node"))
    roots, tiers = manifest.grown(nodes, 2)
    starts = roots.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    plan = manifest.spread(tiers, starts, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
