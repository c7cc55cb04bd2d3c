import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyzéß"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and long texts, repeated rows, equal ids, copies and near copies."""
    long = prose(1, 30_000)
    page = prose(2, 120)
    near = page.replace(page.split()[50], "changed", 1)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, long),
        (5, page),
        (5, page),
        (6, page),
        (7, near),
        (8, "one two three"),
        (9, "one two three"),
        (None, page),
        (None, None),
        (10, "!!! ... ???"),
        (11, prose(3, 90) + " mail a.b@mail7.example.com now, +1 (017) 555-7713 or 10.20.30.40"),
        (12, prose(4, 60) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(5, 60)),
        (13, long[:5000] + " tail"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The edge rows with further columns, some of them named like results."""
    names = "doc_id long, text string, score string, found string, base string, length string, n string, blob string"
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in edge_rows], names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
