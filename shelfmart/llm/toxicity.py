"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else, labelled or not, is unlabelled text that holds toxic
documents at the class prior. A linear model on the words of a document is trained in numpy with the non-negative risk
estimator: where the estimated risk on negatives falls below zero, the step takes that risk back up instead.

The model is trained on a bounded sample drawn by hash; scoring reads every document and shuffles nothing.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmart.llm.common import small_batches, table

POSITIVES, UNLABELLED = 2000, 6000  # rows of the training sample at most
THRESHOLD = 0.3
STEM = 4  # bytes of a word's beginning
LEAST_DOCUMENTS = 5  # of the sample that a word must be in to have a weight
LEAST_EVIDENCE = 4.0  # standard deviations between a word's shares in positives and in unlabelled text
TOKEN = re.compile(rb"[a-z\x80-\xff]+|[0-9]+")


def features_of(text: str | None) -> set[bytes]:
    """Lower-cased words (ASCII letters; other characters as they are), digit runs, and the words' beginnings, which
    stand for words that training has not seen."""
    if not text:
        return set()
    words = set(TOKEN.findall(text.encode().lower()))
    return words | {b"^" + w[:STEM] for w in words if len(w) > STEM}


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: str | None) -> float:
        """0 to 1. A feature counts once; texts without known features get the bias alone."""
        known = features_of(text) & self.weights.keys()
        return _sigmoid(self.bias + sum(map(self.weights.__getitem__, sorted(known))))


class Documents:
    """The words of documents as numbers, so that the driver holds each different word once."""

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers = numbers
        self.words = array("l")
        self.sizes: list[int] = []

    def add(self, words: Iterable[bytes]) -> None:
        before = len(self.words)
        self.words.extend(self.numbers.setdefault(w, len(self.numbers)) for w in words)
        self.sizes.append(len(self.words) - before)

    def __len__(self) -> int:
        return len(self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and word of each occurrence."""
        return np.repeat(np.arange(len(self)), self.sizes), np.array(self.words, dtype=np.int64)


def _telling_words(positive: Documents, unlabelled: Documents) -> list[bytes]:
    """Words whose share of documents differs between the two samples by more than chance explains."""
    numbers = positive.numbers
    in_p, in_u = (np.bincount(d.pairs()[1], minlength=len(numbers)).tolist() for d in (positive, unlabelled))
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    out = []
    for word, k in numbers.items():
        p, u = in_p[k], in_u[k]
        if p and p + u >= LEAST_DOCUMENTS:
            share = (p + u) / (n_p + n_u)
            deviation = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
            if deviation and abs(p / n_p - u / n_u) >= LEAST_EVIDENCE * deviation:
                out.append(word)
    return sorted(out)


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(
    positive: Documents, unlabelled: Documents, prior: float, epochs: int = 200, rate: float = 0.05, l2: float = 5e-4
) -> Model:
    """Full-batch Adam on the non-negative risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
    with the logistic loss."""
    vocabulary = {w: k for k, w in enumerate(_telling_words(positive, unlabelled))}
    if not len(positive) or not len(unlabelled) or not vocabulary:
        return Model({}, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))

    place = np.full(len(positive.numbers), -1)
    place[[positive.numbers[w] for w in vocabulary]] = list(vocabulary.values())

    def matrix(docs: Documents) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = docs.pairs()
        columns = place[columns]
        return rows[columns >= 0], columns[columns >= 0]

    (pr, pc), (ur, uc) = matrix(positive), matrix(unlabelled)
    n_p, n_u, size = len(positive), len(unlabelled), len(vocabulary)
    w, bias = np.zeros(size + 1), float(np.log(prior / (1 - prior)))
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)

    def margins(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, weights=w[columns], minlength=n) + w[-1]

    def gradient(rows: np.ndarray, columns: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        g = np.bincount(columns, weights=slopes[rows], minlength=size + 1)
        g[-1] = slopes.sum()
        return g

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, epochs + 1):
        zp, zu = margins(pr, pc, n_p), margins(ur, uc, n_u)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        positive_g = gradient(pr, pc, -prior * sigmoid(-zp) / n_p)
        negative_g = gradient(ur, uc, sigmoid(zu) / n_u) - gradient(pr, pc, prior * sigmoid(zp) / n_p)
        g = positive_g + negative_g if negative_risk >= 0 else -negative_g
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = {word: float(w[k]) for word, k in vocabulary.items() if abs(w[k]) > 1e-3}
    return Model(weights, float(w[-1]))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train on documents that are not held out. Of the labels only 1 counts: the positives are drawn from documents
    labelled so, the unlabelled text from all documents, toxic ones among them. The class prior is the share of 1 among
    the labels that may be learned from. Rows without an id or a label are not drawn."""
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~is_held_out(F.col("doc_id")))
    toxic = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, ones = toxic.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max(ones / n if n else 0.0, 0.01), 0.99)

    def sample(ids: DataFrame, kind: int, rows: int) -> DataFrame:
        # ordered by hash: the same rows whatever the partitions are, and no more than `rows` of them
        return ids.select("doc_id", F.lit(kind).alias("kind")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    everything = docs.select(F.col(doc_id).alias("doc_id")).where(F.col(doc_id).isNotNull() & ~is_held_out(F.col(doc_id)))
    # At most POSITIVES + UNLABELLED ids, so the broadcast is bounded.
    chosen = sample(toxic.where("toxic = 1"), 1, POSITIVES).unionByName(sample(everything, 0, UNLABELLED)).distinct()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [sorted(features_of(t)) for t in batch["t"]]
            yield pd.DataFrame({"k": batch["k"], "kind": batch["kind"], "words": [b" ".join(w) for w in words]})

    small_batches(spark)
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
        .join(F.broadcast(chosen), "doc_id")
        .select(F.xxhash64("doc_id", "t").alias("k"), "kind", "t")
        .mapInPandas(features, "k long, kind int, words binary")
        .orderBy("k")
        .limit(2 * (POSITIVES + UNLABELLED))
    )
    numbers: dict[bytes, int] = {}
    samples = {1: Documents(numbers), 0: Documents(numbers)}
    for r in rows.toLocalIterator():
        samples[r["kind"]].add(bytes(r["words"]).split())
    return train(samples[1], samples[0], prior)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `score` and `predicted`. Null and empty texts get the score of no words. Repeated rows stay. Columns
    named like the results are replaced. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype=float)

    small_batches(docs.sparkSession)
    out = docs.drop("score", "predicted").withColumn("score", F.pandas_udf(score, "double")(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
