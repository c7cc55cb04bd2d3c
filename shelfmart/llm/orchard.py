"""Product codes of vectors, each part's entry found by Orchard's search.

Vectors become whole numbers and are cut into parts. Each part position has a codebook of at most 256 entries, which
starts from the first vectors and moves to the means of what is assigned to it. For every entry a list of the entries by
distance from it is kept. A search looks along the list of the best entry so far, jumps to the list of a better one as
soon as it finds it, skips entries it has met, and stops where the list goes beyond twice the distance to the best: what
follows is farther from the point than that. All comparisons are of whole numbers, so that ties are ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmart.llm.common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 24  # magnitude of a whole component, so that squared distances stay exact
HOT_LABELS = 1_000


class Orchard:
    """Nearest entries of one codebook, whole numbers of shape (entries, width)."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, axis=1)
        # any first guess is right; the entry nearest in the sum of components is a close one
        self.by_sum = np.argsort(book.sum(axis=1), kind="stable")
        self.sums = book.sum(axis=1)[self.by_sum]

    def _squared(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((points - self.book[entry]) ** 2).sum(axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, the lower of equally near ones, and its squared distance. All points take
        their next step together."""
        n, entries = len(points), len(self.book)
        guess = np.minimum(np.searchsorted(self.sums, points.sum(axis=1)), entries - 1)
        best = self.by_sum[guess]
        distance = self._squared(points, best)
        met = np.zeros((n, entries), dtype=bool)
        met[np.arange(n), best] = True
        place = np.zeros(n, dtype=np.int64)
        going = np.arange(n)
        while len(going):
            going = going[place[going] < entries]
            # an entry as far as twice the distance may still be equally near
            going = going[self.apart[best[going], place[going]] <= 4 * distance[going]]
            other = self.lists[best[going], place[going]]
            place[going] += 1
            new = ~met[going, other]
            at, other = going[new], other[new]
            met[at, other] = True
            found = self._squared(points[at], other)
            better = (found < distance[at]) | ((found == distance[at]) & (other < best[at]))
            at = at[better]
            best[at], distance[at], place[at] = other[better], found[better], 0
        return best, distance


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    """Not null, and all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def _points(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors, of shape (rows, parts, width)."""
    flat = batch.column("q").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, PARTS, -1)


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """For each part, entry and position: the sum of what is assigned there and its count."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(book) for book in books]
        total = np.zeros(books.shape, dtype=np.int64)
        count = np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            points = _points(batch)
            for part, orchard in enumerate(search):
                entry, _ = orchard.nearest(points[:, part])
                np.add.at(total[part], entry, points[:, part])
                count[part] += np.bincount(entry, minlength=books.shape[1])
        part, entry = np.nonzero(count)
        width = books.shape[2]
        columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part))]
        columns += [total[part, entry].reshape(-1), np.repeat(count[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "at", "total", "n"])

    partial = vectors.select("q").mapInArrow(assign, "part long, entry long, at long, total long, n long")
    exact = F.col("total").cast("decimal(38,0)")
    return partial.groupBy("part", "entry", "at").agg(F.sum(exact).alias("total"), F.sum("n").alias("n"))


def fit(vectors: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of shape (parts, entries, width) for `vectors` with columns `vec_id` and `q`. The driver holds the
    first `entries` vectors and one sum per number of a codebook."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    books = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(vectors, books).collect():
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """Add the error summed over equal labels. Labels with a thousandth of all rows are fewer than a thousand and meet
    their rows by a broadcast; only the others are shuffled by label."""
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    often = F.col("_n") * HOT_LABELS > total
    of = F.col("label").alias("_label")
    hot, rest = sums.where(often).select(of, "label_error"), sums.where(~often).select(of, "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    at_hot = coded.join(F.broadcast(hot), same)
    others = coded.join(F.broadcast(hot), same, "left_anti").join(rest, same)
    return at_hot.unionByName(others).drop("_label")


def encode(
    rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """`vec_id, label, code, error, label_error, codebooks_sha256` of every row whose vector is whole.

    Rows whose vector is null or holds null or non-finite components are left out. Codebooks start from the smallest ids,
    null ids last and equal ids by their vectors; with fewer rows than `entries` they are smaller. Repeated rows are coded
    each, null labels are one label. An empty table gives no rows. Vectors of different lengths, of a length that is
    no multiple of the parts, or with components of 65,536 and more have no code here and raise ValueError. Other
    columns are not returned.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    picked = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("_e"))
    kept = picked.where(usable(F.col("_e"))).select("vec_id", "label", whole_numbers(F.col("_e")).alias("q"))
    vectors = written(kept, "vectors")
    size = F.size("q")
    largest = F.aggregate("q", F.lit(0).cast("long"), lambda m, v: F.greatest(m, v, F.bitwise_not(v)))
    found = vectors.agg(F.min(size).alias("low"), F.max(size).alias("high"), F.max(largest).alias("largest")).first()
    kinds = dict(vectors.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    length = found["low"]
    if length is None:
        return rows.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    if length != found["high"] or length == 0 or length % PARTS:
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}; found {length} to {found['high']}")
    if found["largest"] >= MOST:
        raise ValueError(f"components must be below {MOST // SCALE}")
    books = fit(vectors, length // PARTS, entries, rounds)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(book) for book in books]
        for batch in batches:
            points = _points(batch)
            nearest = [orchard.nearest(points[:, part]) for part, orchard in enumerate(search)]
            code = np.array([entry for entry, _ in nearest], dtype=np.uint8).T
            error = np.sum([distance for _, distance in nearest], axis=0)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in code], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = written(vectors.mapInArrow(codes, schema), "codes")
    return _with_label_errors(coded).withColumn("codebooks_sha256", F.lit(digest(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
