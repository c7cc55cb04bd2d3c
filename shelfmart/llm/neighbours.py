"""Approximate nearest neighbours by inner product with balanced posting lists.

Centroids come from balanced halvings of a bounded sample. Every vector is posted to its nearest centroid and, near a
boundary, to further ones. A query finds the near centroids through a graph of them held in memory, and reads the lists
whose distance is within a ratio of the nearest one's. The ratio is set from true neighbours of a few sampled queries,
so it is tight on clustered data and wide where distances tell little. Lists and their queries meet in blocks of bounded
size. Vectors are lengthened by one component, so that the largest inner product is the smallest distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfmart.llm.common import small_batches, table, written

K = 20
SAMPLE = 20_000  # vectors that the index is fitted on
LIST_ROWS = 1_000  # vectors a list is meant to hold
MOST_LISTS = 16_384  # centroids; with more vectors lists get longer and are read in blocks
BOUNDARY, COPIES = 1.10, 4  # a vector is posted to centroids within this ratio of its nearest, so many at most
DEGREE = 16  # of the centroid graph
PROBE_SAMPLE, PROBE_RECALL = 200, 0.97
BLOCK = 2_000  # vectors, or queries, of one task's block
ROUNDING = 1e-10  # of a score by matrix product, relative to the norms; exact scores decide within it


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    norm: float  # the largest norm
    ratio: float = 1.0

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists each vector is posted to, nearest first."""
        d = _distances(self.lengthened(x), self.centroids)
        order = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
        near = np.take_along_axis(d, order, axis=1)
        keep = near <= BOUNDARY * near[:, :1] + 1e-12
        return [o[k] for o, k in zip(order, keep, strict=True)]

    def probe(self, q: np.ndarray) -> list[int]:
        """Lists within the ratio of the nearest, found by best-first search of the graph from its first centroid."""
        q = np.append(q, 0.0)
        seen = np.zeros(len(self.centroids), dtype=bool)
        distance = lambda k: np.sqrt(((self.centroids[k] - q) ** 2).sum(axis=1))
        start = np.array([0])
        seen[0] = True
        heap = [(float(distance(start)[0]), 0)]
        best, found = heap[0][0], []
        while heap:
            d, k = heapq.heappop(heap)
            if d > self.ratio * best and len(found) >= DEGREE:
                break
            found.append((d, k))
            best = min(best, d)
            new = self.graph[k][~seen[self.graph[k]]]
            seen[new] = True
            for other, where in zip(distance(new).tolist(), new.tolist(), strict=True):
                heapq.heappush(heap, (other, where))
        return [k for d, k in found if d <= self.ratio * best + 1e-12]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Means of equal parts of a sample: parts are halved at the median along the line between two means."""
    rng = np.random.default_rng(seed)
    parts = [(-len(x), 0, np.arange(len(x)))]
    n = 1
    while len(parts) < lists and -parts[0][0] >= 2:
        _, _, rows = heapq.heappop(parts)
        mine = x[rows]
        a, b = mine[rng.choice(len(mine), 2, replace=False)]
        for _ in range(4):
            side = mine @ (a - b) > (a + b) @ (a - b) / 2
            if side.all() or not side.any():
                break
            a, b = mine[side].mean(axis=0), mine[~side].mean(axis=0)
        order = np.argsort(mine @ (a - b), kind="stable")
        for half in np.array_split(order, 2):
            heapq.heappush(parts, (-len(half), n, rows[half]))
            n += 1
    return np.array([x[rows].mean(axis=0) for _, _, rows in parts])


def centroid_graph(c: np.ndarray) -> np.ndarray:
    """Each centroid's nearest others, and the next one in order, which keeps the graph in one piece."""
    degree = min(DEGREE, len(c) - 1)
    out = []
    for at in range(0, len(c), 512):
        d = _distances(c[at : at + 512], c)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out.append(np.argsort(d, axis=1)[:, :degree])
    around = (np.arange(len(c)) + 1) % len(c)
    return np.column_stack([np.concatenate(out), around])


def usable(embedding: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, dtype=np.float64) for r in rows], dtype=np.float64)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-scores, k - 1)[:k] if len(scores) > k else np.arange(len(scores))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors score equally in every block."""
    return np.add.reduce(x * q, axis=1)


def _nearest(q: np.ndarray, x: np.ndarray, scores: np.ndarray, least: np.ndarray, uids: np.ndarray, keep: int):
    """Places and exact scores of the `keep` best vectors, equal scores by their least id. `scores` may be rounded, so
    all within rounding of the last one wanted are scored exactly before the cut."""
    top = np.arange(len(scores))
    if len(scores) > keep:
        last = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        room = ROUNDING * np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1).max())
        top = np.flatnonzero(scores >= last - room)
    exact = _exact(q, x[top])
    best = np.lexsort((uids[top], least[top], -exact))[:keep]
    return top[best], exact[best]


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(uid, x, ids): equal vectors once, with their k + 1 smallest ids; more can never be among k neighbours. The
    copies are thinned within hashed parts first, so no task sees all copies of a vector."""
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    part = Window.partitionBy("x", "_salt").orderBy("id")
    whole = Window.partitionBy("x").orderBy("id")
    thin = vectors.distinct().withColumn("_salt", salt).withColumn("_n", F.row_number().over(part)).where(f"_n <= {k + 1}")
    kept = thin.withColumn("_n", F.row_number().over(whole)).where(f"_n <= {k + 1}")
    grouped = kept.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.withColumn("uid", F.monotonically_increasing_id())


def fit(vectors: DataFrame, rows: int, k: int) -> Index:
    """An index of (uid, x, ids) rows, from samples of bounded size drawn by hash."""
    norm = vectors.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0] ** 0.5
    drawn = vectors.orderBy(F.xxhash64("x"), "uid").limit(SAMPLE).select("x").collect()
    sample = _matrix(r["x"] for r in drawn)
    index = Index(np.empty((0, 0)), np.empty((0, 0)), norm)
    lists = int(np.clip(rows // LIST_ROWS, 1, min(MOST_LISTS, len(sample))))
    index.centroids = balanced_centroids(index.lengthened(sample), lists)
    index.graph = centroid_graph(index.centroids)
    index.ratio = _probe_ratio(vectors, index, sample[:PROBE_SAMPLE], k)
    return index


def _probe_ratio(vectors: DataFrame, index: Index, queries: np.ndarray, k: int) -> float:
    """The ratio at which the sampled queries find PROBE_RECALL of their true neighbours."""
    shared = vectors.sparkSession.sparkContext.broadcast((index, queries))

    def true_neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, queries = shared.value
        kept = [(np.empty(0), np.empty(0)) for _ in queries]
        to_centroids = _distances(np.column_stack([queries, np.zeros(len(queries))]), index.centroids)
        ratios = to_centroids / np.maximum(to_centroids.min(axis=1, keepdims=True), 1e-12)
        for batch in batches:
            x = _matrix(batch["x"])
            posted = index.lists_of(x)
            scores = queries @ x.T
            for q in range(len(queries)):
                top = _best(scores[q], k + 1)
                s = np.r_[kept[q][0], scores[q][top]]
                r = np.r_[kept[q][1], [ratios[q][posted[t]].min() for t in top]]
                top = _best(s, k + 1)
                kept[q] = (s[top], r[top])
        out = [(q, s, r) for q, (ss, rr) in enumerate(kept) for s, r in zip(ss.tolist(), rr.tolist(), strict=True)]
        yield pd.DataFrame(out, columns=["q", "s", "r"])

    found = vectors.select("x").mapInPandas(true_neighbours, "q int, s double, r double")
    best = Window.partitionBy("q").orderBy(F.desc("s"))
    top = found.withColumn("_n", F.row_number().over(best)).where(f"_n <= {k + 1}")
    return float(top.agg(F.percentile("r", PROBE_RECALL)).first()[0])


def search(
    vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest vectors found for every query row, nearest first, ties
    to the smaller id; a query's own id is no candidate.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Repeated
    rows count once. Other columns are not returned. With no usable vectors the result is empty; with fewer than k
    candidates a query has as many rows. A query id with several vectors is as near to another as its nearest one.
    Vectors of different lengths have no product and raise ValueError.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2_000)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull())
    rows = rows.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(embedding).cast("array<double>").alias("x"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    length = rows.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if length["low"] is None:
        return spark.createDataFrame([], schema)
    if length["low"] != length["high"]:
        raise ValueError(f"vectors must have one length; found {length['low']} to {length['high']}")
    asked = rows.where("is_query").select("id", "x").distinct()
    # an id with several vectors is no candidate of its own by any of them
    own = asked.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    keep = k + (own or 1)
    distinct = written(distinct_vectors(rows.select("id", "x"), keep), "vectors")
    index = fit(distinct, distinct.count(), k)
    shared = spark.sparkContext.broadcast(index)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(lists=shared.value.lists_of(_matrix(batch["x"])) if len(batch) else [])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(lists=[shared.value.probe(np.asarray(x)) for x in batch["x"]])

    def dealt(df: DataFrame, key: str) -> tuple[DataFrame, dict[int, int]]:
        """Rows by list and block, and the number of blocks of each list (at most MOST_LISTS)."""
        flat = written(df.withColumn("list", F.explode("lists")).drop("lists"), "lists")
        blocks = {r["list"]: -(-r["n"] // BLOCK) for r in flat.groupBy("list").agg(F.count("*").alias("n")).collect()}
        number = F.element_at(_map(blocks), F.col("list"))
        return flat.withColumn(f"{key}_block", F.pmod(F.xxhash64(key), number).cast("int")), blocks

    def _map(blocks: dict[int, int]) -> Column:
        pairs = ",".join(f"{int(a)}:{int(b)}" for a, b in blocks.items())
        return F.expr(f"cast(str_to_map('{pairs}', ',', ':') as map<int,int>)")

    posted, list_blocks = dealt(distinct.select("uid", F.col("ids")[0].alias("least"), "x").mapInPandas(
        post, "uid long, least long, x array<double>, lists array<int>"
    ), "uid")
    routed, query_blocks = dealt(asked.mapInPandas(route, "id long, x array<double>, lists array<int>"), "id")

    def spread(df: DataFrame, other: str, blocks: dict[int, int]) -> DataFrame:
        """Each row to all blocks of the other side in its list."""
        many = {a: b for a, b in blocks.items() if b > 1}
        number = F.coalesce(F.element_at(_map(many), F.col("list")), F.lit(1)) if many else F.lit(1)
        return df.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), number - 1)))

    tile = ["list", "uid_block", "id_block"]

    def meet(key: tuple, queries: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(mine):
            uids, least, x = mine["uid"].to_numpy(np.int64), mine["least"].to_numpy(np.int64), _matrix(mine["x"])
            q = _matrix(queries["x"])
            scores = q @ x.T
            for n, query in enumerate(queries["id"]):
                top, exact = _nearest(q[n], x, scores[n], least, uids, keep)
                out.append((query, uids[top].tobytes(), least[top].tobytes(), exact.tobytes()))
        return pd.DataFrame(out, columns=["query_id", "uids", "least", "scores"])

    left = spread(routed, "uid", list_blocks).groupBy(*tile)
    right = spread(posted, "id", query_blocks).groupBy(*tile)
    found = left.cogroup(right).applyInPandas(meet, "query_id long, uids binary, least binary, scores binary")
    parts = max(1, -(-asked.count() // 500))

    def merge(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, mine in lists.groupby("query_id"):
            uids = np.concatenate([np.frombuffer(u, dtype=np.int64) for u in mine["uids"]])
            least = np.concatenate([np.frombuffer(u, dtype=np.int64) for u in mine["least"]])
            scores = np.concatenate([np.frombuffer(s, dtype=np.float64) for s in mine["scores"]])
            order = np.argsort(-scores, kind="stable")
            uids, least, scores = uids[order], least[order], scores[order]
            uids, first = np.unique(uids, return_index=True)  # by the nearest of the query's vectors
            best = np.lexsort((uids, least[first], -scores[first]))[:keep]
            out += [(query, u, s) for u, s in zip(uids[best].tolist(), scores[first][best].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "uid", "score"])

    bucket = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    merged = found.groupBy(bucket.alias("_part")).applyInPandas(merge, "query_id long, uid long, score double")
    named = merged.join(distinct.select("uid", "ids"), "uid").select("query_id", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = named.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
