"""Exact Jaccard self-join of word 5-gram sets.

Equal sets are one. A group of near copies has many more pairs than are needed to connect it. So each set is first
checked with one other that agrees with it in a few sampled shingles and that many sets agree with; the links found make
components, and only pairs of different components are looked for after that.

Two sets that reach the threshold share one of the first shingles of each in any common order; shingles that a small
sketch of the corpus counts as frequent come last, so few sets meet in them. A shingle whose sets are all of one component
is left out. Few sets that share one are paired by a join, many meet in tiles of near sizes and in blocks of bounded
size. The places of the shared shingle and the bit counts of hashed bitmaps bound the overlap from above. Of the pairs
that may reach the threshold a tile gives as many as connect its sets; the groups that they make are then compared on
their shingles, again in blocks of bounded size and until they are connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfmart.llm.common import small_batches, table, written
from shelfmart.llm.components import components
from shelfmart.llm.substrings import PrefixHashes

N = 5
PERCENT = 80
SKETCH_BITS, SLICE_BITS = 18, 12
FREQUENT = 16  # times the mean of the sketch's counters
KEYS = 8  # sampled shingles of a set
AGREE = 2  # of them that a likely partner shares
FEW = 64  # sets that share a shingle and are paired by a join
TILE_ROWS = 2000
BLOCK_SHINGLES = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
PART = 1 << 19  # bytes of text hashed at once
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
ACTIVE_BITS = 1 << 24  # of the bitmap that thins the texts fetched again


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * MIX
    return x ^ (x >> np.uint64(32))


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of about PART bytes, cut where a word ends."""
    at = 0
    while at < len(data):
        end = at + PART
        while end < len(data) and not BLANK[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_numbers(texts: Iterable[str | None]) -> list[np.ndarray]:
    """64-bit numbers of each text's words, lower-cased in A to Z, from prefix polynomial hashes of the bytes."""
    out: list[list[np.ndarray]] = []
    waiting: list[tuple[int, bytes]] = []
    size = 0

    def hash_waiting() -> None:
        data = np.frombuffer(b" ".join(part for _, part in waiting) + b" ", dtype=np.uint8)
        lengths = np.array([len(part) + 1 for _, part in waiting])
        blank = BLANK[data]
        ends = np.flatnonzero(blank & ~np.r_[True, blank[:-1]])
        starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        numbers = _mixed(PrefixHashes(data).of(starts, ends - starts) + (ends - starts).astype(np.uint64))
        cuts = np.searchsorted(starts, np.cumsum(lengths)[:-1])
        for (text, _), mine in zip(waiting, np.split(numbers, cuts), strict=True):
            out[text].append(mine)
        waiting.clear()

    for k, text in enumerate(texts):
        out.append([])
        for part in _parts(text.encode().lower() if text else b""):
            waiting.append((k, part))
            size += len(part)
            if size >= PART:
                hash_waiting()
                size = 0
    if waiting:
        hash_waiting()
    none = np.empty(0, dtype=np.uint64)
    return [parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else none for parts in out]


def shingle_hashes(words: np.ndarray, n: int = N) -> np.ndarray:
    """64-bit hashes of a text's `n`-word shingles in order; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    acc = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        acc = acc * MIX + words[k : k + count]
    return _mixed(acc)


def shingle_set(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(words, n))


def bitmap_bits(size: int) -> int:
    """Width of a set's bitmap: two to four bits a shingle, a power of two."""
    return max(64, 1 << (2 * size - 1).bit_length())


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bits(len(shingles)), dtype=np.uint8)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(data: bytes, size: int) -> int:
    """A bitmap as a number, folded to `size` bytes; a shingle's bit in the narrow map is its place in the wide one
    modulo the width."""
    x, width = int.from_bytes(data, "little"), len(data)
    while width > size:
        width //= 2
        x = (x >> (8 * width)) | (x & ((1 << (8 * width)) - 1))
    return x


def most_overlap(a: int, b: int, n_a: int, n_b: int) -> int:
    """A bound of the sets' overlap from their bitmaps: each bit of one that the other lacks is a shingle it lacks."""
    return min(n_a - (a & ~b).bit_count(), n_b - (b & ~a).bit_count())


def sketch(docs: DataFrame, text: str) -> np.ndarray:
    """How many shingles of all documents fall on each of 2^18 counters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for words in word_numbers(batch["t"]):
                np.add.at(total, _counter(shingle_hashes(words)), 1)
        parts = total.reshape(-1, 1 << SLICE_BITS)
        yield pd.DataFrame({"slice": range(len(parts)), "counts": [p.tobytes() for p in parts]})

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in parts["counts"])
        return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})

    schema = "slice int, counts binary"
    per_task = docs.select(F.col(text).alias("t")).mapInPandas(count, schema)
    slices = per_task.groupBy("slice").applyInPandas(add, schema).collect()  # 2 MB in all, whatever the corpus
    out = np.zeros((1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS), dtype=np.int64)
    for row in slices:
        out[row["slice"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return out.ravel()


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def numbered(docs: DataFrame, text: str) -> DataFrame:
    """`docs` without its text, with each row's number, the size of its set and the set's digest."""

    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(w) for w in word_numbers(texts)]
            yield pd.DataFrame({"_n": [len(s) for s in sets], "_digest": [_digest(s) for s in sets]})

    kept = [c for c in docs.columns if c != text]
    found = F.pandas_udf(describe, "struct<_n:long,_digest:binary>")
    return docs.select(*kept, found(F.col(text)).alias("_set")).select(
        *kept, F.monotonically_increasing_id().alias("_row"), "_set.*"
    )


def sampled(shingles: np.ndarray) -> np.ndarray:
    """The first shingle of a sorted set from each of KEYS places of the range of hashes on, starting over at its end:
    similar sets agree in most of them."""
    places = np.arange(KEYS, dtype=np.uint64) * np.uint64((1 << 64) // KEYS)
    return np.unique(shingles[np.searchsorted(shingles, places) % len(shingles)])


def distinct_sets(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """(no, digest, id of a document, n, keys, rare, frequent, bits): each set once, empty ones left out. `rare` and
    `frequent` are the shingles it is met by."""
    counts = sketch(docs, text)
    frequent = np.where(counts > FREQUENT * max(1.0, counts.mean()), np.log2(np.maximum(counts, 1)), 0).astype(np.uint8)
    order = docs.sparkSession.sparkContext.broadcast(frequent)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, words in zip(batch["k"], word_numbers(batch["t"]), strict=True):
                s = shingle_set(words)
                if len(s):
                    # any order that is the same for all sets will do
                    rank = order.value[_counter(s)]
                    first = np.lexsort((s, rank))[: len(s) - -(-percent * len(s) // 100) + 1]
                    met, often = s[first].view(np.int64), rank[first] > 0
                    keys = sampled(s).view(np.int64)
                    out.append((_digest(s), key, len(s), keys, met[~often], met[often], bitmap(s)))
            yield pd.DataFrame(out, columns=["digest", "id", "n", "keys", "rare", "frequent", "bits"])

    kind = dict(docs.dtypes)[doc_id]
    schema = "digest binary, id string, n long, keys array<long>, rare array<long>, frequent array<long>, bits binary"
    rows = docs.select(F.col(doc_id).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(describe, schema)
    once = rows.dropDuplicates(["digest"]).withColumn("no", F.monotonically_increasing_id())
    return once.withColumn("id", F.col("id").cast(kind))


def partners(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are likely near copies, at most one for each set: of the sets that share a sampled shingle, each
    meets only the one that shares its samples with most sets, and keeps the one it agrees with most itself."""
    keyed = sets.select("no", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keyed.join(sizes, "key")
    weighed = met.join(met.groupBy("no").agg(F.sum("size").alias("weight")), "no")
    middle = weighed.groupBy("key").agg(F.max(F.struct("weight", "no")).alias("best"))
    met = met.join(middle.select("key", F.col("best.no").alias("other")), "key").where("no <> other")
    agree = met.groupBy("no", "other").agg(F.count("*").alias("agree")).where(F.col("agree") >= AGREE)
    best = agree.groupBy("no").agg(F.max(F.struct("agree", "other")).alias("best"))
    return best.select(F.least("no", "best.other").alias("a"), F.greatest("no", "best.other").alias("b")).distinct()


def meetings(sets: DataFrame) -> DataFrame:
    """Rows (h, no, n, root, place, rows): the sets that share shingle `h` with one of another component; `place` is the
    shingle's in the set's order, `rows` says how many sets have it.

    Groups of rare shingles are small and are counted where they meet; those of frequent ones are counted before, so that
    no task holds a whole one.
    """

    def postings(column: str, before: Column) -> DataFrame:
        rows = sets.select(F.posexplode(column).alias("_at", "h"), before.alias("_from"), "no", "n", "root")
        return rows.select("h", "no", "n", "root", (F.col("_at") + F.col("_from")).alias("place"))

    rare, often = postings("rare", F.lit(0)), postings("frequent", F.size("rare"))
    here, columns = Window.partitionBy("h"), ["h", "no", "n", "root", "place", "rows"]
    figures = {"rows": F.count("*"), "_least": F.min("root"), "_greatest": F.max("root")}
    rare = rare.withColumns({name: found.over(here) for name, found in figures.items()})
    groups = often.groupBy("h").agg(*[found.alias(name) for name, found in figures.items()])
    mixed = F.col("_least") < F.col("_greatest")
    return rare.where(mixed).select(*columns).unionByName(often.join(groups.where(mixed), "h").select(*columns))


def few_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle with at most FEW sets. The places of the shingle bound
    the overlap, if it is the first that the sets share; where it is not, the pair is met there."""
    few = met.where(F.col("rows") <= FEW).drop("rows")
    x, y = few.alias("x"), few.alias("y")
    overlap = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    near = (100 + percent) * overlap >= percent * (F.col("x.n") + F.col("y.n"))
    other = (F.col("x.no") < F.col("y.no")) & (F.col("x.root") != F.col("y.root"))
    joined = x.join(y, (F.col("x.h") == F.col("y.h")) & other & near)
    return joined.select(F.col("x.no").alias("a"), F.col("y.no").alias("b")).distinct()


def tiles(met: DataFrame, percent: int) -> DataFrame:
    """Rows (h, band, i, j, own, x, y, no, place, n, root): the sets that share shingle `h` with more than FEW, in tiles of
    sizes near each other.

    A tile of band b holds the sets of b (own) and of b + 1. Groups above TILE_ROWS are cut into blocks of that size;
    tile (i, j) holds two blocks, x and y saying which of them a row is of.
    """
    own_band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100)) + 1e-9).cast("int")
    blocks = F.ceil(F.col("rows") / TILE_ROWS).cast("int")
    return (
        met.where(F.col("rows") > FEW)
        .withColumn("_band", own_band)
        .withColumn("band", F.explode(F.array(F.col("_band"), F.col("_band") - 1)))
        .withColumn("_block", F.pmod(F.xxhash64("no"), blocks).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "h",
            "band",
            F.least("_block", "_other").alias("i"),
            F.greatest("_block", "_other").alias("j"),
            (F.col("band") == F.col("_band")).alias("own"),
            (F.col("_block") <= F.col("_other")).alias("x"),
            (F.col("_block") >= F.col("_other")).alias("y"),
            "no",
            "place",
            "n",
            "root",
        )
    )


TILE = ["h", "band", "i", "j"]
COLUMNS = {
    "own": bool, "x": bool, "y": bool, "no": np.int64, "place": np.int64, "n": np.int64, "root": np.int64, "bits": object,
}
SMALL_TILE = 16
SEEN_PAIRS = 300_000  # that a task remembers, to send a pair once


class Connected:
    """Items with the number of their component, and the pairs that have connected them."""

    def __init__(self, numbers: np.ndarray, names: np.ndarray):
        self.of, self.names, self.pairs = numbers.copy(), names, []

    def connect(self, k: int, others: np.ndarray) -> None:
        """Connect `k` with each of `others`, by a pair for every component that is new to it."""
        found, first = np.unique(self.of[others], return_index=True)
        for number, p in zip(found.tolist(), others[first].tolist(), strict=True):
            if number != self.of[k]:
                self.of[self.of == number] = self.of[k]
                a, b = int(self.names[k]), int(self.names[p])
                self.pairs.append((min(a, b), max(a, b)))


def _by_tile(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of every tile that may reach the threshold, of sets with different roots: as many as connect the sets
    that have such a pair. Tiles are read in order, so that a task holds one batch and one tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = {c: np.empty(0, dtype=kind) for c, kind in COLUMNS.items()}
        rest_keys = np.empty((0, len(TILE)), dtype=np.int64)
        seen: set[tuple[int, int]] = set()

        def pairs(end: int, cuts: np.ndarray) -> pd.DataFrame:
            found = {p for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1 and b <= end
                     for p in _tile_pairs({c: v[a:b] for c, v in rest.items()}, percent)} - seen
            if len(seen) + len(found) > SEEN_PAIRS:
                seen.clear()
            seen.update(found)
            return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

        for batch in batches:
            rest = {c: np.concatenate([rest[c], batch[c].to_numpy(kind)]) for c, kind in COLUMNS.items()}
            rest_keys = np.concatenate([rest_keys, batch[TILE].to_numpy(np.int64)])
            cuts = np.r_[0, np.flatnonzero((rest_keys[1:] != rest_keys[:-1]).any(axis=1)) + 1, len(rest_keys)]
            yield pairs(cuts[-2], cuts)
            rest = {c: v[cuts[-2] :] for c, v in rest.items()}
            rest_keys = rest_keys[cuts[-2] :]
        yield pairs(len(rest_keys), np.array([0, len(rest_keys)]))

    dealt = rows.repartition(*TILE).sortWithinPartitions(*TILE, "no")
    return dealt.select(*TILE, *COLUMNS).mapInPandas(run, "a long, b long").distinct()


def _tile_pairs(tile: dict[str, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A pair has a set of the tile's own band and, in a tile of two blocks, one of each. The places of the tile's
    shingle bound the overlap too, if it is the first that the sets share; where it is not, the pair is met there."""
    if not tile["own"].any():
        return []
    size = min(map(len, tile["bits"]))
    maps = [folded(b, size) for b in tile["bits"]]
    if len(maps) <= SMALL_TILE:
        return _small_tile_pairs(tile, maps, percent)
    own, x, y, no, n, roots = (tile[c] for c in ("own", "x", "y", "no", "n", "root"))
    left = n - tile["place"]
    words = np.array([np.frombuffer(m.to_bytes(size, "little"), dtype="<u8") for m in maps])
    found = Connected(np.arange(len(maps)), no)
    for k in range(1, len(maps)):
        near = (own[:k] | own[k]) & ((x[:k] & y[k]) | (y[:k] & x[k])) & (no[:k] != no[k]) & (roots[:k] != roots[k])
        least = np.minimum(left[:k], left[k])
        near &= 100 * least >= percent * (n[:k] + n[k] - least)
        places = np.flatnonzero(near)
        if not len(places):
            continue
        mine, theirs = words[k], words[places]
        lack = n[k] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(lack, n[places] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
        found.connect(k, places[100 * overlap >= percent * (n[k] + n[places] - overlap)])
    return found.pairs


def _small_tile_pairs(tile: dict[str, np.ndarray], maps: list[int], percent: int) -> list[tuple[int, int]]:
    own, x, y, no, n, roots = (tile[c].tolist() for c in ("own", "x", "y", "no", "n", "root"))
    left = (tile["n"] - tile["place"]).tolist()
    out: list[tuple[int, int]] = []
    for k in range(1, len(no)):
        for p in range(k):
            if (own[p] or own[k]) and ((x[p] and y[k]) or (y[p] and x[k])) and no[p] != no[k] and roots[p] != roots[k]:
                overlap = min(left[k], left[p])
                if 100 * overlap >= percent * (n[k] + n[p] - overlap):
                    overlap = most_overlap(maps[k], maps[p], n[k], n[p])
                    if 100 * overlap >= percent * (n[k] + n[p] - overlap):
                        out.append((min(no[k], no[p]), max(no[k], no[p])))
    return out


def possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by their bitmaps."""

    def check(n_a: pd.Series, n_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for n, m, x, y in zip(n_a.tolist(), n_b.tolist(), a, b, strict=True):
            size = min(len(x), len(y))
            overlap = most_overlap(folded(x, size), folded(y, size), n, m)
            out.append(100 * overlap >= percent * (n + m - overlap))
        return pd.Series(out, dtype=bool)

    left, right = (maps.select(F.col("no").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.pandas_udf(check, "boolean")("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")


def linked(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold, by the exact intersection of their sorted shingles."""

    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            s, t = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * both >= percent * (len(s) + len(t) - both))
        return pd.Series(out, dtype=bool)

    left = shingles.select(F.col("no").alias("a"), F.col("shingles").alias("s"))
    right = shingles.select(F.col("no").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.pandas_udf(check, "boolean")("s", "t")).select("a", "b")


def connecting(edges: DataFrame, sets: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect whatever links do, among the sets that are in one component of `edges`; `sets` (no, n,
    root) tells which are connected already.

    The sets of a component meet with their shingles; large components in blocks of about BLOCK_SHINGLES, tile (i, j)
    holding two of them. A tile gives as many links as connect its sets.
    """
    groups = components(edges).select(F.col("node").alias("no"), F.col("root").alias("g"))
    placed = written(groups.join(sets, "no"), "groups")
    sizes = placed.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    rows = (
        placed.join(sizes, "g")
        .withColumn("_block", F.pmod(F.xxhash64("no"), "blocks").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "g",
            F.least("_block", "_other").alias("i"),
            F.greatest("_block", "_other").alias("j"),
            (F.col("_block") <= F.col("_other")).alias("x"),
            (F.col("_block") >= F.col("_other")).alias("y"),
            "no",
            "root",
        )
        .join(shingles, "no")
    )

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("no")
        sets = [np.frombuffer(data, dtype=np.uint64) for data in tile["shingles"]]
        x, y = tile["x"].to_numpy(bool), tile["y"].to_numpy(bool)
        n = np.array(list(map(len, sets)))
        begin = np.cumsum(n) - n
        distinct, which = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(distinct), dtype=np.int64)
        found = Connected(tile["root"].to_numpy(np.int64), tile["no"].to_numpy(np.int64))
        for k in range(1, len(sets)):
            open_ = (found.of[:k] != found.of[k]) & ((x[:k] & y[k]) | (y[:k] & x[k]))
            if open_.any():
                own = which[begin[k] : begin[k] + n[k]]
                mine[own] = 1
                both = np.add.reduceat(mine[which[: begin[k]]], begin[:k])
                mine[own] = 0
                found.connect(k, np.flatnonzero(open_ & (100 * both >= percent * (n[:k] + n[k] - both))))
        return pd.DataFrame(found.pairs, columns=["a", "b"], dtype="int64")

    return rows.groupBy("g", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the carried columns, n_shingles, component_id (the smallest id reachable by links, its own included) and
    keep (true for one row of each component: that of the smallest id).

    Null, empty and blank texts have no shingles, are linked with nothing and are kept. Repeated rows are one component.
    Rows without an id take part; their component's id is null where no row of it has one. Columns that are
    not carried are not returned. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), *carry)
    rows = written(numbered(plain, "_t"), "sets")
    sets = written(distinct_sets(plain, "_id", "_t", percent), "distinct-sets")
    maps = sets.select("no", "n", "bits")

    def shingles_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
        return written(_candidate_shingles(plain, sets, ends), "shingles")

    likely = written(possible(partners(sets), maps, percent), "pairs")
    links = written(linked(likely, shingles_of(likely), percent), "links")
    roots = components(links).withColumnRenamed("node", "no")
    rooted = written(sets.select("no", "n").join(roots, "no", "left").withColumn("root", F.coalesce("root", "no")), "roots")
    met = written(meetings(sets.select("no", "rare", "frequent").join(rooted, "no")), "meetings")
    few = possible(few_pairs(met, percent), maps, percent)
    small_batches(spark, 10_000)  # rows are short here
    many = written(_by_tile(tiles(met, percent).join(maps.select("no", "bits"), "no"), percent), "pairs")
    small_batches(spark)
    more = written(few.union(many).distinct(), "pairs")
    more_links = written(connecting(more, rooted, shingles_of(more), percent), "links")

    roots = components(links.union(more_links))
    rooted = sets.select("digest", "no").join(roots.withColumnRenamed("node", "no"), "no", "left")
    of_set = rooted.select(F.col("digest").alias("_digest"), F.coalesce("root", "no").alias("_root"))
    placed = written(
        rows.select("_id", *carry, "_row", "_n", "_digest")
        .join(of_set, "_digest", "left")
        # rows without shingles are components of their own
        .withColumn("_root", F.when(F.col("_n") > 0, F.col("_root")).otherwise(-1 - F.col("_row")))
        .drop("_digest"),
        "placed",
    )
    best = placed.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("_best"))
    return placed.join(best, "_root").select(
        F.col("_id").alias(doc_id),
        *carry,
        F.col("_n").alias("n_shingles"),
        F.col("_best._id").alias("component_id"),
        (F.col("_best._row") == F.col("_row")).alias("keep"),
    )


def _likely(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of hashed ids that every id of `ids` passes: a bitmap of fixed size, so that most texts that are not
    wanted need not be shuffled to be dropped."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(ACTIVE_BITS, dtype=bool)
        for batch in batches:
            bits[batch["h"].to_numpy(np.int64) % ACTIVE_BITS] = True  # of a null id too; it is never asked for
        parts = np.packbits(bits).reshape(64, -1)
        yield pd.DataFrame({"slice": range(64), "bits": [p.tobytes() for p in parts]})

    def unite(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in parts["bits"]])
        return pd.DataFrame({"slice": [key[0]], "bits": [bits.tobytes()]})

    marked = ids.select(F.xxhash64("id").alias("h")).coalesce(8).mapInPandas(mark, "slice int, bits binary")
    rows = sorted(marked.groupBy("slice").applyInPandas(unite, "slice int, bits binary").collect())
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), dtype=np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(packed if len(packed) else np.zeros(ACTIVE_BITS // 8, np.uint8))

    def test(hashes: pd.Series) -> pd.Series:
        place = hashes.to_numpy(np.int64) % ACTIVE_BITS
        return pd.Series((shared.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1)

    return F.pandas_udf(test, "boolean")


def _candidate_shingles(docs: DataFrame, sets: DataFrame, active: DataFrame) -> DataFrame:
    """(no, shingles) of the active sets, made again from their texts."""
    wanted = sets.join(active, "no", "left_semi").select("no", "id", "digest")
    # ids are enough to fetch texts; the digest then picks the right one where an id has several
    ids = wanted.select("id").distinct().hint("shuffle_hash")
    source = docs.select(F.col("_id").alias("id"), F.col("_t").alias("t"))
    likely = _likely(wanted.select("id"))
    named = source.where(F.col("id").isNotNull()).where(likely(F.xxhash64("id")))
    named = named.join(ids.where(F.col("id").isNotNull()), "id", "left_semi")
    nameless = source.where(F.col("id").isNull())

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [shingle_set(w) for w in word_numbers(batch["t"])]
            yield pd.DataFrame({"digest": [_digest(s) for s in made], "shingles": [s.tobytes() for s in made]})

    texts = named.select("t").unionByName(nameless.select("t"))
    made = texts.mapInPandas(make, "digest binary, shingles binary")
    return made.join(wanted.select("digest", "no"), "digest").select("no", "shingles").dropDuplicates(["no"])


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")
