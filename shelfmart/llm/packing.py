"""Pack token sequences by dominance reduction and best fit.

Only lengths decide a packing, and there are at most `capacity` of them. So the corpus is reduced to how many pieces
have each length; the plan is made on these counts and says, for a run of pieces of one length, in which sequences and
where in them they lie. A piece then needs nothing but its rank among the pieces of its length. Neither the counts nor
the plan grow with the documents, ranks are counted in salted groups, and no text is shuffled.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmart.llm.common import small_batches, table, tokenizer_path, written
from shelfmart.llm.tokens import encoder

CAPACITY = 4096
END_ID = 1
ROWS_PER_SALT = 50_000
LEAST_SALTS = 64
PLAN_COLUMNS = ["length", "rank", "sequence", "per_sequence", "offset"]


class Plan:
    """Runs of equal pieces. Piece `rank + i` of its length lies in sequence `sequence + i // per_sequence` at
    `offset + (i % per_sequence) * length`."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.next_rank = np.zeros(capacity + 1, dtype=np.int64)
        self.sequences = 0
        self.fixed_sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self._reduce()
        self.fixed_sequences = self.sequences
        self._best_fit()

    def _place(self, length: int, n: int, sequence: int, per_sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.next_rank[length]), sequence, per_sequence, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def _fix(self, lengths: list[int]) -> None:
        """Make sequences of these lengths while there are pieces for them."""
        need: dict[int, int] = defaultdict(int)
        for length in lengths:
            need[length] += 1
        times = min(int(self.left[length]) // n for length, n in need.items())
        offset = 0
        for length, n in need.items():
            self._place(length, times * n, self.sequences, n, offset)
            offset += n * length
        self.sequences += times

    def _largest(self, most: int, taken: list[int]) -> int:
        """The largest length up to `most` of which a piece is left besides those taken, or 0."""
        for length in np.flatnonzero(self.left[: max(0, most) + 1])[::-1]:
            if self.left[length] > taken.count(length):
                return int(length)
        return 0

    def _smallest(self, n: int, taken: list[int]) -> list[int]:
        found: list[int] = []
        for length in np.flatnonzero(self.left):
            free = int(self.left[length]) - taken.count(length)
            found += [int(length)] * min(free, n - len(found))
            if len(found) >= n:
                break
        return found

    def _dominating(self, largest: int) -> list[int] | None:
        """A set with `largest` that dominates every feasible set with it: each such set can be split into parts, each
        no longer than an own member of the returned one. None if no rule proves one."""
        free = self.capacity - largest
        small = self._smallest(3, [largest])
        if not small or small[0] > free:
            return [largest]
        partner = self._largest(free, [largest])
        # The partner fills the sequence, or no two pieces fit beside the largest: the rest is never longer than it.
        if partner == free or len(small) < 2 or small[0] + small[1] > free:
            return [largest, partner]
        if len(small) == 3 and sum(small) <= free:
            return None
        # At most two pieces fit beside the largest.
        best, widest_second = (0, 0, 0), 0
        for second in np.flatnonzero(self.left[: free // 2 + 1]):
            second = int(second)
            if self.left[second] <= [largest].count(second):
                continue
            first = self._largest(free - second, [largest, second])
            if first >= second:
                best = max(best, (first + second, first, second))
                widest_second = second
        if partner >= best[0]:
            return [largest, partner]
        if best[1] == partner and best[2] >= widest_second:
            return [largest, best[1], best[2]]
        return None

    def _reduce(self) -> None:
        """Martello and Toth's reduction, from the longest piece down: sets that dominate are made for good."""
        for length in range(self.capacity, 0, -1):
            while self.left[length] and (members := self._dominating(length)):
                self._fix(members)

    def _best_fit(self) -> None:
        """What is left, longest first, each piece into the fullest sequence it fits in. Sequences with the same room
        are kept as ranges, and a sequence that was the fullest stays so while pieces of one length go in."""
        rooms: list[int] = []
        ranges: dict[int, list[tuple[int, int]]] = {}

        def keep(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in ranges:
                    bisect.insort(rooms, room)
                    ranges[room] = []
                ranges[room].append((first, n))

        for length in np.flatnonzero(self.left)[::-1]:
            length = int(length)
            while n := int(self.left[length]):
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, wide = ranges[room].pop()
                    if not ranges[room]:
                        del ranges[room], rooms[at]
                else:
                    room, first = self.capacity, self.sequences
                    wide = -(-n // (room // length))
                    self.sequences += wide
                each = room // length
                put = min(n, wide * each)
                full, rest = divmod(put, each)
                self._place(length, put, first, each, self.capacity - room)
                keep(room - each * length, first, full)
                if rest:
                    keep(room - rest * length, first + full, 1)
                keep(room, first + full + bool(rest), wide - full - bool(rest))

    def table(self) -> dict[str, np.ndarray]:
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, len(PLAN_COLUMNS))
        return dict(zip(PLAN_COLUMNS, runs.T, strict=True))


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece of a document: its ids by the tokenizer, then `end_id`, cut only where it is longer than
    `capacity`. With `keep_ids`, the ids go along as `ids` (little-endian unsigned 32-bit)."""
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            out = []
            for key, data in zip(batch["k"], encode(batch["t"]), strict=True):
                data += end
                for piece, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    out.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    # ids travel as text, so that null ids stay null and large ones exact
    rows = docs.select(F.col(doc_id).cast("string").alias("k"), F.col(text).alias("t"))
    found = rows.mapInPandas(cut, schema.replace(f"doc_id {kind}", "doc_id string"))
    found = found.withColumn("doc_id", F.col("doc_id").cast(kind))
    return found if keep_ids else found.drop("ids")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every piece of every document with `sequence_id` and `offset`.

    Null and empty texts are one piece, the end id alone. Repeated rows are packed each. Null ids stay null. Other
    columns are not returned. An empty table gives no rows.
    """
    spark = docs.sparkSession
    numbered = pieces(docs, tokenizer, capacity, end_id, keep_ids, doc_id, text).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    rows = written(numbered, "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(counts, capacity).table())
    salts = max(LEAST_SALTS, -(-sum(counts.values()) // ROWS_PER_SALT))
    group = ["length", "_salt"]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        salted.groupBy(*group)
        .agg(F.count("*").alias("n"))
        .select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    )
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("_row"))
    ranked = (
        salted.withColumn("_inside", inside)
        .join(base, group)
        .withColumn("_rank", F.col("_base") + F.col("_inside") - 1)
        .drop("_salt", "_base", "_inside", "_row")
    )

    def lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = plan.value
        starts = np.searchsorted(run["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["_rank"].to_numpy(np.int64)
            at = np.empty(len(batch), dtype=np.int64)
            for value in np.unique(length):
                here = length == value
                low, high = starts[value], starts[value + 1]
                at[here] = low + np.searchsorted(run["rank"][low:high], rank[here], side="right") - 1
            nth = rank - run["rank"][at]
            batch["sequence_id"] = run["sequence"][at] + nth // run["per_sequence"][at]
            batch["offset"] = run["offset"][at] + nth % run["per_sequence"][at] * length
            yield batch.drop(columns="_rank")

    kind = dict(docs.dtypes)[doc_id]
    out = ranked.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = ", ".join(f"{c} {t}" for c, t in out.dtypes if c != "_rank") + ", sequence_id long, offset long"
    placed = out.mapInPandas(lookup, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
    names = [c for c in numbered.columns if c != "_row"]
    return placed.select(*names, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from `pack(..., keep_ids=True)`; a sequence is at most `capacity` ids long."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(placed, F.lit(b""), lambda out, p: F.concat(out, p["ids"])).alias("ids")
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
