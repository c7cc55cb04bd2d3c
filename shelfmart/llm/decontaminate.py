"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of the items' word sequences. Document words stream through it; after each word it
knows the longest stretch of words that ends there and occurs in an item. Where that is at least `WINDOW` words, or a
whole shorter item, the stretch is hit, and the state reached names the items.

Items go into parts of bounded size by a hash. A task builds the automaton of one part and streams its documents through;
with several parts the documents are read once a part, and what the parts found is written and united by row. So
neither the driver nor a task holds more of the benchmark than one part, which is larger than its share only for an item
that is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmart.llm.common import small_batches, table, text_bytes, written

WINDOW = 13
COVERAGE = 20  # a document is contaminated when one word in this many is hit
AUTOMATON_BYTES = 1 << 19  # of item text in one automaton
# On UTF-8 bytes, where lower() changes A to Z alone and every byte of another character is in the class.
STRETCHES = "array<struct<start:int,end:int>>"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class SuffixAutomaton:
    """All substrings of the items' word sequences. Words are numbered; unknown ones lead back to the start."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[int]] = [set()]  # items that end a prefix in the state
        self.names = [name for name, _ in items]
        self.short: list[dict[int, set[int]]] = [{}]  # whole items below the window that end in the state, by length
        for k, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._add(last, self.numbers.setdefault(word, len(self.numbers)))
                self.ends[last].add(k)
            if 0 < len(words) < window:
                self.short[last].setdefault(len(words), set()).add(k)
        by_length = sorted(range(len(self.length)), key=self.length.__getitem__)
        for state in by_length[1:]:
            inherited = self.short[self.link[state]]
            if inherited:
                self.short[state] = {n: inherited.get(n, set()) | self.short[state].get(n, set())
                                     for n in inherited.keys() | self.short[state].keys()}
        # Items of a window: gathered up the links, for states that hold a string of `window` words and their ends.
        for state in reversed(by_length[1:]):
            if self.length[self.link[state]] >= window or self.length[state] >= window > self.length[self.link[state]]:
                if self.length[self.link[state]] >= window:
                    self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(out)
        self.ends.append(set())
        self.short.append({})
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of `target` for the strings no longer than those of `state` and `word`."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        state = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            right = self.length[target] == self.length[last] + 1
            self.link[state] = target if right else self._split(last, word, target)
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches of a document as disjoint (start, end) in order, and the items behind them."""
        following, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        stretches: list[list[int]] = []
        states: set[int] = set()
        items: set[int] = set()
        state = long = 0
        for at, word in enumerate(map(self.numbers.get, words)):
            if word is None:
                state = long = 0
                continue
            target = following[state].get(word)
            while target is None and state:
                state = link[state]
                long = length[state]
                target = following[state].get(word)
            if target is None:
                continue
            state, long = target, long + 1
            hit = 0
            if long >= window:
                hit = long
                states.add(state)
            if short[state]:
                for n, found in short[state].items():
                    if n <= long:
                        items |= found
                        hit = max(hit, n)
            if hit:
                start = at + 1 - hit
                while stretches and stretches[-1][1] >= start:
                    start = min(start, stretches.pop()[0])
                stretches.append([start, at + 1])
        for state in states:  # up to the state that holds the last `window` words
            while length[link[state]] >= window:
                state = link[state]
            items |= self.ends[state]
        return [(a, b) for a, b in stretches], items


def _parts(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The items in parts of bounded size; an item is whole in one part, repeated rows are there once."""
    n = max(1, -(-text_bytes(benchmark, text) // AUTOMATON_BYTES))
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("body")).where("item IS NOT NULL")
    if n == 1:
        return [items.distinct()]
    part = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    parted = written(items.withColumn("part", part), "decontamination-items")
    return [parted.where(F.col("part") == k).select("item", "body").distinct() for k in range(n)]


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_columns: list[str] | None = None, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: int = COVERAGE,
) -> DataFrame:
    """`docs` (its `doc_columns`, all by default) with n_words, n_hit, stretches (start, end in words), item_ids
    (sorted as strings) and contaminated.

    Null, empty and wordless texts have no words and are not contaminated; items without words or without an id never
    match. Repeated rows stay. Columns named like the results are replaced. Empty tables give no rows, or rows without
    hits.
    """
    spark = docs.sparkSession
    new = ["n_words", "n_hit", "stretches", "item_ids", "contaminated"]
    kept = [c for c in (docs.columns if doc_columns is None else doc_columns) if c not in new]
    parts = _parts(benchmark, item_id, item_text)
    small_batches(spark)
    if len(parts) == 1:
        items = _broadcast(spark, parts[0])

        def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(items.value, window)
            for texts in batches:
                out = []
                for body in texts:
                    n_words, places, names = _matched(automaton, body)
                    n_hit = sum(b - a for a, b in places)
                    stretches = [{"start": a, "end": b} for a, b in places]
                    out.append((n_words, n_hit, stretches, names, 0 < n_hit and coverage * n_hit >= n_words))
                yield pd.DataFrame(out, columns=new)

        kind = f"n_words long, n_hit long, stretches {STRETCHES}, item_ids array<string>, contaminated boolean"
        found = F.pandas_udf(search, f"struct<{kind}>")
        return docs.select(*kept, found(F.col(text)).alias("_found")).select(*kept, "_found.*")

    # Row numbers are written, so that they are the same for every part.
    numbered = docs.select(*kept, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = written(numbered, "decontamination-rows")
    every = None
    for k, part in enumerate(parts):
        found = _found_in_part(rows, part, window, all_rows=k == 0)
        every = found if every is None else every.unionAll(found)
    unite = F.pandas_udf(lambda column: column.map(_united_stretches), STRETCHES)
    lists = every.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("stretches")).alias("_places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    found = written(lists.select("_row", "n_words", unite("_places").alias("stretches"), "item_ids"), "decontamination-found")
    n_hit = F.aggregate("stretches", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    hit = (F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words"))
    return (
        rows.select(*kept, "_row")
        .join(found, "_row")
        .withColumn("n_hit", n_hit)
        .select(*kept, "n_words", "n_hit", "stretches", "item_ids", hit.alias("contaminated"))
    )


def _broadcast(spark: SparkSession, part: DataFrame) -> Broadcast:
    return spark.sparkContext.broadcast([(r["item"], r["body"]) for r in part.collect()])


def _automaton(items: list[tuple[str, str | None]], window: int) -> SuffixAutomaton:
    return SuffixAutomaton([(item, words_of(body)) for item, body in items], window)


def _matched(automaton: SuffixAutomaton, body: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    words = words_of(body)
    places, items = automaton.hits(words)
    return len(words), places, sorted({automaton.names[k] for k in items})


def _found_in_part(rows: DataFrame, part: DataFrame, window: int, all_rows: bool) -> DataFrame:
    """Written rows (`_row`, n_words, stretches, item_ids) that the part's items hit, or all rows."""
    items = _broadcast(rows.sparkSession, part)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(items.value, window)
        for batch in batches:
            out = []
            for row, body in zip(batch["_row"], batch["_text"], strict=True):
                n_words, places, names = _matched(automaton, body)
                if all_rows or places:
                    out.append((row, n_words, [{"start": a, "end": b} for a, b in places], names))
            yield pd.DataFrame(out, columns=["_row", "n_words", "stretches", "item_ids"])

    kind = f"_row long, n_words long, stretches {STRETCHES}, item_ids array<string>"
    found = written(rows.select("_row", "_text").mapInPandas(search, kind), "decontamination-part")
    items.destroy()
    return found


def _united_stretches(stretches) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in _united([(s["start"], s["end"]) for s in stretches])]


def _united(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_stretches(text: str | None, stretches) -> str | None:
    """The text without the words of the stretches and what stands between them."""
    if text is None or not len(stretches):
        return text
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for s in stretches:
        out.append(data[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return b"".join([*out, data[at:]]).decode()


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
