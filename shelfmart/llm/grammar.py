"""Re-Pair grammar files of token ids.

Documents go to shards by ranges of their id. A shard is written as blocks of whole documents; each block is a Parquet
row with its grammar: rules (pairs of symbols), the expansion length of every rule, and the rewritten sequence. Symbols
below `first_rule` are token ids, the others are rules. Lengths make every place in a block reachable without expanding
what stands before it (`slice_ids`).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmart.llm.common import ranges, small_batches, table, text_bytes, tokenizer_path
from shelfmart.llm.tokens import encoder
from shelfmart.session import shared_dir

END_ID = 1
BLOCK_IDS = 3 << 17
SHARD_BYTES = 32 << 20  # of text
LEAST_PAIRS = 2  # how often a pair must occur, without overlap, to become a rule
TEXT_AT_ONCE = 3 << 19  # characters encoded at once; the more, the more often their different words repeat
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)  # greater than any pair, with or without its place
FILE_SCHEMA = (
    "shard int, block long, first_id long, n_ids long, doc_ids array<string>, doc_lengths array<long>, "
    "first_rule long, rules binary, rule_lengths binary, symbols binary"
)


@dataclass
class Grammar:
    first_rule: int
    rules: np.ndarray  # n x 2, of symbols
    rule_lengths: np.ndarray
    symbols: np.ndarray


def _second_of_runs(same: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the places `at`, those `same`, by index, hold equal symbols: which are no pair, since of a run of equal symbols
    every second place alone is one."""
    if not len(same):
        return same
    run = np.flatnonzero(np.r_[True, np.diff(at[same]) > 1])
    nth = np.arange(len(same)) - np.repeat(run, np.diff(np.r_[run, len(same)]))
    return same[nth % 2 == 1]


def _pairs_at(seq: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The symbols at the places `at` and the next ones as one number each, ascending, their places, and the bits of the
    second symbol. Pair and place are sorted as one number where they fit into it, which is much cheaper than to sort or
    look up by pair."""
    left, right = seq[at].astype(np.uint64), seq[1:][at]
    skipped = _second_of_runs(np.flatnonzero(left == right), at)
    bits, place_bits = int(symbols).bit_length(), len(seq).bit_length()
    if 2 * bits + place_bits > 64:
        left <<= np.uint64(32)
        left |= right
        left[skipped] = LAST
        order = np.argsort(left)[: len(at) - len(skipped)]
        return left[order], at[order], 32
    left <<= np.uint64(bits)
    left |= right
    left <<= np.uint64(place_bits)
    left |= at.view(np.uint64)
    left[skipped] = LAST
    left.sort()
    left = left[: len(at) - len(skipped)]
    places = (left & np.uint64((1 << place_bits) - 1)).view(np.int64)
    left >>= np.uint64(place_bits)
    return left, places, bits


def _scattered(pairs: np.ndarray) -> np.ndarray:
    """An order of pairs that has nothing to do with their symbols; different pairs have different numbers."""
    x = pairs * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def _by_frequency(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order of pairs that puts the most frequent first. Equally frequent ones are scattered, so that of a chain of
    them, as a repeated passage gives, a part of its links is taken at once, wherever they lie."""
    order = np.argsort(_scattered(pairs))
    fewer = counts.max(initial=0) - counts[order]
    if len(fewer) and fewer.max() < 1 << 16:
        fewer = fewer.astype(np.uint16)  # sorted by radix
    return order[np.argsort(fewer, kind="stable")]


def _chosen(found: np.ndarray, symbols: int) -> np.ndarray:
    """Of pairs, most frequent first, which are replaced at once: a symbol is left or right as in the most frequent pair
    that has it, and a pair is taken where both its symbols agree, so that places of different pairs never overlap. A
    pair of equal symbols is taken where no more frequent pair has them. The first pair is always taken."""
    left, right = (found >> np.uint64(32)).view(np.int64), (found & np.uint64(0xFFFFFFFF)).view(np.int64)
    rank = np.arange(len(found))
    as_left, as_right = np.full(symbols, len(found)), np.full(symbols, len(found))
    as_left[left[::-1]], as_right[right[::-1]] = rank[::-1], rank[::-1]  # the last value stays
    apart = (as_left[left] < as_right[left]) & (as_right[right] < as_left[right])
    alone = (left == right) & (as_left[left] == rank) & (as_right[left] == rank)
    return np.flatnonzero(apart | alone)


def compress(ids: np.ndarray, first_rule: int, least: int = LEAST_PAIRS) -> Grammar:
    """Replace frequent pairs by rules, round by round, until no pair occurs `least` times.

    A pair that is too rare stays so where its symbols stay, so a round looks only at `open_`, the places where the last
    one found a frequent pair or changed a symbol of theirs.
    """
    seq = ids.astype(np.uint32)
    made: list[np.ndarray] = []
    lengths = np.ones(first_rule, dtype="<u4")  # of all symbols
    open_ = np.ones(len(seq), dtype=bool)
    open_[-1:] = False
    while len(at := np.flatnonzero(open_)):
        symbols = len(lengths)
        pairs, places, bits = _pairs_at(seq, at, symbols)
        bounds = np.r_[0, np.flatnonzero(pairs[1:] != pairs[:-1]) + 1, len(pairs)]
        begin, counts = bounds[:-1], np.diff(bounds)
        often = counts >= least  # scattered masks are made places, which are much cheaper to select by
        open_[places[np.flatnonzero(np.repeat(~often, counts))]] = False
        often = np.flatnonzero(often)
        begin, counts = begin[often], counts[often]
        if not len(begin):
            break
        found = pairs[begin]
        found = found >> np.uint64(bits) << np.uint64(32) | found & np.uint64((1 << bits) - 1)
        order = _by_frequency(found, counts)
        order = order[_chosen(found[order], symbols)]
        begin, counts, chosen = begin[order], counts[order], found[order]
        places = places[ranges(begin, counts)]
        seq[places] = np.repeat(np.arange(symbols, symbols + len(begin), dtype=np.uint32), counts)
        keep = np.ones(len(seq), dtype=bool)
        keep[places + 1] = False
        if len(places) > len(seq) >> 5:
            keep = np.flatnonzero(keep)
        seq, open_ = seq[keep], open_[keep]
        places.sort()
        places -= np.arange(len(places))  # each place before took one symbol away
        open_[places] = True
        open_[np.maximum(places - 1, 0)] = True
        open_[-1:] = False
        rules = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype("<u4")
        made.append(rules)
        lengths = np.r_[lengths, lengths[rules].sum(axis=1, dtype="<u4")]
    rules = np.concatenate(made) if made else np.empty((0, 2), dtype="<u4")
    return Grammar(first_rule, rules, lengths[first_rule:], seq.astype("<u4"))


def _expansions(g: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all symbols one after another, and where each symbol's begin. Rules are expanded many at a time: all
    up to the next one that opens one of them."""
    starts = np.r_[np.arange(g.first_rule), g.first_rule + np.r_[0, np.cumsum(g.rule_lengths, dtype=np.int64)]]
    flat = np.empty(starts[-1], dtype="<u4")
    flat[: g.first_rule] = np.arange(g.first_rule)
    greater, at = g.rules.max(axis=1), 0
    while at < len(g.rules):
        later = greater[at:] >= g.first_rule + at
        end = at + int(later.argmax()) if later.any() else len(g.rules)
        opened = g.rules[at:end].ravel()
        flat[starts[g.first_rule + at] : starts[g.first_rule + end]] = _opened(opened, flat, starts)
        at = end
    return flat, starts


def _opened(symbols: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    begin = starts[symbols]
    return flat[ranges(begin, starts[symbols.astype(np.int64) + 1] - begin)]


def expand(g: Grammar, symbols: np.ndarray | None = None) -> np.ndarray:
    return _opened(g.symbols if symbols is None else symbols, *_expansions(g))


def slice_ids(g: Grammar, start: int, n: int) -> np.ndarray:
    """Ids `start` to `start + n` of a block. The lengths tell which symbol holds the first one and, on the way down the
    rules, which side to take, so that only rules that hold wanted ids are opened."""
    is_rule = g.symbols >= g.first_rule
    lengths = np.ones(len(g.symbols), dtype=np.int64)
    lengths[is_rule] = g.rule_lengths[g.symbols[is_rule] - g.first_rule]
    ends = np.cumsum(lengths)
    low, high = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + n - 1, side="right") + 1
    if n <= 0 or low >= len(ends):
        return g.symbols[:0]
    skip = int(start - (ends[low] - lengths[low]))
    waiting, out = g.symbols[low:high][::-1].tolist(), []
    while waiting and len(out) < n:
        symbol = waiting.pop()
        rule = symbol - g.first_rule
        size = int(g.rule_lengths[rule]) if rule >= 0 else 1
        if skip >= size:
            skip -= size
        elif rule < 0:
            out.append(symbol)
        else:
            left, right = g.rules[rule].tolist()
            waiting += [right, left]
    return np.array(out, dtype="<u4")


def grammar_of(row) -> Grammar:
    read = lambda name: np.frombuffer(row[name], dtype="<u4")
    return Grammar(int(row["first_rule"]), read("rules").reshape(-1, 2), read("rule_lengths"), read("symbols"))


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Write the ids of all documents, each closed by `end_id`, in ascending order of `doc_id` (nulls first).

    Null and empty texts are the end id alone. Repeated ids stay, ordered by their texts' hash. Other columns are not
    written. An empty table gives an empty file.
    """
    spark = docs.sparkSession
    shards = max(spark.sparkContext.defaultParallelism, -(-text_bytes(docs, text) // SHARD_BYTES))
    end = np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)

        def encoded() -> Iterator[tuple[str | None, bytes]]:
            keys, texts, characters = [], [], 0
            for batch in batches:
                for key, text in zip(batch["k"], batch["t"], strict=True):
                    keys.append(key)
                    texts.append(text)
                    characters += len(text or "")
                    if characters >= TEXT_AT_ONCE:
                        yield from zip(keys, coder.encode(texts), strict=True)
                        keys, texts, characters = [], [], 0
            yield from zip(keys, coder.encode(texts), strict=True)

        first_rule = len(coder.closes)
        shard, block, first_id = TaskContext.get().partitionId(), 0, 0
        names: list[str | None] = []
        parts: list[bytes] = []
        size = 0

        def closed() -> pd.DataFrame:
            g = compress(np.frombuffer(b"".join(parts), dtype="<u4"), first_rule)
            row = (
                shard, block, first_id, size, names, [len(p) // 4 for p in parts], first_rule,
                g.rules.tobytes(), g.rule_lengths.tobytes(), g.symbols.tobytes(),
            )
            return pd.DataFrame([row], columns=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

        for key, data in encoded():
            names.append(key)
            parts.append(data + end)
            size += len(data) // 4 + 1
            if size >= BLOCK_IDS:
                yield closed()
                block, first_id, names, parts, size = block + 1, first_id + size, [], [], 0
        if names:
            yield closed()

    small_batches(spark, 256)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    ordered = rows.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h")
    ordered.select(F.col("id").cast("string").alias("k"), "t").mapInPandas(blocks, FILE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Per document of a written file: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit)."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One number a shard reaches the driver; their number is set when the file is written.
    sizes = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, at = {}, 0
    for shard in sorted(sizes):
        before[shard] = at
        at += sizes[shard]
    bases = spark.sparkContext.broadcast(before)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                data = expand(grammar_of(row)).astype("<u4").tobytes()
                lengths = np.array(row["doc_lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                first = bases.value[row["shard"]] + row["first_id"]
                yield pd.DataFrame(
                    {
                        "doc_id": row["doc_ids"],
                        "start": first + ends - lengths,
                        "n_tokens": lengths,
                        "ids": [data[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths, strict=True)],
                    }
                )

    small_batches(spark, 8)  # rows are blocks here
    found = files.mapInPandas(documents, "doc_id string, start long, n_tokens long, ids binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))


def op5_grammar_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/llm-grammar-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
